import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as E
from tests.conftest import SF_CHECK
from webweft.llm import licenses as L

SCANNER = L.Scanner(L.TEMPLATES)
LINES = {"Released under the MIT License.": "MIT-line", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
         "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
         "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-line"}


def slow_best(text, name, threshold):
    """Best Dice coefficient of any window of the text with one template, window by window."""
    pairs, bag = L.bigrams(L.words_of(text)), SCANNER.bags[name]
    best = 0.0
    for a in range(len(pairs)):
        for b in range(a + 1, min(len(pairs), a + 2 * bag.total()) + 1):
            best = max(best, 2 * (Counter(pairs[a:b]) & bag).total() / (b - a + bag.total()))
    return best if best >= threshold - 1e-9 else 0.0


def test_best_scores_equal_every_window():
    rng = np.random.default_rng(3)
    vocab = sorted({w for t in L.TEMPLATES.values() for w in L.words_of(t)})
    for _ in range(6):
        words = list(rng.choice(vocab, 30))
        lines = rng.choice(list(LINES), 2)
        noisy = [w for line in lines for w in L.words_of(line) if rng.random() > 0.1]
        text = " ".join([*words[:15], *noisy, *words[15:]])
        for name in L.TEMPLATES:
            hits = [(i, p) for i, p in enumerate(L.bigrams(L.words_of(text))) if p in SCANNER.bags[name]]
            got = max((s for _, _, s in SCANNER.passages(name, hits)), default=0.0)
            assert abs(got - slow_best(text, name, 0.8)) < 1e-9, (name, text)


def test_each_template_finds_itself_and_only_itself():
    for name, text in L.TEMPLATES.items():
        found = SCANNER.scan(f"Before it. {text}\nAfter it.")
        assert [m.name for m in found] == [name] or name in ("Apache-2.0", "Apache-2.0-notice")
        assert name in [m.name for m in found] and all(m.score >= 0.8 for m in found)


def test_spans_spelling_years_and_small_changes():
    text = "é𝄞 x. released UNDER the 2021 MIT-Licence! y"
    m, = SCANNER.scan(text)
    assert (m.name, text[m.start:m.end], m.score) == ("MIT-line", "released UNDER the 2021 MIT-Licence", 1.0)
    assert SCANNER.scan("Released with the MIT License") == []
    two = SCANNER.scan("Released under the MIT License. Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.")
    assert [m.name for m in two] == ["MIT-line", "CC-BY-NC-4.0", "CC-BY-line"]


def test_query_finds_every_licence_line(spark):
    out = {r.doc_id: r for r in E.queries()["op7_licenses"](spark, SF_CHECK).collect()}
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()
    assert out.keys() == {r.doc_id for r in docs}
    for r in docs:
        want = {name for line, name in LINES.items() if line in r.text}
        assert set(out[r.doc_id].licenses) == want, r.doc_id
        for m in out[r.doc_id].matches:
            assert r.text[m.start:m.end] in {x.rstrip(".") for x in LINES} and m.score == 1.0


def test_odd_texts_and_empty_table(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word"), (5, "under the " * 40000), (6, "Released under the MIT License. " * 500),
            (None, "Licensed under CC BY 4.0"), (6, "x")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, matches string")
    out = [(str(r.doc_id), len(r.matches)) for r in L.scan_licenses(docs).collect()]
    assert sorted(out) == sorted([("1", 0), ("2", 0), ("3", 0), ("4", 0), ("5", 0), ("6", 500), ("None", 1), ("6", 0)])
    assert L.scan_licenses(docs.limit(0)).collect() == []

# Texts whose licences share most of their words: each must get its own name.
SIBLINGS = {
    "GPL-2.0": L.NOTICES["GPL-3.0"].replace("version 3", "version 2"),
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": L.NOTICES["GPL-3.0"].replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
    "LGPL-3.0": L.NOTICES["GPL-3.0"].replace("GNU General", "GNU Lesser General"),
    "CC-BY-NC-name": "Creative Commons Attribution-NonCommercial 4.0 International",
    "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0", "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.", "BSD-2-line": "Licensed under the BSD 2-Clause License.",
}


def test_siblings_get_their_own_names():
    for name, text in SIBLINGS.items():
        assert [m.name for m in SCANNER.scan(f"Before it. {text}\nAfter it.")] == [name], text


def test_whole_licences_with_other_holders_and_lost_words():
    rng = np.random.default_rng(5)
    for name, text in L.TEXTS.items():
        words = [w for w in text.split() if rng.random() > 0.01]
        m, *rest = SCANNER.scan("Copyright 2020 Some Person. " + " ".join(words) + " And more.")
        assert (m.name, rest) == (name, []) and m.score > 0.9


def test_an_opening_alone_names_no_single_licence():
    assert [m.name for m in SCANNER.scan(L.OPENINGS["BSD-opening"])] == ["BSD-opening"]


def greedy(text):
    """The matches of a text from the list of all passages, the heaviest first."""
    pairs, found, kept = L.bigrams(L.words_of(text)), [], []
    for name, bag in SCANNER.bags.items():
        hits = [(i, p) for i, p in enumerate(pairs) if p in bag]
        for a, b, score in SCANNER.passages(name, hits):
            both = b - a + 1 + bag.total()
            found.append((both - 3 * round(score * both / 2), a, name, b, score))
    for _, a, name, b, score in sorted(found):
        if all(b < x or y < a for x, y, *_ in kept):
            kept.append((a, b, name, score))
    return [(name, score) for _, _, name, score in sorted(kept)]


def test_matches_equal_the_list_of_all_passages():
    rng = np.random.default_rng(7)
    short = [t for n, t in L.TEMPLATES.items() if len(t) < 1500]
    for _ in range(20):
        words = [w for t in rng.choice(short, 4) for w in t.split() if rng.random() > 0.05]
        text = " ".join(words)
        assert [(m.name, m.score) for m in SCANNER.scan(text)] == greedy(text)


def heaviest_first(scanner, text):
    """Every passage of every template, the heaviest first, unless it meets one that stays."""
    words = L.words_of(text)
    pairs = L.bigrams(words)
    found = []
    for name, bag in scanner.bags.items():
        hits = [(i, p) for i, p in enumerate(pairs) if p in bag]
        for first, last, score in scanner.passages(name, hits) if hits else ():
            both = last - first + 1 + bag.total()
            found.append((-(round(score * both / 2) * 3 - both), first, name, last, score))
    kept = []
    for _, first, name, last, score in sorted(found):
        if all(last < a or first > b for a, b, _, _ in kept):
            kept.append((first, last, name, score))
    places = L.places_of(text)
    return [(name, places[a][0], places[b + 1][1], round(score, 9)) for a, b, name, score in sorted(kept)]


@pytest.mark.parametrize("seed", range(4))
def test_neighbouring_starts_lose_no_match(seed):
    """Few words, many repeats: passages left to a neighbouring start are found from it."""
    rng = random.Random(seed)
    for _ in range(150):
        vocabulary = [f"w{i}" for i in range(rng.choice([2, 3, 5]))]
        templates = {f"t{k}": " ".join(rng.choices(vocabulary, k=rng.randint(2, 12))) for k in range(rng.randint(1, 3))}
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts += rng.choice(list(templates.values())).split() if rng.random() < 0.7 else rng.choices([*vocabulary, "x"], k=4)
            if rng.random() < 0.5:
                parts[rng.randrange(len(parts))] = "x"
        scanner, text = L.Scanner(templates, rng.choice([0.6, 0.8, 0.9])), " ".join(parts)
        assert [(m.name, m.start, m.end, round(m.score, 9)) for m in scanner.scan(text)] == heaviest_first(scanner, text)


def test_work_grows_with_the_text_alone(monkeypatch):
    """Counted bigrams of copies of a whole licence: in proportion to the copies."""
    counted = []
    ends = L.Starts._ends
    monkeypatch.setattr(L.Starts, "_ends", lambda self, i, low, stop, common: (
        counted.append(stop - low), ends(self, i, low, stop, common))[1])
    work = []
    for copies in (2, 8):
        counted.clear()
        assert len(L.Scanner(L.TEMPLATES).scan((L.TEXTS["MPL-2.0-text"] + " and so on ") * copies)) == copies
        work.append(sum(counted) + 1)
    assert work[1] <= 6 * work[0]
