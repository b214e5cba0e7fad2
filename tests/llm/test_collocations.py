import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from webweft.llm import collocations as C


def slow(rows, least=10, cover=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        kept = []
        for p, a in cand.items():
            if len(p) == 2 and longer[p] and 100 * longer[p] >= cover * a:
                continue
            score, k = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def random_rows(rng, docs, vocabulary, words):
    names = [f"W{i}" if i % 2 else f"é{i}" for i in range(vocabulary)] + ['"q"', "a\x85b", "\\", "-", "\x00", "\x1c", "N\xa0A", "null"]
    rows = []
    for _ in range(docs):
        chosen = rng.choice(names, words, p=(w := 1 / np.arange(1, len(names) + 1)) / w.sum())
        signs = rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " !? ", "\r\n", "\x0b", ";:"], words, p=[.5, .2, .05, .05] + [.2 / 7] * 7)
        rows.append((rng.choice(["en", "de", ""]) if rng.random() < 0.9 else None, "".join(a + b for a, b in zip(chosen, signs))))
    return rows + [("en", None), ("en", ""), (None, " \n.,"), ("fr", "only few words here"), ("en", "x y z " * 40), ("de", "same " * 300),
                   ("en", "x" * 3_000_000 + " long word")]


def run(spark, rows, **parameters):
    df = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, w1 string, n int")
    return sorted(tuple(r) for r in C.collocations(df, **parameters).collect())


def test_equals_brute_force(spark):
    rows = random_rows(np.random.default_rng(1), 60, 40, 120)
    assert run(spark, rows) == slow(rows)


def test_ties_repeated_rows_and_a_short_list(spark):
    rows = [("en", "b a. c d. a b c. d c")] * 20 + [("en", "B A! q r s; q r s")] * 10
    assert run(spark, rows, top=3) == slow(rows, top=3)
    assert len(slow(rows, top=3)) == 3


def test_subsumption_counts_dropped_and_lower_ranked_phrases(spark):
    rows = [("en", "new york city")] * 10 + [("en", "new york")] * 10 + [("en", "old york city")] * 9
    got = run(spark, rows)
    assert got == slow(rows)
    assert "new york" not in [r[2] for r in got]  # half of its occurrences lie in the longer phrase
    rows += [("en", "new york")]
    assert "new york" in [r[2] for r in run(spark, rows)]


def test_a_text_longer_than_what_is_counted_at_once(spark):
    rng = np.random.default_rng(4)
    text = " ".join(rng.choice(["a", "b", "c", "d.", "e"], 3000))
    df = spark.createDataFrame([("en", text)] * 2, "lang string, text string")
    lines = Counter()
    for at_once in (7, 100, 5000):
        count = Counter()
        for r in C.partial_stripes(df, 4, at_once).collect():
            for line in r.lines.decode().split("\n"):
                prefix, following, n = line.split("\t")
                count[prefix, following] += int(n)
        lines = lines or count
        assert count == lines
    assert sum(lines.values()) == 6000


def test_bucket_merged_in_many_steps(spark, monkeypatch):
    rows = random_rows(np.random.default_rng(2), 30, 20, 150)
    monkeypatch.setattr(C, "MERGE_BYTES", 200)
    monkeypatch.setattr(C, "BLOB_LINES", 5)
    assert run(spark, rows) == slow(rows)


def test_scores_pass_64_bits(spark):
    big = 30_000_000_000_000
    df = spark.createDataFrame([(big, big, big + 7)], "a long, l long, r long")
    assert df.select(C._score("a", "l", "r").alias("s")).first().s == 1000000 * big * big // (big * (big + 7))


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(df).collect() == []


@pytest.mark.parametrize("text", ["a,b;C\td\x0ce", "...", "x\x85y z\x1cw"])
def test_words(text):
    want = []
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.lower()):
        want += [w.encode() for w in re.split(r"[\x20\x09]+", piece) if w] + [b"."]
    assert C.words_of(text.encode()) == want[:-1]
