import re
from itertools import combinations

import numpy as np
import pytest

from webweft.llm import jaccard_join as J


def slow_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset([" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else []))


def slow(rows):
    """Component of each row, by position: rows may share a doc_id."""
    sets = [slow_set(t) for _, t in rows]
    part = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            a, b = part[i], part[j]
            part = [a if x == b else x for x in part]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [e for (e, _), p in zip(rows, part) if p == part[i] and e is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def run(spark, rows, **parameters):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, set string").repartition(3)
    out = J.jaccard_components(df, **parameters).select("doc_id", "n_shingles", "component_id")
    return sorted((tuple(r) for r in out.collect()), key=str)


def near_copies(rng, sizes, copies, edits):
    rows = []
    for size in sizes:
        base = [f"w{x}" for x in rng.integers(0, 5000, size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(int(rng.integers(0, edits + 1))):
                at = int(rng.integers(0, len(text)))
                kind = rng.integers(0, 3)
                text[at:at + (kind != 1)] = [] if kind == 0 else [f"n{rng.integers(0, 10 ** 6)}"]
                text = text or ["x"]
            rows.append(" ".join(text))
    return rows


ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "oNE"), (905, "one two"), (906, "One TWO\n"), (907, "a b c"),
       (908, "x " * 5000), (909, "x x x"), (None, "a b c"), (None, "alone here with null id"), (None, None), (5, "repeated id other text"),
       (5, "repeated id other text"), (5, "a b c"), (910, "É é É\x85x"), (911, "é É É\x85x")]


@pytest.mark.parametrize("limit", [None, 9, 19, 29])
def test_equals_brute_force(spark, limit):
    rng = np.random.default_rng(limit or 0)
    texts = near_copies(rng, [5, 9, 11, 12, 13, 21, 22, 23, 31, 32, 41, 60, 100, 180], 8, 4)
    rows = [*enumerate(texts), *ODD]
    assert run(spark, rows, limit=limit) == slow(rows)


def test_links_at_the_threshold(spark):
    """Sets that reach 0.9 exactly, and those that miss it by one shingle."""
    rows = []
    for n in (9, 10, 18, 19, 20, 27, 36, 45, 90, 91, 95, 180, 190):
        for extra in range(0, n // 8 + 2):
            rows.append((len(rows), " ".join(f"t{n}x{i}" for i in range(n + 2 + extra))))
    for limit in (9, 19):
        assert run(spark, rows, limit=limit) == slow(rows)


def test_group_over_many_tiles(spark):
    """A chain that only neighbours link, and a large group of near copies, with tiles far smaller than either."""
    rng = np.random.default_rng(8)
    words = [f"c{x}" for x in range(400)]
    rows = [(i, " ".join(words[3 * i:3 * i + 120])) for i in range(60)]
    rows += [(1000 + i, t) for i, t in enumerate(near_copies(rng, [150], 120, 6))]
    assert run(spark, rows, tile=700) == slow(rows)


def test_hot_group_of_copies_with_many_flushes(spark, monkeypatch):
    monkeypatch.setattr(J, "POSTINGS_AT_ONCE", 50)
    rng = np.random.default_rng(2)
    rows = [(i, t) for i, t in enumerate(near_copies(rng, [40, 15], 60, 1) * 2)]
    assert run(spark, rows) == slow(rows)


def test_keys_meet_for_every_linked_pair():
    """Blocks: sets within the threshold share a key, also those with empty blocks."""
    rng = np.random.default_rng(0)
    ends = J.size_classes(10_000)
    for a in [*range(9, 70), 100, 163, 300, 1000]:
        for _ in range(6):
            base = np.unique(rng.integers(0, 1 << 63, a).astype(np.uint64))
            b = int(rng.integers(len(base), len(base) * 10 // 9 + 1))
            common = J.need(len(base), b)
            other = np.unique(np.concatenate([rng.permutation(base)[:common], rng.integers(0, 1 << 63, b - common).astype(np.uint64)]))
            assert set(J.block_keys(base, ends)) & set(J.block_keys(other, ends)), (a, b)
    few = np.arange(60, dtype=np.uint64) * np.uint64(0) + np.uint64(7)
    assert len(J.block_keys(np.unique(few), ends))


def test_subsets():
    h = J.shingle_hashes(np.arange(14, dtype=np.uint64) + np.uint64(3))
    keys = list(J.subset_keys(h))
    assert len(h) == 12 and sorted({c for _, c in keys}) == [11, 12] and len({k for k, _ in keys}) == 13


def test_empty_table(spark):
    assert run(spark, []) == []
