import numpy as np
import pytest
import xxhash

from webweft.llm import simhash as S


def slow_fingerprint(text):
    import re
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows):
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    comp = {d: d for d, _ in fps}
    moved = True
    while moved:
        moved = False
        for d, f in fps:
            low = min(comp[e] for e, g in fps if (f ^ g).bit_count() <= 3)
            if low < comp[d]:
                comp[d], moved = low, True
    return {d: (f"{f:016x}", comp[d]) for d, f in fps}


def run(spark, rows, schema="doc_id long, text string"):
    out = S.simhash_components(spark.createDataFrame(rows, schema))
    return {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in out.collect()}


def test_matches_brute_force_with_odd_texts(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    rows = [(i, base[i % 12] + (f" tail{i}" if i % 3 else "")) for i in range(90)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "One"), (104, "one TWO"), (105, "É é É\x85x"),
             (106, "one two"), (107, "a b c"), (108, "x " * 30000), (109, base[0].upper())]
    assert run(spark, rows) == slow_components(rows)


def test_fingerprint_matches_the_definition():
    for t in ["", "a", "a b c d", "Ünï Ö ß", "x\x1cy z\x0bq w e", "the the the the the", "A" * 5000 + " b c d"]:
        assert S.fingerprint(t.encode()) == slow_fingerprint(t)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7])
@pytest.mark.parametrize("n", [1, 63, 64, 200, 700])
def test_bit_sliced_links_equal_all_distances(n, radius):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 1 << 63, size=max(1, n // 8), dtype=np.uint64)[rng.integers(0, max(1, n // 8), n)]
    for _ in range(3):
        fps ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    got = {(a, b) for i, j in S.tile_links(fps, fps, radius) for a, b in zip(i.tolist(), j.tolist())}
    assert got == set(zip(*[x.tolist() for x in np.nonzero(near)]))


def test_small_groups_share_lanes():
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 40, 300))
    fps = rng.integers(0, 1 << 6, 300, dtype=np.uint64)
    ids = rng.permutation(300)
    src, dst = S._small_group_edges(group, ids, fps, 1)
    label = {i: i for i in ids.tolist()}
    for _ in range(20):
        for a in range(300):
            near = [b for b in range(300) if group[a] == group[b] and int(fps[a] ^ fps[b]).bit_count() <= 1]
            label[ids[a]] = min(label[ids[b]] for b in near)
    assert {**{i: i for i in ids.tolist()}, **dict(zip(src.tolist(), dst.tolist()))} == label


def test_hot_key_is_tiled_and_loses_no_link(spark):
    """One key holds every fingerprint; tiles are far smaller than it."""
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 9, 400) << 40).tolist()
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, fp long")
    roots = {r.id: r.root for r in S.components(S.near_links(nodes, tile=16)).collect()}
    comp = list(range(len(fps)))
    for _ in range(12):
        comp = [min(comp[j] for j, g in enumerate(fps) if (f ^ g).bit_count() <= 3) for f in fps]
    assert {i: c for i, c in enumerate(comp) if c != i} == roots


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 99)], "src long, dst long")
    got = {r.id: r.root for r in S.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 100: 99}


def test_empty_table_ties_and_clashing_columns(spark):
    assert run(spark, []) == {}
    rows = [(1, "a b c d", "x", 7), (1, "a b c d", "y", 8), (None, "a b c d", "z", 9), (0, "q w e r", "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    out = [(r.doc_id, r.component_id) for r in S.simhash_components(docs).collect()]
    assert sorted(out, key=str) == sorted([(1, 1), (1, 1), (None, 1), (0, 0)], key=str)


def test_stage_keeps_one_of_a_component_with_all_columns(spark):
    rows = [(i, "same words in every one of these texts here", "en", "s", 9) for i in range(5)]
    rows.append((9, "entirely other words stand in this last text", "en", "s", 9))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = S.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 9]


def test_stage_with_repeated_and_missing_ids(spark):
    a, b, c = ("same words in every one of these", "other words stand in this text now", "a third text has its own words")
    docs = spark.createDataFrame([(1, a), (1, a), (2, b), (1, c), (None, b), (None, "zz yy xx ww"), (None, "q r s t u v")],
                                 "doc_id long, text string")
    out = sorted(((r.doc_id or 0), r.text) for r in S.drop_near_copies(spark, docs, "").collect())
    assert out == sorted([(1, a), (2, b), (1, c), (0, "zz yy xx ww"), (0, "q r s t u v")])


def test_stage_keeps_columns_with_the_names_it_uses(spark):
    docs = spark.createDataFrame([(1, "same text here", 5), (2, "same text here", 6)], "doc_id long, text string, _DOC_AT int")
    out = S.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "same text here", 5)]
