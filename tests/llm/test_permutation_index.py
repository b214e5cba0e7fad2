import numpy as np
import pytest

import __spark_entry__ as E
from webweft.llm import permutation_index as P


def brute(rows, every=20, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q, v in zip(ids, x):
        if q % every == 0:
            s = x @ v
            other = np.nonzero(ids != q)[0]
            best = other[np.lexsort((ids[other], -s[other]))][:k]
            out[int(q)] = [(int(ids[b]), s[b]) for b in best]
    return out


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = collect(E.queries()["op6_permutation_index"](spark, sf)), brute(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    x = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, found in got.items():
        assert len(found) == 20
        for i, s in found:
            assert s == pytest.approx(x[i] @ x[q], abs=1e-12)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_footrule_of_the_inverted_files_equals_the_definition():
    rng = np.random.default_rng(4)
    pivots, x = P.unit(rng.normal(size=(30, 8))), rng.normal(size=(200, 8))
    block, prefix = P.build_block(np.arange(200), x, pivots), 30
    order = P.orders(x, pivots, prefix)
    files = {f["pivot"]: (np.frombuffer(f["rows"], "<u2"), np.frombuffer(f["places"], "<u2").astype(np.int64))
             for f in block["files"]}
    for short in (5, 30):
        cut = {p: (r[pl < short], pl[pl < short]) for p, (r, pl) in files.items()}
        for q in range(5):
            place = [{p: i for i, p in enumerate(o[:short])} for o in order]
            far = [sum(abs(place[q].get(p, short) - o.get(p, short)) for p in range(30)) for o in place]
            want = sorted(range(200), key=lambda i: (far[i], i))[:17]
            assert sorted(P.nearest_orders(order[q][:short], cut, 200, 17, short)) == sorted(want)


def test_hot_vector_ties_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST", 40)
    rng = np.random.default_rng(1)
    common = rng.normal(size=6).tolist()
    rows = [(i, common if i % 3 else rng.normal(size=6).tolist()) for i in range(1, 400)]
    rows += [(1000, (10 * rng.normal(size=6)).tolist())]
    odd = [(2000, None), (2020, [0.0] * 6), (2040, [None] + [1.0] * 5), (2060, [float("nan")] * 6),
           (2080, [float("inf")] + [1.0] * 5), (2100, [1.0] * 5), (None, [1.0] * 6), (2120, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int")
    got = collect(P.permutation_search(df))
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in brute(rows).items()}


def test_few_rows_repeated_ids_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], schema)
    got = collect(P.permutation_search(df))
    assert got == {0: [(1, 0.5), (1, 0.5), (20, 0.0)], 20: [(1, 0.5), (1, 0.5), (0, 0.0)]}
    assert P.permutation_search(df.limit(0)).collect() == []
    assert collect(P.permutation_search(df.filter("vec_id = 0"))) == {}


def test_small_blocks_meet_all_queries(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pivots = P.choose_pivots(P.usable(df))
    index = P.build_index(df.repartition(3), pivots, block_rows=64)
    assert index.count() >= 8
    got = collect(P.search(index, df.filter("vec_id % 20 = 0").repartition(4), pivots))
    assert recall(got, brute(rows)) == 1


@pytest.mark.parametrize("kind", ["even", "uneven", "wide", "clustered"])
def test_recall_of_a_full_block_at_the_production_share(kind):
    """A whole block of unclustered, uneven and clustered vectors; a third of it is ranked again."""
    rng = np.random.default_rng(7)
    n, dim = P.BLOCK_ROWS, 128 if kind == "wide" else 64
    x = rng.normal(size=(n, dim))
    if kind == "clustered":
        x = rng.normal(size=(40, dim))[rng.integers(0, 40, n)] + 0.4 * x
    if kind in ("uneven", "wide"):
        x = x * rng.lognormal(0, 0.4, (n, 1))
    pivots = P.unit(x[rng.permutation(n)[:P.PIVOTS]])
    block, asked = P.build_block(np.arange(n), x, pivots), rng.permutation(n)[:100]
    q, found, _ = P.search_block(asked, x[asked], block, pivots)
    scores = x[asked] @ x.T
    scores[np.arange(100), asked] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.reshape(100, 20), want)]) >= 0.9
    assert P.RERANKED <= 0.35 and P.LEAST <= 100
