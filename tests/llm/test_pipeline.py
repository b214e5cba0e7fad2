"""The pipeline against a version that holds all documents in memory."""

import re

import corpus_pipeline
from tests.conftest import SF_CHECK
from tests.llm.test_packing import check
from tests.llm.test_secrets import BASE
from tests.llm.test_simhash import slow_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def slow_stages(rows):
    """Surviving {doc_id: text} after language ID, exact dedup and near-dedup."""
    docs = {d: t for d, t in rows if any(map(str.isalpha, t or ""))}
    best = {}
    for d, t in docs.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1, 0, "")), (-len(t), d, t))
    docs = {d: t for _, d, t in best.values()}
    fps = {d: slow_fingerprint(t) for d, t in docs.items()}
    comp, moved = {d: d for d in docs}, True
    near = {d: [e for e in docs if (fps[d] ^ fps[e]).bit_count() <= 3] for d in docs}
    while moved:
        moved = False
        for d in docs:
            low = min(comp[e] for e in near[d])
            moved, comp[d] = moved or low < comp[d], low
    return {d: t for d, t in docs.items() if comp[d] == d}


def slow_redacted(text):
    cuts = sorted((m.start(), m.end()) for p, g, least in BASE.values() for m in p.finditer(text) if len(m[g]) >= least)
    out, at = [], 0
    for a, b in cuts:
        if a >= at:
            out += [text[at:a], "<SECRET>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_stages_keep_the_columns_and_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    extra = [(10**6, "12 34 !!", "en", "s", 8), (10**6 + 1, None, None, None, None),
             (10**6 + 2, "user: someone and aB3aB3aB3aB3aB3aB3aB3aB3 here", "en", "s", 47)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    want = slow_stages([(r.doc_id, r.text) for r in docs.collect()])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        path = corpus_pipeline.work_path(spark, "t", name)
        out = stage(spark, docs, SF_CHECK)
        assert out.columns == COLUMNS and out.dtypes == docs.dtypes
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k == 2:
            assert {r.doc_id: r.text for r in docs.collect()} == want
    got = {r.doc_id: r for r in docs.collect()}
    linked = 10**6 + 2
    assert got[linked].text == "<SECRET> and <SECRET> here" and got.keys() == want.keys()
    assert {d: r.text for d, r in got.items() if d != linked} == {d: slow_redacted(t) for d, t in want.items() if d != linked}
    assert all(r.n_chars == len(r.text) for r in got.values())
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF_CHECK).collect()
    assert check(packed, {d: r.text for d, r in got.items()}) < 0.01


def test_run_returns_packed_rows(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
