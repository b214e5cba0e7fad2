import numpy as np
import pytest

import __spark_entry__ as E
from webweft.llm import quality as Q

SF = "/root/testdata/sf0.1"


def test_query_agrees_with_labels_it_never_read(spark):
    out = E.queries()["op10_quality"](spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in out.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 10000 and all(0 <= r.score <= 1 for r in rows.values())
    good = [r.predicted for d, r in rows.items() if labels.get(d) == 1 and r.held_out]
    bad = [r.predicted for d, r in rows.items() if labels.get(d) == 0 and r.held_out]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.85, 0.75, 0.75])
    cast = np.where((rng.random((len(y), 5)) < accuracy) == y[:, None], 1, -1)
    cast[rng.random(cast.shape) < 0.3] = 0
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    model = Q.fit_label_model(patterns, counts.astype(float), rounds=60)
    assert np.abs(model.accuracy() - accuracy).max() < 0.08
    assert np.mean((model.posterior(cast) > 0.5) == y) > 0.93


def test_patterns_round_trip():
    for text in [None, "", "a b c.", "x### " * 40, "A | b | c"]:
        assert tuple(Q.votes_of(Q.pattern_of(Q.votes(text)))) == Q.votes(text)


def test_features_over_chunks_equal_those_of_the_whole(monkeypatch):
    text = "Some words, 12 of them; A | b.\n" * 60
    one, many = np.zeros(1 << Q.DIM_BITS), np.zeros(1 << Q.DIM_BITS)
    Q.features(text, one)
    monkeypatch.setattr(Q, "CHUNK", 13)
    Q.features(text, many)
    np.testing.assert_allclose(one, many)


JUNK = {"signs": "word### other%%% thing&&& last$$$ " * 30, "table": "a | b | c | d |\n" * 40, "repeats": "same same same same " * 40}
PROSE = " ".join(f"The sentence with number {w} has many other words in it." for w in
                 ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()))


def test_junk_is_bad_and_odd_texts_are_defined(spark):
    good = [(i, f"{PROSE} It ends with word {chr(97 + i % 26)}{chr(97 + i // 26)}.", "x") for i in range(200)]
    bad = [(1000 + i, f"{list(JUNK.values())[i % 3]} {i}", "x") for i in range(30)]
    odd = [(2000, None, "y"), (2001, "", "y"), (2002, " \n\t", "y"), (2003, PROSE * 400, "y"), (None, PROSE, "y"), (2003, PROSE, "y")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, score string")
    out = [(r.doc_id, r.score) for r in Q.score(docs, Q.train(docs)).collect()]
    assert len(out) == len(good + bad + odd)
    for d, s in out:
        assert (s < 0.5) == (d is not None and 1000 <= d < 2003), (d, s)
    assert [s for d, s in out if d in (2000, 2001, 2002)] == [0, 0, 0]


def test_empty_table_and_one_sided_table(spark):
    docs = spark.createDataFrame([(1, PROSE), (2, None)], "doc_id long, text string")
    assert Q.score(docs.limit(0), Q.train(docs.limit(0))).collect() == []
    model = Q.train(docs.filter("doc_id = 1"))
    assert model.weights is None and [r.score > 0.5 for r in Q.score(docs, model).collect()] == [True, False]


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"{PROSE} {i}" if i % 2 else JUNK["signs"]) for i in range(120)], "doc_id long, text string")
    cast = Q.vote_rows(docs)
    good = [Q.pattern_of(Q.votes(f"{PROSE} 1"))]
    assert Q.training_sample(docs, cast, good, 20).count() == 20
    import zlib
    assert Q.training_sample(docs, cast, good, 1000).count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(120))


@pytest.mark.parametrize("name", list(JUNK))
def test_each_kind_of_junk_has_two_votes(name):
    assert Q.votes(JUNK[name]).count(Q.BAD) >= 2
