import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from webweft.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def held(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


@pytest.fixture(scope="module")
def rows(spark):
    out = E.queries()["op5_toxicity"](spark, SF)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    return {r.doc_id: r for r in out.collect()}


def test_held_out_precision_and_recall(spark, rows):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 10000
    assert all(r.held_out == held(d) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    tested = [(labels[d].toxic, r.predicted) for d, r in rows.items() if d in labels and r.held_out]
    hit = sum(a and b for a, b in tested)
    assert hit / sum(b for _, b in tested) > 0.9
    assert hit / sum(a for a, _ in tested) > 0.9


def planted(n=160):
    """Toxic texts hold words of one stem at a high rate; clean ones hold it once in a while."""
    rng = np.random.default_rng(0)
    vocab = ["".join(rng.choice(list("abdefgilmnoprstu"), 6)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocab, 200))
        if i % 4 == 0:
            words[::12] = [f"zorg{w[:3]}" for w in words[::12]]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    return docs, labels


def test_planted_stem_is_found_and_odd_texts_are_clean(spark):
    docs, labels = planted()
    odd = [(1000, None), (1001, ""), (1002, "12 !? \n"), (1003, "calm words " * 40000), (None, "calm"), (1003, "zorgx " * 9)]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string").selectExpr("*", "doc_id as score", "'x' as toxic")
    lab = spark.createDataFrame(labels + [(1, None), (0, 1), (0, 0), (None, 1)], "doc_id long, toxic int")
    model = T.train(d, lab)
    assert any(p.startswith("^zorg") for p in model.patterns)
    got = [(r.doc_id, r.score) for r in T.score(d, model).collect()]
    scores = dict(x for x in got if x[0] is not None and x[0] < 1000)
    assert all((scores[i] >= T.THRESHOLD) == bool(y) for i, y in labels)
    assert len(got) == len(docs) + len(odd)
    assert all(s < T.THRESHOLD for d, s in got if d in (1000, 1001, 1002, None))
    assert sorted(s >= T.THRESHOLD for d, s in got if d == 1003) == [False, True]


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score(d, T.train(d, lab)).collect()[0].score == 0
    assert T.score(d.limit(0), T.train(d.limit(0), lab)).collect() == []


def test_held_out_rows_are_never_sampled(spark):
    docs, labels = planted(200)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    texts = {r.text for r in T.training_sample(d, lab).collect()}
    assert texts == {t for i, t in docs if not held(i)}


def test_label_model_recovers_accuracies_and_finds_copies():
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.2
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.8])
    right = rng.random((len(y), 5)) < accuracy
    votes = np.where(right == y[:, None], 1, -1).astype(np.int8)
    votes[rng.random(votes.shape) < 0.2] = 0
    votes = np.column_stack([votes, votes[:, 4]])  # the last voter repeats the one before
    model = T.fit_label_model(votes, np.where(votes.sum(axis=1) > 0, 0.9, 0.1), rounds=40)
    assert np.abs(model.accuracy()[:4] - accuracy[:4]).max() < 0.05
    assert np.mean((model.posterior(votes) > 0.5) == y) > 0.96
    assert model.shares[4] < 0.7 < model.shares[0] and model.shares[5] == pytest.approx(model.shares[4])
