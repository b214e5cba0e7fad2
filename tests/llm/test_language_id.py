import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_CHECK
from webweft.llm import language_id as L


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.read.parquet(f"{SF_CHECK}/documents.parquet"))


def test_held_out_accuracy_and_contract_columns(spark):
    out = E.queries()["op9_language_id"](spark, SF_CHECK)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = {r.doc_id: r for r in out.collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    assert rows.keys() == truth.keys()
    import zlib
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    tested = [d for d, r in rows.items() if r.held_out]
    assert np.mean([rows[d].lang_pred == truth[d] for d in tested]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_scores_equal_the_kernel_written_out(model):
    """Presence kernels over sets of hashed n-grams, one text and one landmark at a time."""
    def grams(row):
        return set(np.nonzero(row)[0].tolist())
    texts = ["The quick thing, and", "x", "a" * 70000 + " z"]
    held = [grams(model.landmarks[:, k]) for k in range(model.landmarks.shape[1])]
    for text, got in zip(texts, model.margins(texts)):
        row = np.zeros(L.DIMS)
        L.presence(text, row)
        mine = grams(row)
        k = np.array([len(mine & x) / np.sqrt(len(mine) * len(x)) for x in held])
        np.testing.assert_allclose(got, k @ model.weights, atol=2e-3)


def test_presence_over_chunks_is_that_of_the_whole_text(monkeypatch):
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(2000))
    one, many = np.zeros(L.DIMS), np.zeros(L.DIMS)
    L.presence(text, one)
    monkeypatch.setattr(L, "CHUNK", 17)
    L.presence(text, many)
    assert (one == many).all()


def test_odd_texts_and_clashing_columns(spark, model):
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 ½ __ ! \n", "c"), (4, "É", "d"), (5, "the " * 50000, "e"),
            (None, "the and of", "f"), (5, "the " * 50000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred) for r in L.identify(docs, model).collect()]
    assert [d for d, p in got if p == "und"] == [1, 2, 3] and len(got) == 7
    assert dict(got)[5] == "en"
    assert L.identify(docs.limit(0), model).collect() == []


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12", "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.identify(docs, L.train(docs)).collect()] == ["und", "und"]


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i}", "en") for i in range(400)], "doc_id long, text string, lang string")
    import zlib
    train_ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert L.training_sample(docs, 10).count() == 10
    assert L.training_sample(docs, 1000).count() == len(train_ids)


def test_stage_drops_texts_without_a_language(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").limit(200)
    junk = spark.createDataFrame([(10**9, "12 34", "en", "s", 5), (10**9 + 1, None, None, None, None)], docs.schema)
    out = L.drop_undetermined(spark, docs.unionByName(junk), "")
    assert out.columns == docs.columns and out.count() == 200


def test_stage_keeps_texts_when_no_language_is_learnt(spark):
    rows = [(1, "some text", None), (2, "12 34", None), (3, None, None), (4, "\u65e5\u672c", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in L.drop_undetermined(spark, docs, "").collect()) == [1, 4]
    held = spark.createDataFrame([(5, "some text", "en"), (1, "other text", None)], docs.schema)
    assert L.train(held).langs == []
    assert L.drop_undetermined(spark, held, "").count() == 2


def test_stage_fills_in_a_missing_language(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    out = {r.doc_id: r for r in L.drop_undetermined(spark, hidden, SF_CHECK).collect()}
    true = {r.doc_id: r.lang for r in docs.collect() if r.doc_id in out and r.lang}
    assert all(out[d].lang == lang for d, lang in true.items() if d % 7)
    filled = [out[d].lang == lang for d, lang in true.items() if d % 7 == 0]
    assert len(filled) > 50 and sum(filled) / len(filled) > 0.95
