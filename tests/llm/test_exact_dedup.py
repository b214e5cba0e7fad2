import hashlib
import re

import pytest
from pyspark.sql import functions as F

from webweft.llm import exact_dedup as D
from webweft.session import work_path

SCHEMA = "doc_id long, text string"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d))
    out = []
    for d, t in rows:
        g = groups[norm(t)]
        keep = min(g)[1]
        out.append((d, keep, len(g), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, **kw):
    out = D.exact_dedup(spark, spark.createDataFrame(rows, SCHEMA), **kw)
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.sha.hex()) for r in out.collect())


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n\t\x0b\x0c\r"), (7, "é\x85x"), (8, "éx"), (9, "A b"),
        (10, "𝄞 y"), (11, "𝄞y "), (12, "long " * 30000), (13, "long" * 30000), (14, "one"), (15, "a\x1cb")]


def test_matches_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_hot_group_over_many_partitions(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(16)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.sha.hex()) for r in D.exact_dedup(spark, docs).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("bits", [4, 8])
def test_byte_check_parts_texts_that_share_a_digest(spark, bits):
    """A digest of a few bits collides for most texts: the full bytes must tell them apart."""
    rows = ROWS + [(100 + i, f"text number {i % 40}") for i in range(120)]
    assert run(spark, rows, digest_bits=bits) == brute(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "x y", "f", 1), (1, "x y", "f", 2), (None, "x  y", "g", 3), (None, "z", "h", 4), (2, "zz", "i", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, row int")
    out = D.exact_dedup(spark, docs).collect()
    assert sum(r.kept for r in out) == 3 and {r.group_size for r in out if r.keep_id is None and r.kept} >= {1}
    kept = D.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert got == [("2", "zz"), ("None", "x  y"), ("None", "z")]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_state_goes_on_over_later_documents(spark):
    inbox, checkpoint = work_path(spark, "t", "inbox"), work_path(spark, "t", "state")

    def arrive(rows):
        content = D.located(spark.createDataFrame(rows, SCHEMA))
        D.fingerprints(content).write.mode("append").parquet(inbox)
        with D.disk_state(spark):
            D.run_state_stream(spark, inbox, checkpoint)
            return {r.digest.hex(): (r.n, -r.best.neg_id) for r in D.read_state(spark, checkpoint).collect()}
    key = hashlib.sha256(b"xy").hexdigest()
    assert arrive([(5, "xy"), (6, "q")])[key] == (1, 5)
    later = arrive([(7, "x y"), (3, "xy"), (8, "new")])
    assert later[key] == (3, 7) and len(later) == 3


def test_state_settings_are_put_back(spark):
    before = {k: spark.conf.get(k, None) for k in D.STATE_CONF}
    run(spark, [(1, "a"), (2, "a")])
    assert {k: spark.conf.get(k, None) for k in D.STATE_CONF} == before


def test_locator_names_the_row_of_a_file(spark):
    path = work_path(spark, "t", "content")
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(path)
    got = D.located(spark.read.parquet(path)).orderBy("row").collect()
    assert [r.row for r in got] == list(range(len(ROWS))) and all(path.removeprefix("file:") in r.file for r in got)
    assert [r.doc_id for r in got] == [d for d, _ in ROWS]
    assert D.located(spark.createDataFrame(ROWS, SCHEMA).filter(F.col("doc_id") > 9)).count() == 6


def test_stage_keeps_columns_with_the_names_it_uses(spark):
    docs = spark.createDataFrame([(1, "same text here", 5), (2, "same text here", 6)], "doc_id long, text string, _DOC_AT int")
    out = D.drop_copies(spark, docs, "")
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "same text here", 5)]
