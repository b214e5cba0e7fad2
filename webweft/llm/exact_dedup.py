"""Exact dedup: a stateful stream with disk-backed keyed state and no expiry.

Documents are equal when their texts are identical after deleting ASCII white
space.  A stream of (digest, stable id, content locator) rows feeds a keyed
state in RocksDB; the state keeps, for each SHA-256 digest, the group's size and
the retained document: its stable identifier and the locator (file, row) of its
content.  Digests that were hit more than once are checked on full bytes: the
members' texts, read again at their locators, must all equal the retained one.
Digests that fail the check are regrouped on the text itself.

A digest that holds a third of all rows is combined in each task before it is
shuffled, in the state as in the byte check, so no task gets the whole group.

Defined results: null text counts as empty, so null, empty and blank texts are
one group.  Of equal texts the one with the most code points stays, then the
smallest doc_id (a null doc_id comes last), then the smallest locator, so exactly
one of repeated rows stays.  An empty table gives an empty result.  Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm.common import materialise, set_aside, table, with_locator
from webweft.session import work_path

WHITE = r"[\x20\x09-\x0D]+"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
# Digest rows of one micro-batch (about 100 bytes a document).
BATCH_BYTES = 4 << 30
FULL_BITS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, text, file, row) of every document."""
    return with_locator(docs.select("doc_id", "text")).select("doc_id", "text", "_doc_at.file", "_doc_at.row")


def fingerprints(content: DataFrame, digest_bits: int = FULL_BITS) -> DataFrame:
    """One digest row per document; ``digest_bits`` below 256 shortens the state's key."""
    norm = normalised(F.col("text"))
    sha = F.sha2(norm, 256)
    return content.select("doc_id", "file", "row", F.length(F.coalesce("text", F.lit(""))).alias("points"),
                          F.unhex(sha).alias("sha"),
                          F.unhex(F.substring(sha, 1, digest_bits // 4)).alias("digest"))


def _order() -> Column:
    """The retained row is the maximum: most code points, then smallest id, then smallest locator."""
    return F.struct("points", (-F.col("doc_id")).alias("neg_id"), (-F.col("row")).alias("neg_row"), "file")


def retained_state(rows: DataFrame) -> DataFrame:
    """Keyed state of a batch or stream of digest rows: group size and retained row."""
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(_order()).alias("best"))


def run_state_stream(spark: SparkSession, inbox: str, checkpoint: str, batch_bytes: int = BATCH_BYTES) -> None:
    """Feed every digest file of ``inbox`` that the state has not seen yet into the state.

    The state lives in RocksDB on the executors' disks, is saved to ``checkpoint``
    after each micro-batch and never expires; a later call goes on where the last ended."""
    schema = spark.read.parquet(inbox).schema
    rows = (spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(inbox))
    (retained_state(rows).writeStream.outputMode("update").format("noop")
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """RocksDB for the states that are run or read inside; small ones claim no disk ahead."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keyed state as a table: digest, n, best."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.digest", F.col("value.count").alias("n"), F.col("value.max").alias("best"))


def exact_dedup(spark: SparkSession, docs: DataFrame, digest_bits: int = FULL_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, sha, file, row for every row of ``docs``."""
    return dedup_located(spark, located(docs), digest_bits)


def dedup_located(spark: SparkSession, content: DataFrame, digest_bits: int = FULL_BITS) -> DataFrame:
    """``exact_dedup`` of documents that already carry their locator."""
    inbox, checkpoint = work_path(spark, "llm", "dedup_inbox"), work_path(spark, "llm", "dedup_state")
    fingerprints(content, digest_bits).write.parquet(inbox)
    rows = spark.read.parquet(inbox)
    if rows.isEmpty():
        groups = retained_state(rows)
    else:
        with disk_state(spark):
            run_state_stream(spark, inbox, checkpoint)
            groups = materialise(read_state(spark, checkpoint), "dedup_groups")
    hit = groups.filter("n > 1")
    members = _members(content, rows, hit)
    checks = materialise(byte_check(members), "dedup_checks")
    failed = checks.filter(~F.col("same"))
    out = _labelled(rows.join(groups, "digest"))
    if failed.isEmpty():
        return out
    # a digest shared by different texts: group those members by the text itself
    bad = members.join(failed.select("digest"), "digest")
    exact = bad.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"), F.max(_order()).alias("best"))
    return (_labelled(rows.join(groups, "digest").join(failed.select("digest"), "digest", "left_anti"))
            .unionByName(_labelled(bad.drop("points", "best").join(exact, ["digest", "norm"]))))


def _members(content: DataFrame, rows: DataFrame, hit: DataFrame) -> DataFrame:
    """The rows of every hit digest with their normalised texts, read again at their locators."""
    wanted = rows.join(hit.select("digest", "best"), "digest")
    return (content.select("file", "row", "text")
            .join(wanted.hint("shuffle_hash"), ["file", "row"])
            .select("digest", "doc_id", "file", "row", "points", "sha", "best",
                    normalised(F.col("text")).alias("norm")))


def byte_check(members: DataFrame) -> DataFrame:
    """Per hit digest: whether all members have the same bytes as the retained one.

    Least and greatest text are combined in each task before the shuffle."""
    at_locator = (F.col("best.file") == F.col("file")) & (F.col("best.neg_row") == -F.col("row"))
    return (members.groupBy("digest")
            .agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"), F.count_if(at_locator).alias("retained"))
            .select("digest", ((F.col("lo") == F.col("hi")) & (F.col("retained") == 1)).alias("same")))


def _labelled(rows: DataFrame) -> DataFrame:
    is_best = (F.col("best.file") == F.col("file")) & (F.col("best.neg_row") == -F.col("row"))
    return rows.select("doc_id", (-F.col("best.neg_id")).alias("keep_id"), F.col("n").alias("group_size"),
                       is_best.alias("kept"), "sha", "file", "row")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the retained document of every group, with its columns."""
    apart, back = set_aside(docs, "_doc_at")
    full = with_locator(apart)
    content = full.select("doc_id", "text", "_doc_at.file", "_doc_at.row")
    dropped = dedup_located(spark, content).filter(~F.col("kept")).select(F.struct("file", "row").alias("_doc_at"))
    return full.join(dropped.hint("shuffle_hash"), "_doc_at", "left_anti").select(*back)


SQL = {"op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER w = 1 AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY points DESC, doc_id)
"""}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
