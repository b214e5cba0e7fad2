"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webweft.session import cut_lineage

# One of four crc32 classes of the doc_id is held out of every fit.
FOLDS, HELD_OUT_FOLD = 4, 2
# Rows of one Arrow batch: texts may be very long, so batches stay short.
ARROW_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for rows whose crc32 of the decimal doc_id has remainder 2 (null id: false)."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: survives lost executors."""
    return cut_lineage(df, f"llm/{name}")


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch, so a batch of long texts fits a Python worker.

    Lowers the session's ``maxRecordsPerBatch`` and never raises it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def smallest_hashes(rows: DataFrame, by: str, bound: Column) -> DataFrame:
    """Of each class ``by`` at most ``bound`` rows (by, h), those with the smallest hash ``h``.

    A class's size tells below which hash about twice as many rows lie; only those are
    sorted, so a task never gets more of a class than that.  There must be few classes."""
    sizes = F.broadcast(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")))
    place = F.col("h") / F.lit(float(1 << 64)) + 0.5
    low = rows.join(sizes, by).filter(place * F.col("_n") < bound * 2 + 50).drop("_n")
    nth = F.row_number().over(Window.partitionBy(by).orderBy("h"))
    return low.withColumn("_nth", nth).filter(F.col("_nth") <= bound).drop("_nth")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows in an Arrow batch for what runs inside, for tables of large rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def with_locator(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``_doc_at`` (file, row), the place of each row in its Parquet file.

    Rows that do not come straight from files are written to the shared folder first."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_doc_at")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if "_metadata" not in docs.columns:
        try:
            return docs.select(*columns, at)
        except AnalysisException:  # no hidden file columns: not a plain scan
            pass
    stored = materialise(docs.withColumnRenamed("_metadata", "_metadata_column"), "content")
    return stored.select("*", at).withColumnRenamed("_metadata_column", "_metadata")


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` without columns of these names (in any case), which are renamed, and the
    select list that gives the columns of ``docs`` back."""
    taken = {n.lower() for n in names}
    used = {c.lower() for c in docs.columns} | taken
    columns, back = [], []
    for c in docs.columns:
        name = c
        while name.lower() in taken or (name != c and name.lower() in used):
            name += "_"
        used.add(name.lower())
        columns.append(F.col(f"`{c}`").alias(name))
        back.append(F.col(f"`{name}`").alias(c))
    return (docs.select(*columns) if any(c.lower() in taken for c in docs.columns) else docs), back
