"""Driver tables (Parquet) and the fixed schemas of our own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """``read_table`` for work that costs far more than reading: a table of fewer files than
    cores is dealt out by ``key`` first."""
    table = read_table(spark, sf_dir, name)
    return table if len(table.inputFiles()) >= spark.sparkContext.defaultParallelism else table.repartition(key)


def read_pages(spark: SparkSession, sf_dir: str, min_partitions: int | None = None) -> DataFrame:
    """Raw page source.  Pages arrive in few, large files; callers that parse
    HTML spread them with ``spread_pages`` first."""
    return read_table(spark, sf_dir, "pages")


def spread_pages(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin repartition before the Python HTML pass so every core gets
    work (the driver files arrive as one or two row groups)."""
    n = partitions or max(df.sparkSession.sparkContext.defaultParallelism * 2, 8)
    return df.repartition(n)


CRAWL_RECORD = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html_hash", T.StringType()),
    T.StructField("context_hash", T.StringType()),
    T.StructField("markdown_content", T.StringType()),
    T.StructField("cleaned_markdown", T.StringType()),
    T.StructField("cleaned_html", T.StringType()),
    T.StructField("metadata_json", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("fetch_tier", T.StringType()),
    T.StructField("stability_count", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("completed_at", T.TimestampNTZType()),
    T.StructField("last_accessed_at", T.TimestampNTZType()),
])

CRAWL_STATISTIC = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("crawl_record_id", T.LongType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("cache_hit_count", T.IntegerType()),
    T.StructField("prompt_tokens", T.IntegerType()),
    T.StructField("completion_tokens", T.IntegerType()),
    T.StructField("total_tokens", T.IntegerType()),
    T.StructField("reasoning_tokens", T.IntegerType()),
    T.StructField("cache_hit_tokens", T.IntegerType()),
    T.StructField("cache_miss_tokens", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

DOMAIN_REPUTATION = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("consecutive_failures", T.IntegerType()),
    T.StructField("total_failures", T.IntegerType()),
    T.StructField("blocked_until", T.TimestampNTZType()),
    T.StructField("last_failure_at", T.TimestampNTZType()),
    T.StructField("last_success_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

# Page metadata (15 optional fields) in the build's snake_case.
METADATA_FIELDS = ["title", "description", "language", "keywords", "robots", "robots_txt",
                   "og_title", "og_description", "og_url", "og_image", "og_locale_alternate",
                   "og_site_name", "source_url", "status_code", "content_type"]
METADATA = T.StructType([
    T.StructField(f, T.IntegerType() if f == "status_code" else T.StringType())
    for f in METADATA_FIELDS
])

CACHE_ENTRY = T.StructType([
    T.StructField("prefix", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("expires_at", T.TimestampNTZType()),
])
