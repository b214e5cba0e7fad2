"""Documents to packed training sequences.

language ID -> exact dedup -> SimHash near-dedup -> secret redaction -> packing.
Each stage reads the table that the one before wrote and works on every row of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webweft.llm.exact_dedup import drop_copies
from webweft.llm.language_id import drop_undetermined
from webweft.llm.packing import pack_documents
from webweft.llm.secrets import redact
from webweft.llm.simhash import drop_near_copies
from webweft.session import work_path

STAGES = [
    ("language_id", drop_undetermined),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact),
    ("packing", pack_documents),
]

# A trained classifier and token ids are not SQL: tests/llm/test_pipeline.py checks the
# rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, "pipeline", name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
