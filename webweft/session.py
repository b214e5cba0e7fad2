"""Session construction and shared work folders.

Library code never creates its own session: every operator takes and returns
DataFrames. ``build_session`` is for tests, the bench and local runs; on a
cluster the caller's session (and its ``spark.checkpoint.dir``) is used as is.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for the plans in this package.  AQE is on so shuffles
# coalesce at small scale and skewed hosts are split at large scale.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages can be large; keep Arrow batches for the HTML pass small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # Broadcast only small, size-checked sides (rule tables, reputations).
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "webweft") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only on a ``local`` master, where driver
    and executors are one process, a private folder is made when nothing is
    configured; on any other master executors could not see each other's files,
    so a missing setting is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    local = local_work_folder(sc.master)
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def local_work_folder(master: str) -> str:
    """A private folder for a one-process master; refused for any other."""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {master!r}")
    return tempfile.mkdtemp(prefix="webweft-ckpt-")


def work_root(spark: SparkSession) -> str:
    """This application's folder below the shared checkpoint folder."""
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), "webweft", spark.sparkContext.applicationId])


def work_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path in the application's shared folder (for snapshots,
    streaming sources/sinks and checkpoints)."""
    return "/".join([work_root(spark), *parts, uuid.uuid4().hex])


def clear_work(spark: SparkSession) -> None:
    """Delete every table this application wrote to the shared folder.  Call it
    once no result that reads them is needed any more."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing a Parquet table into the shared checkpoint folder
    and reading it back: computed once (``Dataset.checkpoint`` computes its
    input twice unless cached), survives executor loss, and later plans scan
    it with column pruning."""
    path = work_path(df.sparkSession, "tables", name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
