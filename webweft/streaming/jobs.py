"""Structured Streaming forms of the background work.

All sources are file sources (append-only event tables in the shared
folder); every query has its own checkpoint location, so a restarted or
retried micro-batch resumes where it stopped.  Sinks are idempotent: a
micro-batch writes under its own ``batch_id`` (overwrite), so a replay never
adds twice.  Keyed state is a table in buckets with snapshots and deltas: a
micro-batch is summarised per key with partial aggregates, and the summaries are
merged into the keys' rows.
Micro-batches are assumed to arrive in time order (an append-ordered log).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webweft.operators import records as rec_ops
from webweft.operators.reputation import outcomes as outcome_events
from webweft.operators.reputation import reputation_merge
from webweft.session import cut_lineage

# --- sources -------------------------------------------------------------------------------


def staged_slices(df: DataFrame, path: str, order_col: str, slices: int = 4) -> list[str]:
    """``df`` written once, in ``slices`` folders of successive ranges of ``order_col``
    (rows without one are in the first); each folder has a file per task and range."""
    lo, hi = df.agg(F.min(order_col), F.max(order_col)).first()
    number = F.lit(0)
    if lo is not None and hi is not None and hi > lo:
        step = (hi - lo) / slices
        for i in range(1, slices):
            number = F.when(F.col(order_col) >= _lit_like(lo + step * i), F.lit(i)).otherwise(number)
    df.withColumn("_slice", number).write.partitionBy("_slice").parquet(path)
    return [f"{path}/_slice={i}" for i in range(slices)]


def _lit_like(v):
    """Literal for a bound read back from the data: wall-clock times become
    ``timestamp_ntz`` literals (a Python datetime literal would be read in
    the session time zone and shift the bound)."""
    if isinstance(v, datetime):
        return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(v)


def run_in_slices(df: DataFrame, path: str, order_col: str, start: Callable[[DataFrame], object], slices: int = 4) -> None:
    """Let the slices of a table arrive one after the other in a source folder, and run
    ``start(stream)`` (an ``availableNow`` query with one checkpoint) after each."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(f"{path}/source")
    fs = source.getFileSystem(conf)
    fs.mkdirs(source)
    for i, folder in enumerate(staged_slices(df, f"{path}/staged", order_col, slices)):
        staged = jvm.org.apache.hadoop.fs.Path(folder)
        if fs.exists(staged):
            fs.rename(staged, jvm.org.apache.hadoop.fs.Path(f"{path}/source/part-{i}"))
            start(spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{path}/source"))


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1) -> DataFrame:
    """Append-only event folder as a stream; ``maxFilesPerTrigger`` bounds a
    micro-batch (T4)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


OUTCOME_EVENTS = "domain string, ok boolean, ts timestamp_ntz, event_id long"
HIT_EVENTS = "url string"


def publish_events(outcomes: DataFrame, hits: DataFrame, root: str, batch: int) -> None:
    """Hand a scrape batch's domain outcomes (X6) and hits (S8) to the streams that read
    ``root/outcomes`` (R2) and ``root/hits`` (R1): a folder per batch.

    A folder that is committed stays as it is, so a batch that is run again is not counted twice."""
    for name, events, schema in (("outcomes", outcome_events(outcomes), OUTCOME_EVENTS), ("hits", hits, HIT_EVENTS)):
        if batch not in committed(events.sparkSession, f"{root}/{name}", "batch-"):
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)]
            events.select(*columns).write.mode("overwrite").parquet(f"{root}/{name}/batch-{batch:08d}")


def published_events(spark: SparkSession, root: str, name: str, max_files: int = 1000) -> DataFrame:
    """The stream of one kind of published events; ``max_files`` bounds a micro-batch."""
    schema = {"outcomes": OUTCOME_EVENTS, "hits": HIT_EVENTS}[name]
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("recursiveFileLookup", "true").parquet(f"{root}/{name}"))


def _run(writer, available_now: bool, processing_time: str | None):
    if available_now:
        q = writer.trigger(availableNow=True).start()
    else:
        q = writer.trigger(processingTime=processing_time or "60 seconds").start()
    if available_now:
        q.awaitTermination()
    return q


# --- R1: cache-hit flush -----------------------------------------------------------------------

def hit_flush_stream(hits: DataFrame, records: DataFrame, stats: DataFrame, sink: str, checkpoint: str,
                     available_now: bool = True, processing_time: str = "60 seconds"):
    """Every trigger, A1 → W1 (F7) → W2 → deltas, written under
    ``sink/batch_id=<id>`` (overwrite: replays are idempotent).  Read the
    counters with ``rec_ops.apply_hit_deltas(stats, spark.read.parquet(sink))``."""
    def flush(batch: DataFrame, batch_id: int):
        deltas = rec_ops.flush_hits(batch, records, stats)
        deltas.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    w = hits.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return _run(w, available_now, processing_time)


# --- keyed state as a table ---------------------------------------------------------------------
#
# A state table is a folder with
#   base/v=<batch>/bucket=<b>/   snapshots: the row of every key as of that batch,
#   delta/batch_id=<n>/bucket=<b>/   the new rows of the keys that batch n met.
# The commit of a folder (its _SUCCESS file) makes it count.  A micro-batch reads the buckets
# that its keys fall into, of the newest snapshot before it and of the deltas since; every
# ``compact_every`` batches these are folded into a new snapshot, so what a trigger reads does
# not grow with the number of batches before it.  Folders that no batch to come can read
# are deleted.

BUCKETS, COMPACT_EVERY = 64, 8
SNAPSHOT_DONE = "_SUCCESS"


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def committed(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """Numbers of the finished folders ``<prefix><number>``, in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(conf)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix)
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/{SNAPSHOT_DONE}")))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class KeyedState:
    """A state table of one row per key, in buckets of the key's hash."""

    def __init__(self, root: str, key: str, schema: T.StructType, buckets: int = BUCKETS):
        self.root, self.key, self.buckets = root, key, buckets
        self.schema = schema
        self.stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])

    def parts(self, spark: SparkSession, before: int) -> list[tuple[int, str]]:
        """(batch, folder) of the newest snapshot and of the deltas since that count before a batch."""
        base = [v for v in committed(spark, f"{self.root}/base", "v=") if v < before]
        since = base[-1] if base else -1
        deltas = [d for d in committed(spark, f"{self.root}/delta", "batch_id=") if since < d < before]
        return ([(since, f"{self.root}/base/v={since}")] if base else []) + [(d, f"{self.root}/delta/batch_id={d}") for d in deltas]

    def rows(self, spark: SparkSession, before: int, buckets: list[int] | None = None) -> DataFrame:
        """The row of each key as of the batches before ``before``, of some buckets or of all."""
        read = [spark.read.schema(self.stored).parquet(path).withColumn("_batch", F.lit(batch))
                for batch, path in self.parts(spark, before)]
        if not read:
            return spark.createDataFrame([], self.schema)
        both = read[0]
        for df in read[1:]:
            both = both.unionByName(df)
        if buckets is not None:  # a partition column: other buckets' files are not read
            both = both.filter(F.col("bucket").isin(buckets))
        return rec_ops.latest_by(both.drop("bucket"), self.key, "_batch").drop("_batch").select(*self.schema.names)

    def current(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark, 1 << 62)

    def write(self, rows: DataFrame, folder: str) -> None:
        (rows.withColumn("bucket", _bucket(self.key, self.buckets)).repartition("bucket").write.mode("overwrite")
         .partitionBy("bucket").parquet(f"{self.root}/{folder}"))

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets that a batch's keys fall into (at most ``buckets`` numbers)."""
        return sorted(r[0] for r in batch.select(_bucket(self.key, self.buckets)).distinct().collect())

    def compact(self, spark: SparkSession, batch_id: int) -> None:
        """Snapshot as of a batch.  The one before stays, in case the batch is run again."""
        self.write(self.rows(spark, batch_id + 1), f"base/v={batch_id}")
        keep = [v for v in committed(spark, f"{self.root}/base", "v=") if v < batch_id][-1:]
        for v in committed(spark, f"{self.root}/base", "v="):
            if v < batch_id and v not in keep:
                _delete(spark, f"{self.root}/base/v={v}")
        for d in committed(spark, f"{self.root}/delta", "batch_id="):
            if keep and d <= keep[-1]:
                _delete(spark, f"{self.root}/delta/batch_id={d}")


def keyed_state_stream(stream: DataFrame, state: KeyedState, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
                       available_now: bool, processing_time: str, compact_every: int = COMPACT_EVERY):
    """Run ``merge(state, batch)`` on every micro-batch; its rows are the new state of the batch's keys.

    The state before a batch comes from snapshots and deltas of earlier batches only, so
    a batch that is run again writes the same rows again."""
    def update(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        held = state.rows(spark, batch_id, state.touched(batch))
        state.write(merge(held, batch), f"delta/batch_id={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            state.compact(spark, batch_id)

    return _run(stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint), available_now, processing_time)


# --- R2: live reputation --------------------------------------------------------------------

REPUTATION_STATE = ("domain string, consecutive_failures int, total_failures int, blocked_until timestamp_ntz, "
                    "last_failure_at timestamp_ntz, last_success_at timestamp_ntz, updated_at timestamp_ntz")


def reputation_state(sink: str, buckets: int = BUCKETS) -> KeyedState:
    return KeyedState(sink, "domain", T.StructType.fromDDL(REPUTATION_STATE), buckets)


def reputation_stream(outcomes: DataFrame, sink: str, checkpoint: str, available_now: bool = True,
                      processing_time: str = "60 seconds", compact_every: int = COMPACT_EVERY):
    """R2: each micro-batch is summarised per host and merged into the reputations.
    Batches of a host must come in time order."""
    return keyed_state_stream(outcomes, reputation_state(sink), checkpoint, reputation_merge, available_now, processing_time,
                              compact_every)


# --- R3: live stability -----------------------------------------------------------------------

STABILITY_STATE = "url string, n_crawls long, last_hash string, stability_count int"


def stability_state(sink: str, buckets: int = BUCKETS) -> KeyedState:
    return KeyedState(sink, "url", T.StructType.fromDDL(STABILITY_STATE), buckets)


def stability_stream(crawls: DataFrame, sink: str, checkpoint: str, available_now: bool = True,
                     processing_time: str = "60 seconds", compact_every: int = COMPACT_EVERY):
    """Each micro-batch is summarised per URL and merged into (last hash, stability)."""
    return keyed_state_stream(crawls, stability_state(sink), checkpoint, rec_ops.stability_merge, available_now, processing_time,
                              compact_every)


# --- R4: request de-duplication within a TTL ---------------------------------------------------

DEDUP_ROWS = "request_id long, context_hash string, does_work boolean, until timestamp_ntz"


def _hour(at):
    """Hours since 1970 of a wall-clock time."""
    return F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at) / 3600).cast("int")


def _hours(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    return [int(n[5:]) for n in names if n.startswith("hour=")]


def first_requests(requests: DataFrame, held: DataFrame, ttl_minutes: float) -> DataFrame:
    """Which requests of one batch do the work: the first of a hash (by time, then id), and
    the first one after each answer's time is over.

    ``held`` has (context_hash, until) of earlier work.  The chain of a hash is followed in
    rounds of partial aggregates: each round takes every hash's first request behind its time,
    so a batch takes as many rounds as the longest chain has links (its span over the TTL).
    Each round reads ``requests`` and the round before it, both dealt out by hash: a row per
    hash is too much to go through the driver in every round."""
    if ttl_minutes <= 0:  # no answer would ever hold: a chain would take one request a round
        raise ValueError("the time to live must be positive")
    ttl = F.make_interval(secs=F.lit(ttl_minutes * 60).cast("decimal(18,6)"))
    until = held.groupBy("context_hash").agg(F.max("until").alias("until"))
    requests = requests.filter("ts is not null")
    rest = requests.join(until.hint("merge"), "context_hash", "left").filter(F.col("until").isNull() | (F.col("ts") >= F.col("until")))
    worked = None
    while True:
        first = rest.groupBy("context_hash").agg(F.min(F.struct("ts", "request_id")).alias("f"))
        found = cut_lineage(first.select("context_hash", F.col("f.request_id").alias("request_id"), (F.col("f.ts") + ttl).alias("until")), "dedup")
        worked = found if worked is None else worked.unionByName(found)
        if found.isEmpty():
            return worked
        # times of a chain only grow, so the round before alone tells what is left of all requests
        rest = requests.join(found.select("context_hash", "until").hint("merge"), "context_hash").filter(F.col("ts") >= F.col("until"))


def dedup_stream(requests: DataFrame, ttl_minutes: float, sink: str, checkpoint: str,
                 available_now: bool = True, processing_time: str = "10 seconds"):
    """The first request (request_id, context_hash, ts) per hash does the work; later ones
    within the TTL of its time are answered from the cache.

    Times are the requests' own, so a batch that is run again writes the same rows.  The
    answers go to ``sink/rows/batch_id=<id>``; the working ones also to
    ``sink/held/batch_id=<id>/hour=<h>``, by the hour in which their time is over.  A batch
    reads only hours that are not over at its earliest request, and folders whose hours
    are all over by then are deleted.  Batches must come in time order.  A request without
    a time does its own work and is no answer for others."""
    schema = T.StructType.fromDDL("context_hash string, until timestamp_ntz, batch_id long, hour int")

    def update(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        now = batch.agg(_hour(F.min("ts"))).first()[0]
        live = []
        for d in committed(spark, f"{sink}/held", "batch_id="):
            folder = f"{sink}/held/batch_id={d}"
            if d < batch_id and (now is None or max(_hours(spark, folder), default=-1) >= now):
                live.append(folder)
            elif d < batch_id:
                _delete(spark, folder)  # all its answers' times were over before this batch
        held = spark.createDataFrame([], schema)
        if live:
            held = spark.read.schema(schema).option("basePath", f"{sink}/held").parquet(*live)
        if now is not None:
            held = held.filter(F.col("hour") >= now)
        requests = batch.select("request_id", "context_hash", "ts")
        working = cut_lineage(first_requests(requests, held, ttl_minutes), "dedup_work")
        out = requests.join(working.hint("merge"), ["context_hash", "request_id"], "left")
        (out.select("request_id", "context_hash", (F.col("until").isNotNull() | F.col("ts").isNull()).alias("does_work"), "until")
         .write.mode("overwrite").parquet(f"{sink}/rows/batch_id={batch_id}"))
        (working.select("context_hash", "until", _hour(F.col("until")).alias("hour"))
         .write.mode("overwrite").partitionBy("hour").parquet(f"{sink}/held/batch_id={batch_id}"))

    return _run(requests.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint), available_now, processing_time)


def dedup_answers(spark: SparkSession, sink: str) -> DataFrame:
    """What the de-duplication stream answered, with its batch."""
    return spark.read.schema(DEDUP_ROWS + ", batch_id long").parquet(f"{sink}/rows")


def dedup_within_watermark(requests: DataFrame, ttl: str = "60 minutes") -> DataFrame:
    """R4, event-time option: Spark's ``dropDuplicatesWithinWatermark``."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["context_hash"])


# --- R5: periodic blocklist refresh ------------------------------------------------------------

def refresh_rules(spark: SparkSession, lines: DataFrame, snapshot_root: str,
                  load: Callable[[DataFrame], DataFrame]) -> str:
    """Build a new rule snapshot; with no block rule the old one stays.

    Snapshots are numbered folders.  A reader takes the highest number whose
    write has been committed, so the switch is the commit of the new folder,
    and a failed read of the old rules fails the refresh instead of passing
    for a first load."""
    from webweft.operators.blocklist import swap_snapshot
    done = committed_snapshots(spark, snapshot_root)
    old = spark.read.parquet(f"{snapshot_root}/snap-{done[-1]:08d}") if done else None
    merged = swap_snapshot(old, load(lines))
    if old is not None and merged is old:
        return f"{snapshot_root}/snap-{done[-1]:08d}"
    path = f"{snapshot_root}/snap-{(done[-1] + 1 if done else 0):08d}"
    merged.write.mode("overwrite").parquet(path)
    return path


def committed_snapshots(spark: SparkSession, snapshot_root: str) -> list[int]:
    """Numbers of the finished snapshots, in order."""
    return committed(spark, snapshot_root, "snap-")


def current_rules(spark: SparkSession, snapshot_root: str) -> DataFrame:
    return spark.read.parquet(f"{snapshot_root}/snap-{committed_snapshots(spark, snapshot_root)[-1]:08d}")


# --- R6: after-search actions ------------------------------------------------------------------

def after_search_stream(results: DataFrame, actions: Sequence[tuple[int, bool, Callable[[DataFrame, int], None]]],
                        checkpoint: str, available_now: bool = True, processing_time: str = "10 seconds",
                        on_error: Callable[[Exception], None] | None = None):
    """``actions`` are ``(order, synchronous, fn(df, batch_id))``, run in
    order on the raw results of each micro-batch.  A failing best-effort
    action is reported and skipped; a failing synchronous one fails the batch
    (and Spark retries it from the checkpoint)."""
    ordered = sorted(actions, key=lambda a: a[0])

    def run(batch: DataFrame, batch_id: int):
        for _, sync, fn in ordered:
            if sync:
                fn(batch, batch_id)
            else:
                try:
                    fn(batch, batch_id)
                except Exception as e:  # noqa: BLE001
                    if on_error:
                        on_error(e)

    w = results.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _run(w, available_now, processing_time)
