"""Crawl records and statistics: stability fold (W4), content-hash lookup
(J7), keyed upsert (J8), latest rows (W1/W2), record→statistics (J9), hit
counts (A1) and the additive counter (A4)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webweft.functions.policy import CACHE_RESET_CAP, stability_reset
from webweft.session import cut_lineage


# --- W4 ---------------------------------------------------------------------------

RESET_CLASSES = CACHE_RESET_CAP  # values that a stability reset can take
BUCKET_MINUTES = 60      # time slice that splits a hot URL's history across tasks
FOLD_FANIN = 1024        # tables composed per group in the ordered fold


def time_bucket(ts, minutes: int) -> Column:
    """Bucket number of a wall-clock (``timestamp_ntz``) time; independent of
    the session time zone and monotonic in time."""
    c = F.col(ts) if isinstance(ts, str) else ts
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("MINUTE", epoch, c.cast("timestamp_ntz")) / F.lit(minutes)).cast("long")


def _bucket(ts: str, minutes: int) -> Column:
    return time_bucket(ts, minutes)


def crawl_runs(crawls: DataFrame, key: str = "url", hash_col: str = "html_hash",
               ts: str = "ts", tie: str = "event_id", bucket_minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Consecutive crawls with the same hash form one run: ``(key, run_no,
    run_len, first_ts, last_ts, hash)``.

    Skew-safe: windows run per (key, time bucket), never over a whole key;
    the carry between buckets (last hash, run offset) comes from per-bucket
    partial aggregates and a window over bucket rows (one row per bucket)."""
    c = crawls.select(key, hash_col, ts, tie, _bucket(ts, bucket_minutes).alias("_b"))
    wb = Window.partitionBy(key).orderBy("_b")
    last_b = (c.groupBy(key, "_b").agg(F.max_by(hash_col, F.struct(ts, tie)).alias("_bl"))
              .withColumn("_prev_bl", F.lag("_bl").over(wb)).drop("_bl"))
    w = Window.partitionBy(key, "_b").orderBy(ts, tie)
    c = c.join(last_b, [key, "_b"])
    prev = F.coalesce(F.lag(hash_col).over(w), F.col("_prev_bl"))
    c = c.withColumn("_new", F.when(prev.isNull() | (prev != F.col(hash_col)), 1).otherwise(0)).drop("_prev_bl")
    offs = (c.groupBy(key, "_b").agg(F.sum("_new").alias("_nb"))
            .withColumn("_off", F.coalesce(F.sum("_nb").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                                           F.lit(0))).drop("_nb"))
    c = c.join(offs, [key, "_b"]).withColumn(
        "run_no", (F.col("_off") + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))
    return c.groupBy(key, "run_no").agg(F.count(F.lit(1)).cast("int").alias("run_len"),
                                        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                                        F.max_by(hash_col, F.struct(ts, tie)).alias(hash_col))


def fold_stability(run_lengths: Column) -> Column:
    """Sequential fold over one (short) array of run lengths: the first run
    gives its length, every later run ``reset(s) + len - 1``."""
    first = F.element_at(run_lengths, 1)
    rest = F.slice(run_lengths, 2, 1 << 30)
    return F.aggregate(rest, first, lambda s, ln: stability_reset(s) + ln - 1)


def _transfer(run_len: Column) -> Column:
    """A middle run as a map over the six reset classes: r → reset(r + len - 1)."""
    return F.transform(F.sequence(F.lit(1), F.lit(RESET_CLASSES)), lambda r: stability_reset(r + run_len - 1))


def _compose(tables: Column) -> Column:
    """Compose transfer tables in array order (identity for an empty array)."""
    ident = F.sequence(F.lit(1), F.lit(RESET_CLASSES))
    return F.aggregate(tables, ident, lambda acc, t: F.transform(acc, lambda x: F.element_at(t, x)))


def stability_summary(crawls: DataFrame, key: str = "url", hash_col: str = "html_hash",
                      fanin: int = FOLD_FANIN) -> DataFrame:
    """What W4 needs of a key's crawls, whatever its count was before them: the first
    run, the middle runs composed to one table, and the last run.

    The fold ``s → reset(s) + len - 1`` only depends on ``reset(s)``, so each middle
    run is a table over the reset classes and tables compose associatively in run
    order.  They are composed in groups of at most ``fanin`` (ordered, bounded
    ``collect_list``), level by level, so no task holds a key's whole history."""
    # one row per run, read three times below: computed once into the shared folder
    runs = cut_lineage(crawl_runs(crawls, key, hash_col), "runs")
    per_key = runs.groupBy(key).agg(
        F.max("run_no").cast("int").alias("n_runs"), F.sum("run_len").cast("long").alias("n_crawls"),
        F.min_by(hash_col, "run_no").alias("first_hash"), F.max_by(hash_col, "run_no").alias("last_hash"),
        F.max("last_ts").alias("last_crawl_at"), F.min_by("run_len", "run_no").alias("first_len"),
        F.max_by("run_len", "run_no").alias("last_len"))
    # the last run of a key goes by a join on key and run, so the runs of a hot key stay spread
    last = per_key.select(key, F.col("n_runs").cast(runs.schema["run_no"].dataType).alias("run_no"))
    mids = (runs.filter(F.col("run_no") > 1).join(last, [key, "run_no"], "left_anti")
            .select(key, (F.col("run_no") - 2).cast("long").alias("_i"), _transfer(F.col("run_len")).alias("_t")))
    max_mid = per_key.agg(F.max("n_runs")).first()[0] or 0
    span = 1
    while span < max(max_mid - 2, 1):
        span *= fanin
        mids = (mids.groupBy(key, F.floor(F.col("_i") / fanin).cast("long").alias("_i"))
                .agg(F.sort_array(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_t").alias("t"))))
                     .alias("_ts"))
                .select(key, "_i", _compose(F.col("_ts.t")).alias("_t")))
    if span == 1:  # at most one middle run per key
        mids = mids.groupBy(key).agg(F.first("_t").alias("_t"))
    return per_key.join(mids.select(key, F.col("_t").alias("middle")), key, "left")


def _count_after(first: Column) -> Column:
    """Stability after a summary's runs, given the count after its first run."""
    r0 = stability_reset(first)
    r = F.coalesce(F.element_at(F.col("middle"), r0), r0)
    return F.when(F.col("n_runs") == 1, first).otherwise(r + F.col("last_len") - 1).cast("int")


def stability(crawls: DataFrame, key: str = "url", hash_col: str = "html_hash",
              fanin: int = FOLD_FANIN) -> DataFrame:
    """Stability count per key after all crawls."""
    out = stability_summary(crawls, key, hash_col, fanin)
    return out.select(key, "n_crawls", "n_runs", "last_hash", "last_crawl_at",
                      _count_after(F.col("first_len")).alias("stability_count"))


def stability_merge(snapshot: DataFrame, crawls: DataFrame, key: str = "url", hash_col: str = "html_hash") -> DataFrame:
    """W4 on a stored snapshot (key, n_crawls, last_hash, stability_count) and later
    crawls, for the keys of the crawls: a first run of the stored hash goes on with it."""
    s = snapshot.select(F.col(key).alias("_key"), F.col("n_crawls").alias("_n"), F.col("last_hash").alias("_hash"),
                        F.col("stability_count").alias("_s"))
    j = stability_summary(crawls, key, hash_col).join(s, F.col(key) == F.col("_key"), "left")
    first = (F.when(F.col("_s").isNull(), F.col("first_len"))
             .when(F.col("_hash") == F.col("first_hash"), F.col("_s") + F.col("first_len"))
             .otherwise(stability_reset(F.col("_s")) + F.col("first_len") - 1))
    return j.select(key, (F.coalesce("_n", F.lit(0)) + F.col("n_crawls")).alias("n_crawls"), "last_hash",
                    _count_after(first).alias("stability_count"))


# --- W1 / W2 / J9 ------------------------------------------------------------------

def latest_by(df: DataFrame, key: str, order: str = "id") -> DataFrame:
    """Highest ``order`` row per key as a partial (map-side) aggregate of
    ``max(struct(order, ...))``: skew-safe, no full sort of a hot key."""
    cols = [c for c in df.columns if c not in (key,)]
    rest = [c for c in cols if c != order]
    m = df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_m"))
    return m.select(key, *[F.col(f"_m.{c}").alias(c) for c in [order, *rest]])


def latest_ai_record(records: DataFrame) -> DataFrame:
    """W1 + F7: latest record with AI Markdown per URL."""
    return latest_by(records.filter(F.col("cleaned_markdown").isNotNull()), "url", "id")


def latest_statistic(stats: DataFrame) -> DataFrame:
    """Latest statistic per record."""
    return latest_by(stats, "crawl_record_id", "id")


def record_statistics(records: DataFrame, stats: DataFrame) -> DataFrame:
    """Record → its statistics (1:N)."""
    s = stats.withColumnRenamed("id", "stat_id").withColumnRenamed("created_at", "stat_created_at")
    return records.join(s, records["id"] == s["crawl_record_id"], "inner").drop("crawl_record_id")


# --- J7 / J8 -----------------------------------------------------------------------

def hash_lookup(batch: DataFrame, records: DataFrame, url: str = "url",
                hash_col: str = "html_hash") -> DataFrame:
    """Lowest record id with the same URL and hash (unchanged page), or null."""
    keyed = records.groupBy(F.col("url").alias("_u"), F.col("html_hash").alias("_h")).agg(
        F.min("id").alias("same_hash_id"))
    out = batch.join(keyed, (batch[url] == keyed["_u"]) & (batch[hash_col] == keyed["_h"]), "left")
    return out.drop("_u", "_h")


def assign_ids(df: DataFrame, start: Column | int, order_cols: list[str]) -> DataFrame:
    """Durable new ids ``start + 1 ..`` in the order of ``order_cols``, without a
    single-partition window.

    The rows are dealt by range and written once with their place in the written
    partition; ids come from that table, so every later plan sees the same rows
    and numbers whatever its own partitions are.  Partitions are offset by the
    running count of those before them (one small row per partition)."""
    dealt = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    d = cut_lineage(dealt.withColumn("_place", F.monotonically_increasing_id()), "new_rows")
    d = d.withColumn("_pid", F.shiftright("_place", 33))
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn("_off", F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    offs = F.broadcast(offs.select("_pid", F.coalesce("_off", F.lit(0)).alias("_off")))
    start_c = start if isinstance(start, Column) else F.lit(start)
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (d.join(offs, "_pid").withColumn("id", (start_c + F.col("_off") + place).cast("long"))
            .drop("_pid", "_place", "_off"))


def one_per_url(batch: DataFrame, order: list[str]) -> DataFrame:
    """One row per URL, the least by ``order``: a partial aggregate, so a URL asked
    for many times is reduced in each task first."""
    rest = [c for c in batch.columns if c != "url"]
    least = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return batch.groupBy("url").agg(least).select("url", *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def upsert_records(records: DataFrame, batch: DataFrame, force_overwrite: bool = False,
                   new_ids: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """J8 (with the J7 branch): ``batch`` holds one crawl per URL with
    ``url, html_hash, ts`` and optional content columns.

    * a record with the same URL and hash → stability + 1, last access;
    * else the lowest-id record of the URL → overwrite hash and content,
      stability reset (P16), status Completed; an old error text is kept;
    * else insert with stability 1 and a new id above the current maximum.
    With ``force_overwrite`` the same-hash branch is skipped (a freshly
    cleaned page always overwrites the lowest-id record of its URL).
    Of several batch rows of one URL the earliest counts (ties: the least
    hash), so no record is matched twice.  Returns the new snapshot
    (untouched rows included).  ``new_ids(rows)`` adds ``id`` to new records."""
    batch = one_per_url(batch, ["ts", "html_hash"])
    content = [c for c in ("markdown_content", "cleaned_markdown", "cleaned_html", "metadata_json",
                           "context_hash", "fetch_tier") if c in batch.columns]
    b = batch.select("url", F.col("html_hash").alias("_nh"), F.col("ts").alias("_nts"),
                     *[F.col(c).alias("_n_" + c) for c in content])
    same = records.groupBy(F.col("url"), F.col("html_hash").alias("_nh")).agg(F.min("id").alias("_same_id"))
    first = records.groupBy("url").agg(F.min("id").alias("_first_id"))
    plan = b.join(same, ["url", "_nh"], "left").join(first, "url", "left")
    if force_overwrite:
        plan = plan.withColumn("_same_id", F.lit(None).cast("long"))
    plan = plan.withColumn("_target", F.coalesce("_same_id", "_first_id")).withColumn(
        "_kind", F.when(F.col("_same_id").isNotNull(), "same")
        .when(F.col("_first_id").isNotNull(), "changed").otherwise("new"))
    upd = plan.filter(F.col("_kind") != "new").drop("url")
    r = records.join(upd, F.col("id") == F.col("_target"), "left")
    kind = F.col("_kind")
    cols = []
    for c in records.columns:
        col = F.col(c)
        if c == "stability_count":
            col = (F.when(kind == "same", col + 1).when(kind == "changed", stability_reset(col))
                   .otherwise(col)).cast("int")
        elif c == "html_hash":
            col = F.when(kind == "changed", F.col("_nh")).otherwise(col)
        elif c == "status":
            col = F.when(kind == "changed", F.lit("Completed")).otherwise(col)
        elif c == "last_accessed_at":
            col = F.when(kind.isNotNull(), F.col("_nts")).otherwise(col)
        elif c == "completed_at":
            col = F.when(kind == "changed", F.col("_nts")).otherwise(col)
        elif c == "fetch_tier" and c in content:  # the tier of this fetch, changed page or not
            col = F.when(kind.isNotNull(), F.coalesce(F.col("_n_" + c), col)).otherwise(col)
        elif c in content:
            col = F.when(kind == "changed", F.col("_n_" + c)).otherwise(col)
        cols.append(col.alias(c))
    kept = r.select(*cols)
    ins = plan.filter(F.col("_kind") == "new")
    if new_ids is None:
        max_id = records.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
        ins = assign_ids(ins, max_id, ["url"])
    else:
        ins = new_ids(ins)
    new_cols = []
    for c in records.columns:
        if c == "id":
            new_cols.append(F.col("id"))
        elif c == "url":
            new_cols.append(F.col("url"))
        elif c == "html_hash":
            new_cols.append(F.col("_nh").alias(c))
        elif c == "status":
            new_cols.append(F.lit("Completed").alias(c))
        elif c == "stability_count":
            new_cols.append(F.lit(1).cast("int").alias(c))
        elif c in ("created_at", "completed_at", "last_accessed_at"):
            new_cols.append(F.col("_nts").alias(c))
        elif c in content:
            new_cols.append(F.col("_n_" + c).alias(c))
        else:
            new_cols.append(F.lit(None).cast(records.schema[c].dataType).alias(c))
    return kept.unionByName(ins.select(*new_cols))


class RecordTable:
    """Records stored in buckets of the URL's hash, so a batch rewrites only the buckets of its URLs.

    ``root/v=<n>/bucket=<b>`` holds a bucket as of version n; a version counts once its folder
    is committed, and a bucket's newest version before it is its content, so a batch that is run
    again under its version writes the same.  Ids are dealt per bucket: new ones are congruent to
    the bucket's number and above every id the table began with, so buckets never meet.
    A URL lies in one bucket, so the lowest id of a URL is found there."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets

    def _fs(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def _names(self, path: str, prefix: str) -> list[int]:
        fs, folder = self._fs(path)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))

    def versions(self, before: int = 1 << 62) -> list[int]:
        done = []
        for v in self._names(self.root, "v="):
            fs, mark = self._fs(f"{self.root}/v={v}/_SUCCESS")
            if v < before and fs.exists(mark):
                done.append(v)
        return done

    def newest(self, before: int = 1 << 62) -> dict[int, int]:
        """Bucket → its newest version: at most ``buckets`` entries."""
        return {b: v for v in self.versions(before) for b in self._names(f"{self.root}/v={v}", "bucket=")}

    def create(self, records: DataFrame) -> None:
        floor = records.select(F.coalesce(F.max("id"), F.lit(0)).alias("floor"))
        floor.write.mode("overwrite").parquet(f"{self.root}/floor")
        records.limit(0).write.mode("overwrite").parquet(f"{self.root}/columns")
        self._write(records, 0)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, version: int) -> None:
        (rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.root}/v={version}"))

    def read(self, buckets: Iterable[int] | None = None, before: int = 1 << 62) -> DataFrame:
        """The records, of some buckets or of all."""
        newest = self.newest(before)
        schema = self.spark.read.parquet(f"{self.root}/columns").schema
        paths = [f"{self.root}/v={v}/bucket={b}" for b, v in sorted(newest.items()) if buckets is None or b in set(buckets)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def upsert(self, batch: DataFrame, version: int, force_overwrite: bool = False) -> list[int]:
        """J8 over the buckets that the batch's URLs fall into; returns them."""
        batch = cut_lineage(one_per_url(batch, ["ts", "html_hash"]), "record_batch")
        touched = sorted(r[0] for r in batch.select(self._bucket()).distinct().collect())
        held = self.read(touched, before=version)
        base = self.spark.read.parquet(f"{self.root}/floor").first()["floor"] // self.buckets + 1
        seen = held.groupBy(self._bucket().alias("_b")).agg((F.floor(F.max("id") / self.buckets) + 1).alias("_next"))

        def new_ids(rows: DataFrame) -> DataFrame:
            rows = rows.withColumn("_b", self._bucket())
            place = F.row_number().over(Window.partitionBy("_b").orderBy("url")) - 1
            rows = rows.withColumn("_place", place).join(F.broadcast(seen), "_b", "left")  # a row per bucket
            first = F.greatest(F.coalesce("_next", F.lit(0)), F.lit(base))
            return (rows.withColumn("id", ((first + F.col("_place")) * self.buckets + F.col("_b")).cast("long"))
                    .drop("_b", "_place", "_next"))

        self._write(upsert_records(held, batch, force_overwrite, new_ids), version)
        return touched

    def prune(self, keep: int = 2) -> None:
        """Delete bucket versions that have ``keep`` newer ones."""
        newer: dict[int, int] = {}
        for v in reversed(self.versions()):
            for b in self._names(f"{self.root}/v={v}", "bucket="):
                newer[b] = newer.get(b, 0) + 1
                if newer[b] > keep:
                    fs, folder = self._fs(f"{self.root}/v={v}/bucket={b}")
                    fs.delete(folder, True)


# --- A1 / A4 ------------------------------------------------------------------

def hits_per_url(hits: DataFrame, url: str = "url") -> DataFrame:
    """A1: hit count per URL in a batch, null URLs dropped."""
    return hits.filter(F.col(url).isNotNull()).groupBy(url).agg(F.count(F.lit(1)).cast("int").alias("hits"))


def flush_hits(hits: DataFrame, records: DataFrame, stats: DataFrame) -> DataFrame:
    """R1 batch body: A1 → W1 (F7) → W2 → A4.  Returns ``(stat_id,
    crawl_record_id, url, hits)`` deltas; URLs with no AI record or no
    statistic are dropped."""
    counts = hits_per_url(hits)
    # only the batch's records, and only their statistics
    mine = records.select("id", "url", "cleaned_markdown").join(counts.select("url"), "url", "left_semi")
    rec = latest_ai_record(mine).select(F.col("url"), F.col("id").alias("crawl_record_id"))
    st = latest_statistic(stats.select("id", "crawl_record_id").join(rec.select("crawl_record_id"), "crawl_record_id", "left_semi")).select(
        "crawl_record_id", F.col("id").alias("stat_id"))
    return counts.join(rec, "url").join(st, "crawl_record_id").select("stat_id", "crawl_record_id", "url", "hits")


def apply_hit_deltas(stats: DataFrame, deltas: DataFrame) -> DataFrame:
    """A4: ``cache_hit_count += sum(delta)`` per statistic (deltas summed on read)."""
    d = deltas.groupBy("stat_id").agg(F.sum("hits").alias("_d"))
    out = stats.join(d, stats["id"] == d["stat_id"], "left")
    return out.withColumn("cache_hit_count", (F.col("cache_hit_count") + F.coalesce("_d", F.lit(0))).cast("int")) \
              .drop("stat_id", "_d")
