"""Per-host reputation: failure fold (A3), running streak (W3), block gate
(J1 / F6) and the outcome reporter (X6).

The fold is written as two partial aggregations (map-side combined, so a
host holding a large share of the events does not pile up in one task):
first the last success and first failure per host, then conditional counts
relative to those keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webweft.functions.policy import add_minutes, block_minutes
from webweft.functions.urls import extract_domain
from webweft.operators.sizing import sized_broadcast
from webweft.session import cut_lineage


def outcomes(df: DataFrame, url_col: str = "url", ok_col: str = "ok", ts_col: str = "ts",
             id_col: str = "event_id") -> DataFrame:
    """Outcome events ``(domain, ok, ts, event_id)``; unparsable URLs dropped."""
    return (df.select(extract_domain(F.col(url_col)).alias("domain"), F.col(ok_col).alias("ok"),
                      F.col(ts_col).alias("ts"), F.col(id_col).alias("event_id"))
            .filter(F.col("domain").isNotNull()))


def host_summary(events: DataFrame) -> DataFrame:
    """One row per host: failures, failures after its last success, whether it had one, and
    the times that a fold needs.

    Two aggregates that combine in any grouping, so a hot host is reduced in each task
    first: its last success and first failure, then counts relative to these.  The row per
    host is joined to the events as a broadcast if its measured size allows it."""
    ok, at = F.col("ok"), F.struct(F.col("ts").alias("t"), F.col("event_id").alias("i"))
    ends = events.groupBy("domain").agg(F.max(F.when(ok, at)).alias("_ls"), F.min(F.when(~ok, at)).alias("_ff"))
    ends = cut_lineage(ends, "host_ends").withColumnRenamed("domain", "_host")
    e = events.join(sized_broadcast(ends), F.col("domain") == F.col("_host")).withColumn("_at", at)
    return e.groupBy("domain").agg(
        F.count_if(~ok).alias("failures"),
        F.count_if(~ok & (F.col("_ls").isNull() | (F.col("_at") > F.col("_ls")))).alias("trailing"),
        F.max(ok).alias("succeeded"), F.max(F.when(~ok, F.col("ts"))).alias("last_failure_at"),
        F.max(F.when(ok, F.col("ts"))).alias("last_ok_at"),
        F.max(F.when(ok & (F.col("_at") > F.col("_ff")), F.col("ts"))).alias("ok_after_failure_at"))


REPUTATION = ["domain", "consecutive_failures", "total_failures", "blocked_until", "last_failure_at",
              "last_success_at", "updated_at"]


def _finished(rows: DataFrame) -> DataFrame:
    """Reputation rows with the block time (P15) and the time of the last change."""
    c = F.col("consecutive_failures")
    return (rows.filter("total_failures > 0")
            .withColumn("blocked_until", F.when(c > 0, add_minutes(F.col("last_failure_at"), block_minutes(c))))
            .withColumn("updated_at", F.greatest("last_failure_at", "last_success_at")).select(*REPUTATION))


def reputation_fold(events: DataFrame, enabled: bool = True) -> DataFrame:
    """A3: one row per host that has at least one failure; none when disabled."""
    rows = host_summary(events).select(
        "domain", F.col("trailing").cast("int").alias("consecutive_failures"),
        F.col("failures").cast("int").alias("total_failures"), "last_failure_at",
        F.col("ok_after_failure_at").alias("last_success_at"))
    out = _finished(rows)
    return out if enabled else out.limit(0)


def reputation_merge(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """The snapshot after a later batch of events, for the hosts of the batch.

    Equal to the fold over all events when every event of a host is later than the
    ones in its snapshot row.  A success only leaves a trace on a host that has failed."""
    s = snapshot.select(*[F.col(c).alias("_" + c) for c in REPUTATION])
    j = host_summary(events).join(s, F.col("domain") == F.col("_domain"), "left")
    known = F.col("_domain").isNotNull()
    streak = F.when(F.col("succeeded"), F.col("trailing")).otherwise(F.coalesce("_consecutive_failures", F.lit(0)) + F.col("failures"))
    return _finished(j.select(
        "domain", streak.cast("int").alias("consecutive_failures"),
        (F.coalesce("_total_failures", F.lit(0)) + F.col("failures")).cast("int").alias("total_failures"),
        F.coalesce("last_failure_at", "_last_failure_at").alias("last_failure_at"),
        F.when(known, F.coalesce("last_ok_at", "_last_success_at")).otherwise(F.col("ok_after_failure_at"))
        .alias("last_success_at")))


def failure_streak(events: DataFrame, bucket_minutes: int = 60) -> DataFrame:
    """Consecutive failures at each event (running form of A3).

    Skew-safe prefix scan.  Pass 1 is a window per (host, time bucket): the
    running failure count and the streak inside the bucket.  Per-bucket end
    values are aggregated from pass 1 (same partitioning, no new shuffle of
    the events); the carry into each bucket comes from a window over one row
    per bucket and is joined back on (host, bucket)."""
    from webweft.operators.records import time_bucket
    ok = F.col("ok")
    e = events.withColumn("_b", time_bucket(F.col("ts"), bucket_minutes))
    w = Window.partitionBy("domain", "_b").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    p1 = e.withColumn("_rf", F.sum(F.when(~ok, 1).otherwise(0)).over(w))
    p1 = p1.withColumn("_at", F.max(F.when(ok, F.col("_rf"))).over(w))
    # streak inside the bucket and whether a success was seen so far
    p1 = p1.withColumn("_local", (F.col("_rf") - F.coalesce(F.col("_at"), F.lit(0))).cast("long"))
    per_b = p1.groupBy("domain", "_b").agg(
        F.max_by("_local", F.struct("ts", "event_id")).alias("_end_local"),
        F.max(F.col("_at").isNotNull().cast("int")).alias("_has"))
    wb = Window.partitionBy("domain").orderBy("_b")
    # streak at the end of bucket b = end_local(b) if b saw a success, else carry(b) + end_local(b):
    # that is, end_local summed back to (and including) the last bucket with a success
    grp = F.sum("_has").over(wb.rowsBetween(Window.unboundedPreceding, 0))
    per_b = per_b.withColumn("_grp", grp)
    end = F.sum("_end_local").over(Window.partitionBy("domain", "_grp").orderBy("_b")
                                   .rowsBetween(Window.unboundedPreceding, 0))
    per_b = per_b.withColumn("_end", end)
    carry = per_b.withColumn("_carry", F.coalesce(F.lag("_end").over(wb), F.lit(0))).select("domain", "_b", "_carry")
    s = p1.join(carry, ["domain", "_b"])
    streak = F.when(F.col("_at").isNull(), F.col("_carry") + F.col("_rf")).otherwise(F.col("_local"))
    return s.withColumn("streak", streak.cast("int")).drop("_rf", "_at", "_local", "_b", "_carry")


def reputation_gate(df: DataFrame, reputations: DataFrame, as_of, url_col: str = "url",
                    enabled: bool = True) -> DataFrame:
    """Adds ``rep_blocked`` and ``rep_blocked_until`` (blocked while
    ``blocked_until > as_of``; unparsable domain or disabled → not blocked).
    Reputations hold one row per host: the side is broadcast after a size
    check, else joined by a shuffled hash/sort-merge join."""
    if not enabled:
        return df.withColumn("rep_blocked", F.lit(False)).withColumn(
            "rep_blocked_until", F.lit(None).cast("timestamp_ntz"))
    as_of_col = as_of if isinstance(as_of, Column) else F.lit(as_of)
    live = reputations.filter(F.col("blocked_until") > as_of_col).select(
        F.col("domain").alias("_rep_domain"), F.col("blocked_until").alias("rep_blocked_until"))
    live = sized_broadcast(live)
    out = df.withColumn("_rep_host", extract_domain(F.col(url_col)))
    out = out.join(live, out["_rep_host"] == live["_rep_domain"], "left")
    return (out.withColumn("rep_blocked", F.col("rep_blocked_until").isNotNull())
            .drop("_rep_host", "_rep_domain"))


def as_url_filter(reputations: DataFrame, as_of, **kw):
    """X2 adapter for the reputation filter."""
    def _filter(df: DataFrame, url_col: str) -> DataFrame:
        g = reputation_gate(df, reputations, as_of, url_col, **kw)
        return g.withColumnRenamed("rep_blocked", "blocked").drop("rep_blocked_until")
    return _filter
