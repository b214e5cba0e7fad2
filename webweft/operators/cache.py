"""Key-value cache as tables: ``(prefix, key, value, expires_at)`` snapshots.

Reads take an explicit ``as_of`` instead of a clock, so expiry is testable
without sleeping.  Writes produce a new snapshot (old rows whose key was
rewritten are dropped by an anti join, then the new rows are appended).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webweft.functions.policy import add_minutes
from webweft.session import cut_lineage

# --- fixed values --------------------------------------------------------------
DEFAULT_TTL_MINUTES = 30.0
# ---------------------------------------------------------------------------------

KEY = ["prefix", "key"]


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def live(cache: DataFrame, as_of) -> DataFrame:
    """Entries not yet expired at ``as_of`` (expired = missing)."""
    return cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > _ts(as_of)))


def put_many(cache: DataFrame | None, writes: DataFrame, default_ttl: float = DEFAULT_TTL_MINUTES,
             order: list[str] | None = None) -> DataFrame:
    """U4 / U7 set: ``writes(prefix, key, value, written_at, ttl_minutes[, event_id])``;
    last write per key wins; expiry = key TTL or the default."""
    order = order or [c for c in ("written_at", "event_id") if c in writes.columns]
    last = writes.groupBy(*KEY).agg(F.max_by(F.struct("value", "written_at", "ttl_minutes"),
                                             F.struct(*order)).alias("_w"))
    new = last.select(*KEY, F.col("_w.value").alias("value"),
                      add_minutes(F.col("_w.written_at"),
                                  F.coalesce(F.col("_w.ttl_minutes"), F.lit(default_ttl))).alias("expires_at"))
    if cache is None:
        return new
    return cache.join(new.select(*KEY), KEY, "left_anti").unionByName(new)


def _flag(df: DataFrame, table: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Adds boolean ``name``: does the row's ``cols`` occur in ``table``?  A
    left join against the distinct keys of ``table`` (never duplicates rows)."""
    keys = table.select(*cols).distinct().withColumn(name, F.lit(True))
    return df.join(keys, cols, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def get_many(cache: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """``requests(pos, prefix, key)`` → value per request in request
    order; missing or expired → null; duplicate keys allowed."""
    lv = live(cache, as_of).select(*KEY, "value")
    return requests.join(lv, KEY, "left").select("pos", *KEY, "value")


def exists(cache: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """U7 exists: flag per request."""
    return _flag(requests, live(cache, as_of), KEY, "exists")


def get_or_set(cache: DataFrame, requests: DataFrame, compute: Callable[[DataFrame], DataFrame],
               as_of, ttl_minutes: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits answered from the cache; ``compute`` runs on the distinct
    missing keys only (``(prefix, key) → value``); results are stored.
    Returns ``(answers(pos, prefix, key, value, hit), new_cache)``."""
    lv = live(cache, as_of).select(*KEY, "value")
    hits = requests.join(lv, KEY, "left_semi").join(lv, KEY).withColumn("hit", F.lit(True))
    misses = requests.join(lv, KEY, "left_anti")
    # written once: the answers and the new cache hold the same values, and compute runs once
    computed = cut_lineage(compute(misses.select(*KEY).distinct()), "computed")
    answered = misses.join(computed, KEY, "left").withColumn("hit", F.lit(False))
    answers = hits.select("pos", *KEY, "value", "hit").unionByName(answered.select("pos", *KEY, "value", "hit"))
    writes = computed.select(*KEY, "value", _ts(as_of).alias("written_at"),
                             F.lit(ttl_minutes).cast("double").alias("ttl_minutes"))
    return answers, put_many(cache, writes)


def delete_keys(cache: DataFrame, keys: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """U5 single/multi delete: returns (new snapshot, ``(prefix, key, existed)``)."""
    report = _flag(keys, live(cache, as_of), KEY, "existed")
    return cache.join(keys.select(*KEY), KEY, "left_anti"), report


def delete_by_prefix(cache: DataFrame, key_prefix: str, as_of) -> tuple[DataFrame, Column]:
    """U5 prefix purge on the full ``prefix:key`` name (literal, not a glob).
    Returns the new snapshot and an aggregate column counting removed keys."""
    full = F.concat(F.col("prefix"), F.lit(":"), F.col("key"))
    gone = full.startswith(key_prefix) & (F.col("expires_at").isNull() | (F.col("expires_at") > _ts(as_of)))
    return cache.filter(~full.startswith(key_prefix)), F.count_if(gone)


# --- sets and hashes (U6, A8) ------------------------------------------------------

def set_add(sets: DataFrame | None, adds: DataFrame, ttl_minutes: float | None, as_of) -> DataFrame:
    """``adds(prefix, key, member)``; a key with a TTL gets a new expiry
    on every add; without TTL the key keeps none."""
    exp = add_minutes(_ts(as_of), F.lit(ttl_minutes)) if ttl_minutes is not None else F.lit(None).cast("timestamp_ntz")
    new = adds.select(*KEY, "member").distinct().withColumn("expires_at", exp)
    if sets is None:
        return new
    touched = new.select(*KEY).distinct()
    old = sets.join(touched, KEY, "left_semi").withColumn("expires_at", exp) if ttl_minutes is not None \
        else sets.join(touched, KEY, "left_semi")
    rest = sets.join(touched, KEY, "left_anti")
    return rest.unionByName(old.unionByName(new).dropDuplicates([*KEY, "member"]))


def set_contains(sets: DataFrame, probes: DataFrame, as_of) -> DataFrame:
    return _flag(probes, live(sets, as_of), [*KEY, "member"], "contains")


def hash_set(hashes: DataFrame | None, writes: DataFrame) -> DataFrame:
    """U6 hash set: ``writes(prefix, key, field, value, written_at)``; a field is
    overwritten by its last write."""
    last = writes.groupBy(*KEY, "field").agg(F.max_by("value", "written_at").alias("value"))
    if hashes is None:
        return last
    return hashes.join(last.select(*KEY, "field"), [*KEY, "field"], "left_anti").unionByName(last)


def hash_increment(counters: DataFrame | None, increments: DataFrame) -> DataFrame:
    """``increments(prefix, key, field[, delta])`` (delta defaults to 1);
    a missing field starts at 0.  Partial aggregation before the shuffle."""
    d = increments.withColumn("delta", F.coalesce(F.col("delta"), F.lit(1))) if "delta" in increments.columns \
        else increments.withColumn("delta", F.lit(1))
    new = d.groupBy(*KEY, "field").agg(F.sum("delta").cast("long").alias("value"))
    if counters is None:
        return new
    return (counters.select(*KEY, "field", F.col("value").cast("long"))
            .unionByName(new).groupBy(*KEY, "field").agg(F.sum("value").cast("long").alias("value")))


def rename_key(table: DataFrame, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    """U6 rename (overwrites the target key)."""
    is_old = (F.col("prefix") == old[0]) & (F.col("key") == old[1])
    is_new = (F.col("prefix") == new[0]) & (F.col("key") == new[1])
    return table.filter(~is_new | is_old).select(
        *[F.when(is_old, F.lit(new[0])).otherwise(F.col("prefix")).alias("prefix") if c == "prefix"
          else F.when(is_old, F.lit(new[1])).otherwise(F.col("key")).alias("key") if c == "key"
          else F.col(c) for c in table.columns])
