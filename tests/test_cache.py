"""Key-value tables (J12, J13, U4-U7, A8), mirroring the reference's cache
tests with ``as_of`` instead of sleeping."""

from pyspark.sql import functions as F

from webweft.operators import cache as C

T0 = "2024-01-01 00:00:00"


def _writes(spark, rows):
    return spark.createDataFrame(rows, "prefix string, key string, value string, written_at timestamp_ntz, "
                                       "ttl_minutes double")


def _ts(s):
    import datetime as dt
    return dt.datetime.fromisoformat(s)


def test_set_get_missing_and_expiry(spark):
    cache = C.put_many(None, _writes(spark, [
        ("T", "s", "hello", _ts(T0), None), ("T", "obj", '{"id":1,"name":"n"}', _ts(T0), None),
        ("T", "short", "x", _ts(T0), 500 / 60000.0)]))
    req = spark.createDataFrame([(1, "T", "s"), (2, "T", "missing"), (3, "T", "obj"), (4, "T", "s"), (5, "T", "short")],
                                "pos int, prefix string, key string")
    now = {r["pos"]: r["value"] for r in C.get_many(cache, req, T0).collect()}
    assert now == {1: "hello", 2: None, 3: '{"id":1,"name":"n"}', 4: "hello", 5: "x"}
    later = {r["pos"]: r["value"] for r in C.get_many(cache, req, "2024-01-01 00:00:01").collect()}
    assert later[5] is None and later[1] == "hello"  # 500 ms TTL gone, default 30 min kept


def test_last_write_wins_and_delete(spark):
    cache = C.put_many(None, _writes(spark, [
        ("T", "k", "v1", _ts(T0), None), ("T", "k", "v2", _ts("2024-01-01 00:00:05"), None),
        ("P", "a", "1", _ts(T0), None), ("P", "b", "2", _ts(T0), None), ("P", "c", "3", _ts(T0), None),
        ("Q", "a", "4", _ts(T0), None)]))
    got = {(r["prefix"], r["key"]): r["value"] for r in cache.collect()}
    assert got[("T", "k")] == "v2"
    after, removed = C.delete_by_prefix(cache, "P:", T0)
    assert cache.agg(removed.alias("n")).first()["n"] == 3
    assert {(r["prefix"], r["key"]) for r in after.collect()} == {("T", "k"), ("Q", "a")}
    keys = spark.createDataFrame([("T", "k"), ("T", "nope")], "prefix string, key string")
    snap, report = C.delete_keys(after, keys, T0)
    assert {r["key"]: r["existed"] for r in report.collect()} == {"k": True, "nope": False}
    ex = C.exists(snap, spark.createDataFrame([(1, "T", "k"), (2, "Q", "a")], "pos int, prefix string, key string"), T0)
    assert {r["pos"]: r["exists"] for r in ex.collect()} == {1: False, 2: True}


def test_get_or_set_computes_only_misses(spark):
    cache = C.put_many(None, _writes(spark, [("T", "hit", "cached", _ts(T0), None)]))
    req = spark.createDataFrame([(1, "T", "hit"), (2, "T", "miss"), (3, "T", "miss")], "pos int, prefix string, key string")
    seen = spark.sparkContext.accumulator(0)

    def compute(keys):
        n = keys.count()
        seen.add(n)
        return keys.withColumn("value", F.lit("made"))
    answers, new_cache = C.get_or_set(cache, req, compute, T0)
    got = {r["pos"]: (r["value"], r["hit"]) for r in answers.collect()}
    assert got == {1: ("cached", True), 2: ("made", False), 3: ("made", False)}
    assert seen.value == 1
    assert {r["key"]: r["value"] for r in new_cache.collect()} == {"hit": "cached", "miss": "made"}


def test_sets_hashes_counters(spark):
    adds = spark.createDataFrame([("S", "k", "a"), ("S", "k", "b"), ("S", "k", "a")], "prefix string, key string, member string")
    sets = C.set_add(None, adds, 300 / 60000.0, T0)
    probes = spark.createDataFrame([("S", "k", "a"), ("S", "k", "z")], "prefix string, key string, member string")
    assert {r["member"]: r["contains"] for r in C.set_contains(sets, probes, T0).collect()} == {"a": True, "z": False}
    assert not any(r["contains"] for r in C.set_contains(sets, probes, "2024-01-01 00:00:01").collect())
    hs = C.hash_set(None, spark.createDataFrame([
        ("H", "k", "f", "v1", _ts(T0)), ("H", "k", "f", "v2", _ts("2024-01-01 00:00:02")), ("H", "k", "g", "x", _ts(T0))],
        "prefix string, key string, field string, value string, written_at timestamp_ntz"))
    assert {r["field"]: r["value"] for r in hs.collect()} == {"f": "v2", "g": "x"}
    inc = spark.createDataFrame([("H", "c", "n", 1), ("H", "c", "n", None), ("H", "c", "n", 3)],
                                "prefix string, key string, field string, delta long")
    assert C.hash_increment(None, inc).first()["value"] == 5
    renamed = C.rename_key(hs, ("H", "k"), ("H", "k2"))
    assert {r["key"] for r in renamed.collect()} == {"k2"}


def test_answers_and_stored_values_are_the_same(spark):
    """A value that differs from call to call is computed once."""
    cache = spark.createDataFrame([], "prefix string, key string, value string, expires_at timestamp_ntz")
    asked = spark.createDataFrame([(i, "P", f"k{i % 5}") for i in range(20)], "pos int, prefix string, key string")
    answers, stored = C.get_or_set(cache, asked, lambda keys: keys.withColumn("value", F.uuid()), T0, 60.0)
    got = {r["key"]: r["value"] for r in answers.collect()}
    assert {r["key"]: r["value"] for r in stored.collect()} == got and len(set(got.values())) == 5
