"""Streams equal their batch forms (R1, R2, R3) and R4/R5/R6 behave."""

import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from webweft.operators import blocklist, records, reputation
from webweft.plans import catalog
from webweft.session import cut_lineage, work_path
from webweft.sources import derived
from webweft.streaming import jobs


def _rows(df, key):
    return {r[key]: tuple(r.asDict()[c] for c in sorted(df.columns)) for r in df.collect()}


def test_stream_equals_batch(spark):
    assert _rows(catalog.stream_reputation(spark, SF_SMALL), "domain") == _rows(catalog.reputation(spark, SF_SMALL), "domain")
    st = catalog.stability(spark, SF_SMALL).select("url", "n_crawls", "stability_count")
    assert _rows(catalog.stream_stability(spark, SF_SMALL), "url") == _rows(st, "url")
    assert _rows(catalog.stream_hit_flush(spark, SF_SMALL), "id") == _rows(catalog.hit_flush(spark, SF_SMALL), "id")


REQUEST = "request_id long, context_hash string, ts timestamp_ntz"


def _minute(m):
    return dt.datetime(2024, 5, 1) + dt.timedelta(minutes=m)


def test_dedup_rounds_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(jobs, "cut_lineage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut_lineage(df, name))
    requests = spark.createDataFrame([(i, "h", _minute(10 * i)) for i in range(5)], REQUEST)
    held = spark.createDataFrame([("h", _minute(5))], "context_hash string, until timestamp_ntz")
    worked = jobs.first_requests(requests, held, 15)
    assert sorted(r["request_id"] for r in worked.collect()) == [1, 3]
    assert not any("Broadcast" in p for p in plans)
    assert all(p.count("SortMergeJoin") <= 1 for p in plans)


def test_actions(spark):
    req = spark.createDataFrame([(1, "h1"), (2, "h1"), (3, "h2")], "request_id long, context_hash string")
    src = work_path(spark, "t", "after_src")
    req.coalesce(1).write.parquet(src)
    seen, errors = [], []

    def sync(df, bid):
        seen.append(("sync", df.count()))

    def flaky(df, bid):
        raise RuntimeError("best effort failed")
    ck2 = work_path(spark, "t", "after_ck")
    jobs.after_search_stream(jobs.file_stream(spark, src, req.schema), [(2, True, sync), (1, False, flaky)], ck2,
                             on_error=errors.append)
    assert seen == [("sync", 3)] and len(errors) == 1


def _arrivals(spark, batches, run):
    """Files that arrive one after the other, a micro-batch each."""
    src = work_path(spark, "t", "src")
    for rows, schema in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        run(jobs.file_stream(spark, src, spark.createDataFrame([], schema).schema, 99))


def test_dedup_across_batches_and_expiry(spark):
    sink, ck = work_path(spark, "t", "dd_sink"), work_path(spark, "t", "dd_ck")
    batches = [[(i, "hot", _minute(i)) for i in range(50)] + [(60, "twice", _minute(1)), (61, "twice", _minute(61))],
               [(90, "hot", _minute(55)), (91, "cold", _minute(56)), (92, "hot", _minute(60)), (93, "hot", _minute(121)), (94, "none", None)],
               [(95, "hot", _minute(180)), (96, "hot", _minute(181)), (97, "cold", _minute(200)), (98, "cold", _minute(200))],
               [(99, "late", _minute(900))]]
    _arrivals(spark, [(b, REQUEST) for b in batches],
              lambda stream: jobs.dedup_stream(stream, 60, sink, ck))
    out = jobs.dedup_answers(spark, sink)
    assert {r["request_id"] for r in out.filter("does_work").collect()} == {0, 60, 61, 91, 92, 93, 94, 96, 97, 99}
    assert out.count() == sum(map(len, batches))
    # what was over before the last batch is gone from the store, the answers are not
    assert jobs.committed(spark, f"{sink}/held", "batch_id=") == [3]


def test_dedup_replay_writes_the_same(spark):
    """A batch that is run again (its checkpoint entry is lost) gives the same rows."""
    sink, src = work_path(spark, "t", "rp_sink"), work_path(spark, "t", "rp_src")
    spark.createDataFrame([(i, f"h{i % 3}", _minute(30 * i)) for i in range(20)], REQUEST).coalesce(1).write.parquet(src)
    for _ in range(2):
        stream = jobs.file_stream(spark, src, spark.read.parquet(src).schema)
        jobs.dedup_stream(stream, 60, sink, work_path(spark, "t", "rp_ck"))
        rows = sorted((r["request_id"], r["does_work"], r["until"]) for r in jobs.dedup_answers(spark, sink).filter("until is not null").collect())
        first = rows if _ == 0 else first
        assert rows == first and len(rows) > 3


def test_dedup_within_watermark(spark):
    src, ck, name = work_path(spark, "t", "wm_src"), work_path(spark, "t", "wm_ck"), "dedup_wm"
    spark.createDataFrame([(1, "a", _minute(0)), (2, "a", _minute(5)), (3, "b", _minute(9))],
                          "request_id long, context_hash string, ts timestamp").coalesce(1).write.parquet(src)
    stream = jobs.file_stream(spark, src, spark.read.parquet(src).schema)
    q = (jobs.dedup_within_watermark(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r["context_hash"] for r in spark.table(name).collect()) == ["a", "b"]


def test_state_reads_do_not_grow_with_the_batches_before(spark):
    """Snapshots bound the folders that a batch reads, and a batch reads only its keys' buckets."""
    sink, ck = work_path(spark, "t", "ks_sink"), work_path(spark, "t", "ks_ck")
    events = [[(f"d{i % 4}", (i + b) % 3 == 0, _minute(100 * b + i), 100 * b + i) for i in range(12)] for b in range(7)]
    schema = "domain string, ok boolean, ts timestamp_ntz, event_id long"
    _arrivals(spark, [(b, schema) for b in events],
              lambda stream: jobs.reputation_stream(stream, sink, ck, compact_every=2))
    state = jobs.reputation_state(sink)
    all_events = spark.createDataFrame([e for b in events for e in b], schema)
    assert _rows(state.current(spark), "domain") == _rows(reputation.reputation_fold(all_events), "domain")
    assert [v for v, _ in state.parts(spark, 7)] == [5, 6]
    assert all(len(state.parts(spark, b)) <= 3 for b in range(6, 9))
    assert jobs.committed(spark, f"{sink}/base", "v=") == [3, 5]
    assert jobs.committed(spark, f"{sink}/delta", "batch_id=") == [4, 5, 6]
    one = state.rows(spark, 7, state.touched(all_events.filter("domain = 'd1'")))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 2 or plan.count("PartitionFilters: [(bucket") == 2, plan
    assert {r["domain"] for r in one.collect()} >= {"d1"}
    # a batch that is run again sees the state that it saw
    before = _rows(state.rows(spark, 6), "domain")
    assert before == _rows(reputation.reputation_fold(all_events.filter("event_id < 600")), "domain")


def test_slices_lose_no_row(spark):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(100)] + [(100, None)],
                               "i int, ts timestamp_ntz")
    folders = jobs.staged_slices(df.repartition(6), work_path(spark, "t", "slices"), "ts")
    got = [sorted(r["i"] for r in spark.read.parquet(f).collect()) for f in folders]
    assert sorted(x for part in got for x in part) == list(range(101)) and 100 in got[0] and got[3][-1] == 99


def test_refresh_does_not_hide_read_errors(spark):
    import pytest
    root = work_path(spark, "t", "rules2")
    load = blocklist.load_rules
    p = jobs.refresh_rules(spark, blocklist.lines_from_rows(spark, "s", ["*://*.a.example/*"]), root, load)
    import glob
    for f in glob.glob(p.removeprefix("file:") + "/*.parquet"):
        open(f, "w").write("broken")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        jobs.refresh_rules(spark, blocklist.lines_from_rows(spark, "s", ["@*://*.b.example/*", "*://c.example/*"]), root, load)


def test_rule_refresh_keeps_old_on_allow_only(spark):
    root = work_path(spark, "t", "rules")
    load = blocklist.load_rules
    p1 = jobs.refresh_rules(spark, blocklist.lines_from_rows(spark, "s", ["*://*.a.example/*"]), root, load)
    p2 = jobs.refresh_rules(spark, blocklist.lines_from_rows(spark, "s", ["@*://*.b.example/*"]), root, load)
    assert p1 == p2
    p3 = jobs.refresh_rules(spark, blocklist.lines_from_rows(spark, "s", ["*://c.example/*"]), root, load)
    cur = jobs.current_rules(spark, root)
    assert p3 != p1 and {r["rule_class"] for r in cur.collect()} == {"wildcard", "exact"}


def test_results_do_not_depend_on_session_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        la_stream = _rows(catalog.stream_reputation(spark, SF_SMALL), "domain")
        la_streak = _rows(catalog.failure_streak(spark, SF_SMALL), "event_id")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert la_stream == _rows(catalog.reputation(spark, SF_SMALL), "domain")
    assert la_streak == _rows(catalog.failure_streak(spark, SF_SMALL), "event_id")
