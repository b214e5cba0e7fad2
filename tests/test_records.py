"""No row lost or doubled by the upsert, whatever the partitions; Q1 requests that share a URL."""

import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from webweft.operators import records as R
from webweft.plans.scrape import batch_scrape
from webweft.sources import derived
from webweft.sources.tables import CRAWL_RECORD

T0 = dt.datetime(2024, 1, 1)


def _records(spark, rows):
    full = [(i, u, h, None, "md", ai, "<p>x</p>", None, "Completed", None, None, "HttpClient", 4, T0, T0, T0)
            for i, u, h, ai in rows]
    return spark.createDataFrame(full, CRAWL_RECORD)


def test_upsert_keeps_every_row_with_many_partitions(spark):
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        records = _records(spark, [(i, f"https://old.example/{i}", "h", None) for i in range(1, 51)])
        batch = spark.range(4000).select(F.concat(F.lit("https://new.example/"), F.lpad(F.col("id").cast("string"), 5, "0"))
                                         .alias("url"), F.lit("n").alias("html_hash"), F.lit(T0).cast("timestamp_ntz").alias("ts"))
        batch = batch.unionByName(batch)  # every URL twice
        out = {r.url: r.id for r in R.upsert_records(records, batch.repartition(32)).collect()}
        assert len(out) == 4050 and sorted(out.values()) == list(range(1, 4051))
        assert [out[f"https://new.example/{i:05d}"] for i in range(4000)] == list(range(51, 4051))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _requests(spark, rows):
    return spark.createDataFrame([(i, u, None, None, skip) for i, u, skip in rows],
                                 "request_id long, url string, formats array<string>, wait_until string, skip_ai boolean")


def test_one_url_with_and_without_ai_gives_one_record(spark):
    import hashlib
    url, page = "https://same.example/a", "<html><body><p>Body text</p></body></html>"
    records = _records(spark, [(10, url, hashlib.sha256(page.encode()).hexdigest(), None)])
    fetched = spark.createDataFrame([(url, page, "Browser")], "url string, html string, fetch_tier string")
    calls = spark.sparkContext.accumulator(0)

    def cleaner(text):
        calls.add(1)
        return "AI " + text, None
    res = batch_scrape(_requests(spark, [(1, url, True), (2, url, False), (3, url, False)]), fetched, records, None, None, None,
                       "2024-02-01 00:00:00", ai_configured=True, ai_cleaner=cleaner)
    rows = res.records.collect()
    assert [(r.id, r.cleaned_markdown is not None, r.fetch_tier) for r in rows] == [(10, True, "Browser")]
    assert {r.request_id: r.source for r in res.responses.collect()} == {1: "hash_hit", 2: "cleaned", 3: "cleaned"}
    assert calls.value == 1 and res.outcomes.count() == 1


def test_failed_url_counts_once_and_answers_come_back_from_the_cache(spark):
    url, gone = "https://new.example/a", "https://gone.example/a"
    fetched = spark.createDataFrame([(url, "<html><head><title>T</title></head><body><p>Some body text</p></body></html>")],
                                    "url string, html string")
    req = _requests(spark, [(1, url, True), (2, gone, True), (3, gone, True), (4, gone, True)])
    first = batch_scrape(req, fetched, _records(spark, []), None, None, None, "2024-02-01 00:00:00")
    assert [(r.url, r.ok) for r in first.outcomes.orderBy("url").collect()] == [(gone, False), (url, True)]
    assert first.records.filter("status = 'Failed'").count() == 1
    writes = first.cache_writes.collect()
    assert len(writes) == 1
    cache = first.cache_writes.select("prefix", "key", "value", F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz").alias("expires_at"))
    again = batch_scrape(_requests(spark, [(9, url, True)]), fetched.limit(0), first.records, cache, None, None, "2024-02-01 00:10:00")
    a = first.responses.filter("request_id = 1").first()
    b = again.responses.first()
    assert b.source == "cache" and (b.markdown, b.html, b.metadata, b.crawl_record_id) == (
        a.markdown, a.html, a.metadata, a.crawl_record_id) and b.markdown and b.crawl_record_id


def test_only_the_clean_reads_the_fetched_pages_again(spark):
    """What Q1 hands on comes from tables with a page's hash: the page table is not joined again for each output."""
    from webweft.session import work_path
    stored = work_path(spark, "t", "fetched")
    pages = [("https://new.example/a", "<html><body><p>Some body text</p></body></html>"), ("https://empty.example/a", None)]
    spark.createDataFrame(pages, "url string, html string").write.parquet(stored)
    req = _requests(spark, [(1, pages[0][0], True), (2, pages[1][0], True), (3, "https://gone.example/a", True)])
    res = batch_scrape(req, spark.read.parquet(stored), _records(spark, []), None, None, None, "2024-02-01 00:00:00")
    assert {r.url.split("/")[2]: r.ok for r in res.outcomes.collect()} == {
        "new.example": True, "empty.example": False, "gone.example": False}
    assert {r.request_id: r.source for r in res.responses.collect()} == {1: "cleaned", 2: "empty", 3: "fetch_failed"}
    for out in (res.outcomes, res.responses, res.records, res.cache_writes):
        assert not [f for f in out.inputFiles() if stored.split("/")[-1] in f]


def test_bucketed_records_rewrite_only_touched_buckets(spark):
    import glob
    from webweft.session import work_path
    base = derived.fx_records(spark, SF_SMALL)
    root = work_path(spark, "t", "records")
    table = R.RecordTable(spark, root, buckets=16)
    table.create(base)
    urls = [r["url"] for r in base.select("url").distinct().orderBy("url").limit(2).collect()]
    now = dt.datetime(2025, 1, 1)
    batch = spark.createDataFrame([(u, f"h{i}", now) for i, u in enumerate([*urls, "http://new/1", "http://new/2", "http://new/1"])],
                                  "url string, html_hash string, ts timestamp_ntz")
    touched = table.upsert(batch, 1)
    assert 0 < len(touched) <= 4

    def files(version):
        return {p.split("bucket=")[1].split("/")[0] for p in glob.glob(f"{root.removeprefix('file:')}/v={version}/bucket=*/*.parquet")}
    assert files(1) == {str(b) for b in touched} and len(files(0)) > len(touched)
    columns = ["url", "html_hash", "stability_count", "status", "last_accessed_at"]
    want = R.upsert_records(base, batch).select(*columns)
    assert sorted(map(str, table.read().select(*columns).collect())) == sorted(map(str, want.collect()))
    ids = [r["id"] for r in table.read().select("id").collect()]
    assert len(ids) == len(set(ids)) == base.count() + 2
    # the same batch under its version again, then a later one on top
    table.upsert(batch, 1)
    assert sorted(map(str, table.read().select(*columns).collect())) == sorted(map(str, want.collect()))
    later = spark.createDataFrame([("http://new/1", "h4", now), ("http://new/3", "h", now)], "url string, html_hash string, ts timestamp_ntz")
    table.upsert(later, 2)
    again = {r["url"]: (r["id"], r["stability_count"]) for r in table.read().filter("url like 'http://new/%'").collect()}
    first = {r["url"]: r["id"] for r in table.read(before=2).filter("url like 'http://new/%'").collect()}
    assert again["http://new/1"][0] == first["http://new/1"] and len({i for i, _ in again.values()}) == 3
    for version in (3, 4, 5):
        table.upsert(later, version)
    before = sorted(map(str, table.read().collect()))
    table.prune()
    assert sorted(map(str, table.read().collect())) == before and 3 not in table.newest().values()


def test_hot_key_runs_stay_spread(spark):
    """No operator above the runs deals rows by the key alone."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        crawls = derived.fx_crawls(spark, SF_SMALL).select("url", "html_hash", "ts", "event_id")
        plan = R.stability_summary(crawls, fanin=2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    anti = next(x for x in plan.split("\n") if "LeftAnti" in x)
    assert "run_no" in anti and "url" in anti
