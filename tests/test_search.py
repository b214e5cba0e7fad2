"""S7 provider parsing, P8/P10-P12/F2 projections and the Q2 flow."""

import json

from pyspark.sql import functions as F

from webweft.operators import search as S


def test_parse_provider_cases(spark):
    good = {"code": 200, "data": {"webPages": {"value": [
        {"name": "A", "url": "https://a.example/1", "snippet": "s"},
        {"name": None, "url": "   ", "snippet": "blank url"},
        {"url": "https://b.example/2"}]}}}
    upper = {"Code": 200, "Data": {"WebPages": {"Value": [{"Name": "U", "URL": "https://u.example/"}]}}}
    rows = [("ok", json.dumps(good)), ("upper", json.dumps(upper)), ("code", json.dumps({"code": 500, "msg": "busy"})),
            ("nolist", json.dumps({"code": 200, "data": {}})), ("bad", "{nope")]
    bodies = spark.createDataFrame(rows, "cache_key string, body string")
    res, failed = S.parse_provider(bodies)
    got = sorted((r["cache_key"], r["rank"], r["provider_pos"], r["title"], r["url"], r["description"])
                 for r in res.collect())
    assert got == [("ok", 1, 1, "A", "https://a.example/1", "s"), ("ok", 2, 3, "", "https://b.example/2", ""),
                   ("upper", 1, 1, "U", "https://u.example/", "")]
    assert {r["cache_key"]: r["provider_error"] for r in failed.collect()} == {
        "code": "busy", "nolist": "Search request failed", "bad": "Search request failed"}


def test_request_projections(spark):
    req = spark.createDataFrame([
        (1, "q", None, None, None, None, None, None, None, False, None),
        (2, "q", 51, ["news"], ["a.com", "b.com"], [], "qdr:h", "Berlin", "de", True, 500),
        (3, "  ", 0, [], None, ["x"], "cdr:1,cd_min:2024-01-01,cd_max:2024-02-01", None, None, False, 300000),
        (4, "x" * 501, 100, None, None, None, "cdr:1,cd_min:2024-01-01", None, None, False, 1000),
    ], "query_id int, query string, limit int, sources array<string>, include_domains array<string>, "
       "exclude_domains array<string>, tbs string, location string, country string, summary boolean, timeout int")
    got = {r["query_id"]: r for r in S.provider_requests(req).collect()}
    import hashlib
    assert got[1]["cache_key"] == hashlib.sha256("q||||web|||".encode()).hexdigest()
    assert got[2]["cache_key"] == hashlib.sha256("q|de|Berlin|qdr:h|news|a.com,b.com||51".encode()).hexdigest()
    assert [got[i]["freshness"] for i in (1, 2, 3, 4)] == ["noLimit", "oneDay", "2024-01-01..2024-02-01", "noLimit"]
    assert [got[i]["count"] for i in (1, 2, 3, 4)] == [10, 50, 0, 50]
    assert got[2]["include"] == "a.com|b.com" and got[1]["include"] is None and got[2]["exclude"] is None
    assert [got[i]["valid"] for i in (1, 2, 3, 4)] == [True, False, False, False]


def test_batch_search_flow(spark):
    req = spark.createDataFrame([(1, "alpha", 2), (2, "beta", None), (3, "down", None)],
                                "query_id int, query string, limit int")
    for c, t in [("sources", "array<string>"), ("include_domains", "array<string>"), ("exclude_domains", "array<string>"),
                 ("tbs", "string"), ("location", "string"), ("country", "string"), ("timeout", "int")]:
        req = req.withColumn(c, F.lit(None).cast(t))
    req = req.withColumn("summary", F.lit(False))
    items = [{"name": f"r{i}", "url": f"https://h{i}.example/", "snippet": "s"} for i in range(5)]

    def provider(calls):
        body = F.when(F.col("query") == "down", F.lit("{bad")).otherwise(
            F.lit(json.dumps({"code": 200, "data": {"webPages": {"value": items}}})))
        return calls.select("cache_key", body.alias("body"))

    def block_h1(df, url_col):
        return df.withColumn("blocked", F.col(url_col).contains("h1."))
    out = {r["query_id"]: r for r in S.batch_search(req, provider, [("test", block_h1)]).collect()}
    assert out[1]["success"] and out[1]["n_raw"] == 2 and out[1]["n_kept"] == 1
    assert out[1]["warning"] == "1 results filtered" and [w["url"] for w in out[1]["web"]] == ["https://h0.example/"]
    assert out[2]["n_raw"] == 5 and out[2]["n_kept"] == 4
    assert not out[3]["success"] and out[3]["error"] == "Search provider unavailable"


def test_cached_search_and_actions(spark):
    import datetime as dt
    req = spark.createDataFrame([(1, "alpha"), (2, "beta")], "query_id int, query string").withColumn(
        "limit", F.lit(None).cast("int"))
    for c, t in [("sources", "array<string>"), ("include_domains", "array<string>"), ("exclude_domains", "array<string>"),
                 ("tbs", "string"), ("location", "string"), ("country", "string"), ("timeout", "int")]:
        req = req.withColumn(c, F.lit(None).cast(t))
    req = req.withColumn("summary", F.lit(False))
    keys = {r["query"]: r["cache_key"] for r in S.provider_requests(req).collect()}
    body = json.dumps({"code": 200, "data": {"webPages": {"value": [{"name": "c", "url": "https://c.example/"}]}}})
    cache = spark.createDataFrame([("Search", keys["alpha"], body, dt.datetime(2030, 1, 1))],
                                  "prefix string, key string, value string, expires_at timestamp_ntz")
    called = []

    def provider(calls):
        called.append(sorted(r["query"] for r in calls.collect()))
        return calls.select("cache_key", F.lit(json.dumps({"code": 200, "data": {"webPages": {"value": [
            {"name": "p", "url": "https://p.example/"}]}}})).alias("body"))
    seen, errors = [], []
    actions = [(2, True, lambda df, b: seen.append(df.count())), (1, False, lambda df, b: 1 / 0)]
    out, writes = S.batch_search_cached(req, provider, cache, "2024-01-01 00:00:00", actions=actions,
                                        on_error=errors.append)
    got = {r["query_id"]: r for r in out.collect()}
    assert [w["url"] for w in got[1]["web"]] == ["https://c.example/"]
    assert [w["url"] for w in got[2]["web"]] == ["https://p.example/"]
    assert called[-1] == ["beta"] and seen == [2] and len(errors) == 1
    assert [r["key"] for r in writes.collect()] == [keys["beta"]]
