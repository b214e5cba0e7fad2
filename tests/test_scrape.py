"""Q1 branches on crafted requests: invalid URL, cache hit, blocked host,
fetch failure, unchanged page, unchanged page re-cleaned for AI, changed
page, new page; record snapshot and statistics afterwards."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from webweft.functions.hashing import context_hash
from webweft.plans.scrape import BLOCKED_ERROR, EMPTY_CONTENT, FETCH_FAILED, batch_scrape
from webweft.sources.tables import CRAWL_RECORD

AS_OF = "2024-02-01 00:00:00"
PAGE = "<html><head><title>T {n}</title></head><body><nav>x</nav><p>Body {n} text</p></body></html>"


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_scrape_branches(spark):
    urls = {1: "ftp://bad.example/", 2: "https://cached.example/a", 3: "https://blocked.example/a",
            4: "https://gone.example/a", 5: "https://same.example/a", 6: "https://sameai.example/a",
            7: "https://changed.example/a", 8: "https://new.example/a", 9: "https://empty.example/a"}
    skip = {1: True, 2: True, 3: True, 4: True, 5: True, 6: False, 7: False, 8: False, 9: True}
    req = spark.createDataFrame([(i, u, None, None, skip[i]) for i, u in urls.items()],
                                "request_id long, url string, formats array<string>, wait_until string, skip_ai boolean")
    html = {i: PAGE.format(n=i) for i in (2, 3, 5, 6, 7, 8)}
    fetched = spark.createDataFrame([(urls[i], h) for i, h in html.items()] + [(urls[9], None)],
                                    "url string, html string")
    t0 = dt.datetime(2024, 1, 1)
    rec_rows = [
        (10, urls[5], _sha(html[5]), None, "md5", None, "<p>5</p>", '{"title":"old5"}', "Completed", None, None,
         "HttpClient", 4, t0, t0, t0),
        (11, urls[6], _sha(html[6]), None, "md6", None, "<p>6</p>", None, "Completed", None, None, "HttpClient", 9,
         t0, t0, t0),
        (12, urls[7], _sha("old"), None, "md7", "ai7", "<p>7</p>", None, "Failed", None, "old error", "HttpClient",
         12, t0, t0, t0),
    ]
    records = spark.createDataFrame(rec_rows, CRAWL_RECORD)
    ctx2 = spark.createDataFrame([(urls[2],)], "url string").select(
        context_hash(F.lit(False), F.array(F.lit("markdown")), F.col("url")).alias("k")).first()["k"]
    cache = spark.createDataFrame([("Crawl", ctx2, '{"success":true}', dt.datetime(2024, 3, 1))],
                                  "prefix string, key string, value string, expires_at timestamp_ntz")
    reps = spark.createDataFrame([("blocked.example", 1, 1, dt.datetime(2024, 2, 2), t0, None, t0)],
                                 "domain string, consecutive_failures int, total_failures int, blocked_until timestamp_ntz, "
                                 "last_failure_at timestamp_ntz, last_success_at timestamp_ntz, updated_at timestamp_ntz")

    def cleaner(text):
        return "AI:" + text, {"model": "m", "prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 2,
                              "reasoning_tokens": None, "cache_hit_tokens": 0, "cache_miss_tokens": 1}
    res = batch_scrape(req, fetched, records, cache, reps, None, AS_OF, ai_configured=True, ai_cleaner=cleaner)
    out = {r["request_id"]: r for r in res.responses.collect()}
    assert out[1]["source"] == "invalid" and out[1]["error"] == "Scheme 'ftp' not allowed"
    assert out[2]["source"] == "cache" and out[2]["success"]
    assert out[3]["source"] == "blocked" and out[3]["error"] == BLOCKED_ERROR and out[3]["blocked_until"] is not None
    assert out[4]["source"] == "fetch_failed" and out[4]["error"] == FETCH_FAILED
    assert out[9]["source"] == "empty" and out[9]["error"] == EMPTY_CONTENT
    assert out[5]["source"] == "hash_hit" and out[5]["markdown"] == "md5" and out[5]["crawl_record_id"] == 10
    assert out[6]["source"] == "cleaned" and out[6]["markdown"].startswith("AI:")
    assert out[7]["source"] == "cleaned" and out[8]["source"] == "cleaned"
    assert '"title":"T 8"' in out[8]["metadata"] and out[8]["html"] is None
    recs = {r["url"]: r for r in res.records.collect()}
    assert recs[urls[5]]["stability_count"] == 5                       # unchanged: +1
    assert recs[urls[6]]["stability_count"] == 2                       # +1 then reset(10) = 2
    assert recs[urls[6]]["cleaned_markdown"].startswith("AI:")
    assert recs[urls[7]]["stability_count"] == 2 and recs[urls[7]]["status"] == "Completed"   # reset(12) = 2
    assert recs[urls[7]]["error_message"] == "old error"              # not cleared (kept quirk)
    assert recs[urls[8]]["stability_count"] == 1 and recs[urls[8]]["id"] == 13
    assert recs[urls[4]]["status"] == "Failed" and recs[urls[4]]["id"] == 14       # failed fetch: a Failed row
    assert recs[urls[4]]["error_message"] == FETCH_FAILED and out[4]["crawl_record_id"] == 14
    stats = res.statistics.collect()
    assert sorted(r["crawl_record_id"] for r in stats) == [11, 12, 13]
    hits = sorted(r["url"] for r in res.hit_events.collect())
    assert hits == []                                                  # cache hit and hash hit were without AI
    oc = {r["url"]: r["ok"] for r in res.outcomes.collect()}
    assert oc[urls[4]] is False and oc[urls[8]] is True and urls[3] not in oc and oc[urls[9]] is False
    assert urls[9] not in recs
