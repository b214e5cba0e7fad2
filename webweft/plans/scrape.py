"""Q1: batch scrape.

requests → F1 guard → context hash (P7/P19) → cache lookup (J12/R4) →
reputation gate (J1) → fetched page (S1 / A9) → content hash (P6) →
unchanged split (J7, ``left_anti`` before the clean) → clean (H7, H8)
→ upsert (J8) → statistics (S3) → robots (J10) → responses (S10, P17, P18)
with TTLs (P13 × P14) for the cache writes; domain outcomes (X6) for A3.

Only pages that actually need cleaning are cleaned; repeated requests
for one URL (or one context hash) share a single fetch and clean.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.functions.hashing import context_hash, sha256_hex
from webweft.functions.policy import cache_ttl_minutes, jitter_factor, stability_reset
from webweft.functions.text import not_blank
from webweft.operators import cache as cache_ops
from webweft.operators import clean as clean_ops
from webweft.operators.guard import guard, join_robots
from webweft.operators.html import clean_pages
from webweft.operators.records import assign_ids, one_per_url, upsert_records
from webweft.operators.reputation import reputation_gate
from webweft.session import cut_lineage

# --- fixed values ---------------------------------------------------------------------
BLOCKED_ERROR = ("The website refused the connection, likely due to strict anti-crawling measures. "
                 "This domain will be temporarily avoided.")
FETCH_FAILED = "All fetch tiers failed"
EMPTY_CONTENT = "Fetched content was empty"
DEFAULT_FORMATS = ["markdown"]
CACHE_PREFIX = "Crawl"
DEFAULT_TIER = "HttpClient"
# ----------------------------------------------------------------------------------------


@dataclass
class ScrapeResult:
    responses: DataFrame     # one row per request
    records: DataFrame       # new record snapshot
    statistics: DataFrame    # appended statistic rows (S3)
    cache_writes: DataFrame  # (prefix, key, value, written_at, ttl_minutes)
    hit_events: DataFrame    # (url) per cache/hash hit with AI in effect (S8)
    outcomes: DataFrame      # (url, ok, ts, event_id) for the reputation fold


METADATA_DDL = ("title string, description string, language string, keywords string, robots string, robots_txt string, "
                "og_title string, og_description string, og_url string, og_image string, og_locale_alternate string, "
                "og_site_name string, source_url string, status_code int, content_type string")
# a response as it is stored in the cache and read back
CACHED_RESPONSE = "success boolean, error string, crawl_record_id long, markdown string, html string, metadata string"
RESPONSE_COLS = ["request_id", "url", "success", "error", "blocked_until", "crawl_record_id",
                 "markdown", "html", "metadata", "source"]


def _response(df: DataFrame, source: str, success, error=None, blocked_until=None, record_id=None,
              markdown=None, html=None, metadata=None) -> DataFrame:
    def lit_or(c, t):
        return c if c is not None else F.lit(None).cast(t)
    return df.select(
        "request_id", "url", F.lit(success).alias("success") if isinstance(success, bool) else success.alias("success"),
        lit_or(error, "string").alias("error"), lit_or(blocked_until, "timestamp_ntz").alias("blocked_until"),
        lit_or(record_id, "long").alias("crawl_record_id"),
        lit_or(markdown, "string").alias("markdown"), lit_or(html, "string").alias("html"),
        lit_or(metadata, "string").alias("metadata"), F.lit(source).alias("source"))


def batch_scrape(requests: DataFrame, fetched: DataFrame, records: DataFrame, cache: DataFrame | None,
                 reputations: DataFrame | None, robots: DataFrame | None, as_of, ai_configured: bool = False,
                 ai_cleaner: Callable | None = None, dns: DataFrame | None = None,
                 statistics: DataFrame | None = None) -> ScrapeResult:
    """``requests(request_id, url, formats, skip_ai)``; ``fetched(url, html)``
    (missing URL = fetch failure; a ``fetch_error`` column may carry the A9
    error, a ``fetch_tier`` column its tier); ``records`` a record snapshot;
    ``cache`` a cache snapshot; ``statistics`` the stored statistics, whose ids
    the new rows go on from."""
    now = F.lit(as_of).cast("timestamp_ntz")
    fm = F.coalesce(F.col("formats"), F.array(*[F.lit(x) for x in DEFAULT_FORMATS]))
    req = (requests.withColumn("formats", fm)
           .withColumn("use_ai", F.lit(ai_configured) & ~F.coalesce(F.col("skip_ai"), F.lit(False)))
           .withColumn("context_hash", context_hash(F.col("use_ai"), F.col("formats"), F.col("url"))))
    g = guard(req, dns)
    rejected = _response(g.filter(~F.col("url_ok")), "invalid", False, F.col("url_error"))
    req = g.filter("url_ok").drop("url_ok", "url_error")

    # cache lookup (J12) on the context hash
    if cache is not None:
        lv = cache_ops.live(cache, now).filter(F.col("prefix") == CACHE_PREFIX).select(
            F.col("key").alias("context_hash"), F.col("value").alias("_cached"))
        req = req.join(lv, "context_hash", "left")
    else:
        req = req.withColumn("_cached", F.lit(None).cast("string"))
    cached = req.filter(F.col("_cached").isNotNull())
    c = F.from_json("_cached", CACHED_RESPONSE)
    cached_resp = _response(cached, "cache", F.coalesce(c["success"], F.lit(True)), c["error"], record_id=c["crawl_record_id"],
                            markdown=c["markdown"], html=c["html"], metadata=c["metadata"])
    req = req.filter(F.col("_cached").isNull()).drop("_cached")

    # reputation gate (J1): blocked requests fail fast, not counted as failures
    if reputations is not None:
        req = reputation_gate(req, reputations, now)
    else:
        req = req.withColumn("rep_blocked", F.lit(False)).withColumn("rep_blocked_until",
                                                                     F.lit(None).cast("timestamp_ntz"))
    blocked_resp = _response(req.filter("rep_blocked"), "blocked", False, F.lit(BLOCKED_ERROR),
                             F.col("rep_blocked_until"))
    req = req.filter(~F.col("rep_blocked")).drop("rep_blocked", "rep_blocked_until")

    # fetch (S1): one fetched page per URL
    f = fetched.select("url", "html", F.lit(True).alias("_fetched"),
                       *([F.col("fetch_error")] if "fetch_error" in fetched.columns
                         else [F.lit(None).cast("string").alias("fetch_error")]),
                       *([F.col("fetch_tier")] if "fetch_tier" in fetched.columns
                         else [F.lit(DEFAULT_TIER).alias("fetch_tier")]))
    # its hash meets the requests, the page itself only those that it is cleaned for; written
    # once, as every branch below reads it
    marks = f.withColumn("html_hash", sha256_hex(F.col("html"))).drop("html")
    req = cut_lineage(req.join(marks, "url", "left"), "answered")
    # F8: a failed fetch writes a Failed record; fetched-but-empty content writes none;
    # both count as a domain failure
    failed = req.filter(F.col("_fetched").isNull() | F.col("fetch_error").isNotNull())
    empty = req.filter(F.col("_fetched") & F.col("fetch_error").isNull() & F.col("html_hash").isNull())
    empty_resp = _response(empty, "empty", False, F.lit(EMPTY_CONTENT))
    ok = req.filter(F.col("html_hash").isNotNull())

    # Unchanged page with the same hash → answer from the stored record.  The split is
    # decided on keys and hashes; stored texts and pages are joined to their own side only
    same = records.groupBy("url", "html_hash").agg(F.min("id").alias("_same_id"))
    has_ai = records.filter(F.col("cleaned_markdown").isNotNull()).select(F.col("id").alias("_same_id"), F.lit(True).alias("_has_ai"))
    ok = ok.join(same, ["url", "html_hash"], "left").join(has_ai, "_same_id", "left")
    ok = cut_lineage(ok, "fetched")  # feeds both branches and the upsert: compute once
    kept = F.col("_same_id").isNotNull() & (~F.col("use_ai") | F.coalesce("_has_ai", F.lit(False)))
    stored = records.select(F.col("id").alias("_same_id"), F.col("cleaned_markdown").alias("_s_ai"),
                            F.col("markdown_content").alias("_s_md"), F.col("cleaned_html").alias("_s_html"),
                            F.col("metadata_json").alias("_s_meta"))
    unchanged = ok.filter(kept).join(stored, "_same_id")
    unchanged_resp = _response(
        unchanged, "hash_hit", True, record_id=F.col("_same_id"),
        markdown=F.when(F.array_contains(F.transform("formats", F.lower), "markdown"),
                        F.when(F.col("use_ai"), F.col("_s_ai")).otherwise(F.col("_s_md"))),
        html=F.when(F.array_contains(F.transform("formats", F.lower), "html"), F.col("_s_html")),
        metadata=stored_metadata(F.col("_s_meta"), F.col("url")))
    to_clean = ok.filter(~kept)

    # H7 (+H8) once per distinct (url, html, use_ai): only pages that need it
    pages = to_clean.select("url", "use_ai").distinct().join(f.select("url", "html"), "url")
    cleaned = clean_pages(pages, keep=["url", "use_ai"])
    cleaned = clean_ops.ai_clean(cleaned, ai_cleaner if ai_configured else None, "markdown", "use_ai")
    if robots is not None:
        cleaned = join_robots(cleaned, robots)
    else:
        cleaned = cleaned.withColumn("robots_txt", F.lit(None).cast("string"))
    meta_json = F.to_json(F.col("metadata"))  # stored without robots text (as in the reference)
    cleaned = cleaned.withColumn("metadata_json", meta_json).withColumn(
        "metadata_out", F.to_json(F.col("metadata").withField("robots_txt", F.col("robots_txt"))))
    # the cleaned pages feed five outputs: computed once, into the shared folder
    cleaned = cut_lineage(cleaned, "cleaned")

    fresh = to_clean.join(cleaned, ["url", "use_ai"])
    # J8 upsert: one batch row per URL (first request wins)
    batch = cut_lineage(one_per_url(fresh.select(
        "url", "request_id", "html_hash", now.alias("ts"), "context_hash",
        F.col("markdown").alias("markdown_content"),
        F.when(F.col("ai_cleaned"), F.col("markdown")).alias("cleaned_markdown"),
        "cleaned_html", "metadata_json", "fetch_tier",
        (F.col("_same_id").isNotNull() & F.col("use_ai")).alias("reclean")), ["request_id"]).drop("request_id"), "batch")
    seen = one_per_url(unchanged.select("url", "request_id", "html_hash", now.alias("ts"), "fetch_tier"), ["request_id"])
    merged = _upsert(records, batch, seen.drop("request_id"))
    fail_rows = one_per_url(failed.select(
        "url", "request_id", F.coalesce(F.col("fetch_error"), F.lit(FETCH_FAILED)).alias("error_message"),
        F.coalesce("fetch_tier", F.lit(DEFAULT_TIER)).alias("fetch_tier")), ["request_id"]).drop("request_id")
    new_records = cut_lineage(_append_failures(merged, fail_rows, now), "records")
    fail_ids = (new_records.filter(F.col("status") == "Failed")
                .groupBy("url").agg(F.max("id").alias("_fid")))
    fail_resp = _response(failed.join(fail_ids, "url", "left"), "fetch_failed", False,
                          F.coalesce(F.col("fetch_error"), F.lit(FETCH_FAILED)), record_id=F.col("_fid"))
    ids = new_records.select(F.col("url"), F.col("id").alias("_rid"), F.col("stability_count").alias("_stab"))
    ids = ids.groupBy("url").agg(F.min_by(F.struct("_rid", "_stab"), "_rid").alias("_r")).select(
        "url", F.col("_r._rid").alias("_rid"), F.col("_r._stab").alias("_stab"))
    fresh = fresh.join(ids, "url", "left")
    fresh_resp = _response(
        fresh, "cleaned", True, record_id=F.col("_rid"),
        markdown=F.when(F.array_contains(F.transform("formats", F.lower), "markdown"), F.col("markdown")),
        html=F.when(F.array_contains(F.transform("formats", F.lower), "html"), F.col("cleaned_html")),
        metadata=F.col("metadata_out"))

    responses = (rejected.unionByName(cached_resp).unionByName(blocked_resp).unionByName(fail_resp)
                 .unionByName(empty_resp)
                 .unionByName(unchanged_resp).unionByName(fresh_resp))

    # S3: statistics when the AI step ran and usage is known
    stats = one_per_url(fresh.filter(F.col("ai_cleaned") & F.col("usage").isNotNull()), ["request_id"]).select(
        F.col("_rid").alias("crawl_record_id"), "content_hash", F.lit(0).alias("cache_hit_count"),
        *[F.col(f"usage.{c}").alias(c) for c in clean_ops.USAGE_FIELDS], now.alias("created_at"))

    last_id = statistics.select(F.coalesce(F.max("id"), F.lit(0))).scalar() if statistics is not None else 0
    stats = assign_ids(stats, last_id, ["crawl_record_id"])

    # cache writes: the whole response, with a TTL from the stability of the record that
    # answered (P13 x P14); one write per context hash, the first request's
    answered = fresh_resp.unionByName(unchanged_resp)
    keys = fresh.select("request_id", "context_hash").unionByName(unchanged.select("request_id", "context_hash"))
    stored = F.to_json(F.struct("success", "error", "crawl_record_id", "markdown", "html", "metadata"))
    ttl_src = (answered.join(keys, "request_id").withColumn("value", stored)
               .groupBy("context_hash").agg(F.min_by(F.struct("value", "crawl_record_id"), "request_id").alias("w")))
    stab = new_records.select(F.col("id").alias("_id"), "stability_count")
    cache_writes = ttl_src.join(stab, F.col("w.crawl_record_id") == F.col("_id"), "left").select(
        F.lit(CACHE_PREFIX).alias("prefix"), F.col("context_hash").alias("key"), F.col("w.value").alias("value"),
        now.alias("written_at"), (cache_ttl_minutes(F.coalesce("stability_count", F.lit(1)))
                                  * jitter_factor(F.col("context_hash"))).alias("ttl_minutes"))

    hits = cached.filter("use_ai").select("url").unionByName(unchanged.filter("use_ai").select("url"))
    # one outcome per fetched URL, however many requests shared the fetch
    outcomes = (failed.unionByName(empty).select("url", F.lit(False).alias("ok"))
                .unionByName(fresh.select("url", F.lit(True).alias("ok"))).distinct()
                .withColumn("ts", now).withColumn("event_id", F.xxhash64("url", F.lit(str(as_of)))))
    return ScrapeResult(responses, new_records, stats, cache_writes, hits, outcomes)


def stored_metadata(stored, url):
    """P18 on a stored metadata JSON: the defaults fill what it lacks."""
    m = F.from_json(stored, METADATA_DDL)
    filled = (m.withField("source_url", F.coalesce(m["source_url"], url))
              .withField("status_code", F.coalesce(m["status_code"], F.lit(200)))
              .withField("content_type", F.coalesce(m["content_type"], F.lit("text/html"))))
    empty = F.from_json(F.lit("{}"), METADATA_DDL)
    return F.to_json(F.when(m.isNotNull(), filled).otherwise(
        empty.withField("source_url", url).withField("status_code", F.lit(200)).withField("content_type", F.lit("text/html"))))


def _append_failures(records: DataFrame, fails: DataFrame, now) -> DataFrame:
    """A failed fetch inserts a Failed record (new id above the current
    maximum) with the error text, tier and times."""
    start = records.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    rows = assign_ids(fails, start, ["url"])
    cols = []
    for fld in records.schema.fields:
        c = fld.name
        if c in ("id", "url", "error_message", "fetch_tier"):
            cols.append(F.col(c))
        elif c == "status":
            cols.append(F.lit("Failed").alias(c))
        elif c == "stability_count":
            cols.append(F.lit(0).cast("int").alias(c))
        elif c in ("created_at", "completed_at", "last_accessed_at"):
            cols.append(now.alias(c))
        else:
            cols.append(F.lit(None).cast(fld.dataType).alias(c))
    return records.unionByName(rows.select(*cols))


def _upsert(records: DataFrame, batch: DataFrame, unchanged: DataFrame) -> DataFrame:
    """J8 with the two J7 branches: ``unchanged`` URLs → stability + 1 on the
    same-hash record; ``batch`` rows overwrite the lowest-id record of the URL
    (stability reset, or +1 then reset when an unchanged page is re-cleaned
    for AI) or are inserted with stability 1."""
    plus_one = unchanged.unionByName(batch.filter("reclean").select(*unchanged.columns))
    base = cut_lineage(upsert_records(records, plus_one), "touched")  # read for keys, ids and rows
    return upsert_records(base, batch.drop("reclean"), force_overwrite=True)
