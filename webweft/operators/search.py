"""Search flow parts: provider JSON parsing (S7), result cleanup (F4, P21),
rank (W5), top-N (T1), filter chain (F5), counts and warning (A2), ordered
result lists (A6) and the composed batch search (Q2)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webweft.functions.hashing import search_cache_key
from webweft.functions.search import (PROVIDER_ERROR, empty_if_null, freshness, pipe_list,
                                      request_valid, result_count)
from webweft.functions.text import not_blank
from webweft.session import cut_lineage

PROVIDER_SCHEMA = T.StructType([
    T.StructField("code", T.IntegerType()),
    T.StructField("msg", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("webPages", T.StructType([
            T.StructField("value", T.ArrayType(T.StructType([
                T.StructField("name", T.StringType()),
                T.StructField("url", T.StringType()),
                T.StructField("snippet", T.StringType()),
            ]))),
        ])),
    ])),
])

# --- fixed values (provider response field names) --------------------------------
PROVIDER_FIELDS = ["code", "msg", "data", "webPages", "value", "name", "url", "snippet"]
# ---------------------------------------------------------------------------------

UrlFilter = Callable[[DataFrame, str], DataFrame]


def provider_requests(requests: DataFrame, max_count: int = 50) -> DataFrame:
    """The provider-side view of each search request."""
    return requests.select(
        "*",
        request_valid(F.col("query"), F.col("limit"), F.col("timeout")).alias("valid"),
        search_cache_key(F.col("query"), F.col("country"), F.col("location"), F.col("tbs"),
                         F.col("sources"), F.col("include_domains"), F.col("exclude_domains"),
                         F.col("limit")).alias("cache_key"),
        freshness(F.col("tbs")).alias("freshness"),
        result_count(F.col("limit"), max_count).alias("count"),
        pipe_list(F.col("include_domains")).alias("include"),
        pipe_list(F.col("exclude_domains")).alias("exclude"))


def parse_provider(bodies: DataFrame, body_col: str = "body") -> tuple[DataFrame, DataFrame]:
    """S7 + F4 + P21 + W5: ``bodies(cache_key, body)`` → (results with a
    1-based provider ``rank``, failed keys).  Code must be 200 and the list
    present, else the call failed.  Keys are matched case-insensitively by
    lower-casing the JSON field names before parsing."""
    text = F.col(body_col)
    for name in PROVIDER_FIELDS:  # JSON field names are matched case-insensitively
        text = F.regexp_replace(text, f'"(?i:{name})"(\\s*):', f'"{name}"$1:')
    lowered = text
    parsed = bodies.withColumn("_p", F.from_json(lowered, PROVIDER_SCHEMA, {"mode": "PERMISSIVE"}))
    ok = F.coalesce((F.col("_p.code") == 200) & F.col("_p.data.webPages.value").isNotNull(), F.lit(False))
    good = parsed.filter(ok)
    failed = parsed.filter(~ok).select(*[c for c in bodies.columns if c != body_col],
                                       F.coalesce(F.col("_p.msg"), F.lit("Search request failed")).alias("provider_error"))
    items = good.select(*[c for c in bodies.columns if c != body_col],
                        F.posexplode("_p.data.webPages.value").alias("_pos", "_it"))
    items = items.filter(not_blank(F.col("_it.url")))  # F4
    w = F.row_number().over(Window.partitionBy(*[c for c in bodies.columns if c != body_col]).orderBy("_pos"))
    res = items.select(*[c for c in bodies.columns if c != body_col],
                       (F.col("_pos") + 1).cast("int").alias("provider_pos"),
                       w.cast("int").alias("rank"),
                       empty_if_null(F.col("_it.name")).alias("title"),
                       F.col("_it.url").alias("url"),
                       empty_if_null(F.col("_it.snippet")).alias("description"))
    return res, failed


def top_n(results: DataFrame, counts: DataFrame, key: str = "cache_key") -> DataFrame:
    """The provider returns at most ``count`` results (per-row N), counted
    on its own list positions, before any filtering."""
    return (results.join(counts.select(key, "count"), key)
            .filter(F.col("provider_pos") <= F.col("count")).drop("count"))


def apply_filters(results: DataFrame, filters: Sequence[tuple[str, UrlFilter]], url_col: str = "url") -> DataFrame:
    """``blocked_by`` = the first filter (in order) that blocks the URL."""
    out = results.withColumn("blocked_by", F.lit(None).cast("string"))
    for name, fn in filters:
        flagged = fn(out, url_col)
        out = flagged.withColumn("blocked_by", F.coalesce(F.col("blocked_by"),
                                                          F.when(F.col("blocked"), F.lit(name)))).drop("blocked")
    return out


def summarise(results: DataFrame, key: str = "cache_key") -> DataFrame:
    """A2 + A6: raw and kept counts, the warning text, and the kept results
    as an ordered list (at most ``count`` ≤ 50 entries per request)."""
    kept = F.col("blocked_by").isNull()
    return results.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(kept).alias("n_kept"),
        F.array_sort(F.collect_list(F.when(kept, F.struct("rank", "title", "description", "url")))).alias("web"),
    ).withColumn("n_filtered", F.col("n_raw") - F.col("n_kept")).withColumn(
        "warning", F.when(F.col("n_filtered") > 0, F.concat(F.col("n_filtered").cast("string"),
                                                            F.lit(" results filtered"))))


Action = tuple[int, bool, Callable[[DataFrame, int], None]]


def run_actions(raw: DataFrame, actions: Sequence[Action], batch_id: int = 0,
                on_error: Callable[[Exception], None] | None = None) -> None:
    """R6/X4 in batch form: ``(order, synchronous, fn(df, batch_id))`` run in
    order on the raw (unfiltered) results; a failing best-effort action is
    reported and skipped, a failing synchronous one propagates."""
    for _, sync, fn in sorted(actions, key=lambda a: a[0]):
        if sync:
            fn(raw, batch_id)
        else:
            try:
                fn(raw, batch_id)
            except Exception as e:  # noqa: BLE001
                if on_error:
                    on_error(e)


def _finish(req: DataFrame, calls: DataFrame, bodies: DataFrame, filters, validate: bool,
            actions: Sequence[Action], on_error) -> DataFrame:
    results, failed = parse_provider(bodies)
    results = top_n(results, calls)
    if actions:
        run_actions(results, actions, on_error=on_error)
    filtered = apply_filters(results, filters)
    summary = summarise(filtered)
    out = req.join(summary, "cache_key", "left").join(
        failed.select("cache_key", "provider_error"), "cache_key", "left")
    success = F.col("valid") & F.col("provider_error").isNull() if validate else F.col("provider_error").isNull()
    # a call that succeeded without results has an empty list, not a missing one
    for c, empty in (("n_raw", F.lit(0)), ("n_kept", F.lit(0)), ("n_filtered", F.lit(0)),
                     ("web", F.array().cast(summary.schema["web"].dataType))):
        out = out.withColumn(c, F.when(success, F.coalesce(c, empty.cast(summary.schema[c].dataType))).otherwise(F.col(c)))
    return out.select(
        "*", success.alias("success"),
        F.when(F.lit(validate) & ~F.col("valid"), F.lit("Invalid request"))
         .when(F.col("provider_error").isNotNull(), F.lit(PROVIDER_ERROR)).alias("error"))


def _calls(requests: DataFrame, validate: bool, max_count: int):
    req = provider_requests(requests, max_count)
    ok_req = req.filter("valid") if validate else req
    calls = ok_req.dropDuplicates(["cache_key"]).select("cache_key", "query", "count", "freshness", "summary",
                                                        "include", "exclude")
    return req, calls


def batch_search(requests: DataFrame, provider: Callable[[DataFrame], DataFrame],
                 filters: Sequence[tuple[str, UrlFilter]] = (), validate: bool = True,
                 max_count: int = 50, actions: Sequence[Action] = (),
                 on_error: Callable[[Exception], None] | None = None) -> DataFrame:
    """Q2: requests → F2 → P8 de-dup → provider (X3, returns ``(cache_key,
    body)``) → S7/F4 → T1 → after-actions on raw results (X4) → F5 → A2 →
    A6.  Provider failure → ``success=false`` with the fixed error text."""
    req, calls = _calls(requests, validate, max_count)
    # written once: parsing has several outputs, and the provider is asked once per key
    bodies = cut_lineage(provider(calls), "provider_bodies")
    return _finish(req, calls, bodies, filters, validate, actions, on_error)


def batch_search_cached(requests: DataFrame, provider: Callable[[DataFrame], DataFrame], cache: DataFrame,
                        as_of, filters: Sequence[tuple[str, UrlFilter]] = (), validate: bool = True,
                        max_count: int = 50, cache_minutes: float = 60.0, actions: Sequence[Action] = (),
                        on_error: Callable[[Exception], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Q2 with the raw-result cache (J13 on ``prefix = 'Search'``): cached
    raw bodies answer hits, the provider is called for the misses only, and
    filters re-run on both.  Returns ``(responses, cache_writes)``; only
    successful provider bodies are written (TTL ``cache_minutes``)."""
    from webweft.operators.cache import live
    req, calls = _calls(requests, validate, max_count)
    ts = as_of if not isinstance(as_of, str) else F.lit(as_of).cast("timestamp_ntz")
    cached = live(cache, ts).filter(F.col("prefix") == "Search").select(
        F.col("key").alias("cache_key"), F.col("value").alias("body"))
    hit = calls.join(cached, "cache_key")
    fresh = cut_lineage(provider(calls.join(cached.select("cache_key"), "cache_key", "left_anti")), "provider_bodies")
    bodies = hit.select("cache_key", "body").unionByName(fresh.select("cache_key", "body"))
    _, failed = parse_provider(fresh)
    writes = (fresh.join(failed.select("cache_key"), "cache_key", "left_anti")
              .select(F.lit("Search").alias("prefix"), F.col("cache_key").alias("key"), F.col("body").alias("value"),
                      ts.alias("written_at"), F.lit(float(cache_minutes)).alias("ttl_minutes")))
    return _finish(req, calls, bodies, filters, validate, actions, on_error), writes
