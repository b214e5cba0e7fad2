"""Deterministic views derived from the driver tables (see FIXTURES.md §2).

Each view has the same definition as the CTE of the same name in
``webweft.plans.oracle_sql``; its size grows with the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webweft.functions.urls import extract_domain, lower_path, robots_url
from webweft.sources.tables import read_dealt, read_table


def _site_url(user_id) -> F.Column:
    return F.concat(F.lit("https://site"), F.col(user_id).cast("string"), F.lit(".example.com/p"))


def fx_fetch_log(spark: SparkSession, sf: str) -> DataFrame:
    """Fetch outcomes: one host per user; ok = purchase."""
    ev = read_table(spark, sf, "events")
    return ev.select(_site_url("user_id").alias("url"), (F.col("event_type") == "purchase").alias("ok"),
                     F.col("ts"), F.col("event_id"))


def fx_crawls(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl history: the page content changes at every error event of the user."""
    ev = read_table(spark, sf, "events")
    w = (Window.partitionBy("user_id").orderBy("ts", "event_id")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    html = F.concat(F.lit("v"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w)
                    .cast("string"))
    return (ev.select(_site_url("user_id").alias("url"), html.alias("html"), "ts", "event_id")
            .withColumn("html_hash", F.sha2("html", 256)))


def fx_hits(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events")
    return (ev.filter(F.col("event_type") == "view")
            .select(_site_url("user_id").alias("url"), "event_id", "ts"))


def fx_records(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl records: one per click event; every 2nd lacks AI Markdown."""
    ev = read_table(spark, sf, "events").filter(F.col("event_type") == "click")
    eid = F.col("event_id")
    return ev.select(
        eid.alias("id"),
        _site_url("user_id").alias("url"),
        F.sha2(F.concat(F.lit("v"), (eid % 7).cast("string")), 256).alias("html_hash"),
        F.sha2(F.concat(F.lit("ctx"), F.col("user_id").cast("string")), 256).alias("context_hash"),
        F.concat(F.lit("md "), F.col("props")).alias("markdown_content"),
        F.when(eid % 2 == 0, F.concat(F.lit("clean "), F.col("props"))).alias("cleaned_markdown"),
        F.concat(F.lit("<p>"), F.col("props"), F.lit("</p>")).alias("cleaned_html"),
        F.concat(F.lit('{"Title":"t'), F.col("user_id").cast("string"), F.lit('"}')).alias("metadata_json"),
        F.lit("Completed").alias("status"),
        F.lit(None).cast("string").alias("error_code"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit("HttpClient").alias("fetch_tier"),
        ((F.floor(F.col("value")).cast("long") % 10) + 1).cast("int").alias("stability_count"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("completed_at"),
        F.col("ts").alias("last_accessed_at"),
    )


def fx_stats(spark: SparkSession, sf: str) -> DataFrame:
    """0-2 statistics per record (record id mod 3)."""
    rec = fx_records(spark, sf)
    k = F.explode(F.filter(F.array(F.lit(0), F.lit(1)), lambda x: x < (F.col("id") % 3)))
    s = rec.select("id", "created_at", k.alias("k"))
    rid = F.col("id")
    return s.select(
        (rid * 3 + F.col("k")).alias("id"),
        rid.alias("crawl_record_id"),
        F.sha2(F.concat(F.lit("c"), rid.cast("string")), 256).alias("content_hash"),
        F.col("k").cast("int").alias("cache_hit_count"),
        (rid % 100).cast("int").alias("prompt_tokens"),
        (rid % 50).cast("int").alias("completion_tokens"),
        ((rid % 100) + (rid % 50)).cast("int").alias("total_tokens"),
        F.lit(None).cast("int").alias("reasoning_tokens"),
        (rid % 10).cast("int").alias("cache_hit_tokens"),
        ((rid % 100) - (rid % 10)).cast("int").alias("cache_miss_tokens"),
        F.lit("m1").alias("model"),
        F.col("created_at"),
    )


def fx_results(spark: SparkSession, sf: str) -> DataFrame:
    """Search results: 25 pages per query, provider order by page id."""
    pg = read_table(spark, sf, "pages")
    pid = F.col("page_id")
    w = Window.partitionBy("query_id").orderBy("page_id")
    return (pg.select(
        F.floor(pid / 25).cast("long").alias("query_id"), "page_id",
        F.when(pid % 9 == 0, F.lit(None)).otherwise(F.concat(F.lit("title "), pid.cast("string"))).alias("title"),
        F.when(pid % 13 == 0, F.lit("  ")).otherwise(F.col("url")).alias("url"),
        F.when(pid % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("about "), pid.cast("string"))).alias("description"))
        .withColumn("rank", F.row_number().over(w).cast("int"))
        .drop("page_id"))


# --- fixed values (request forms cycled through by the derived requests) ------
TBS_FORMS = [None, "", "qdr:h", "qdr:d", "qdr:w", "qdr:m", "qdr:y",
             "cdr:1,cd_min:2024-01-01,cd_max:2024-02-01", "cdr:1,cd_min:2024-01-01", "qdr:x"]
LIMIT_FORMS = [None, 0, 1, 5, 10, 50, 51, 100, 101]
# -----------------------------------------------------------------------------


def _pick(forms, idx: F.Column, cast: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(x).cast(cast) for x in forms]),
                        (idx % len(forms) + 1).cast("int"))


def fx_search_req(spark: SparkSession, sf: str) -> DataFrame:
    """One search request per result query id."""
    res = fx_results(spark, sf).select("query_id").distinct()
    q = F.col("query_id")
    return res.select(
        q,
        F.when(q % 17 == 5, F.lit("   ")).when(q % 17 == 6, F.repeat(F.lit("x"), 501))
        .otherwise(F.concat(F.lit("query "), q.cast("string"))).alias("query"),
        _pick(LIMIT_FORMS, q, "int").alias("limit"),
        F.when(q % 3 == 0, F.array(F.lit("web"), F.lit("news"))).when(q % 3 == 1, F.array().cast("array<string>"))
        .alias("sources"),
        F.when(q % 4 == 0, F.array(F.lit("a.com"), F.lit("b.org"))).alias("include_domains"),
        F.when(q % 5 == 0, F.array(F.lit("c.net"))).when(q % 5 == 1, F.array().cast("array<string>"))
        .alias("exclude_domains"),
        _pick(TBS_FORMS, q, "string").alias("tbs"),
        F.when(q % 2 == 0, F.lit("Berlin")).alias("location"),
        F.when(q % 3 == 2, F.lit("de")).alias("country"),
        (q % 2 == 1).alias("summary"),
        F.when(q % 6 == 0, F.lit(None)).when(q % 6 == 1, F.lit(500)).otherwise(F.lit(60000)).cast("int")
        .alias("timeout"),
    )


def fx_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Cache writes: key = user id, value = props, TTL = value minutes."""
    ev = read_table(spark, sf, "events")
    return ev.select(
        F.when(F.col("event_type").isin("view", "click"), F.lit("Crawl")).otherwise(F.lit("Search")).alias("prefix"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
        F.col("ts").alias("written_at"),
        F.col("value").alias("ttl_minutes"),
        F.col("event_id"))


def fx_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Fetch attempts on four tiers, one per event."""
    ev = read_table(spark, sf, "events")
    et = F.col("event_type")
    return ev.select(
        _site_url("user_id").alias("url"),
        ((F.col("event_id") % 4) + 1).cast("int").alias("tier"),
        (et != "error").alias("network_ok"),
        F.floor(F.col("value") * 20).cast("int").alias("text_len"),
        F.when(et == "error", F.lit(None)).when(F.col("value") < 5, F.lit(" ")).otherwise(F.col("props")).alias("html"),
        F.when(et == "error", F.concat(F.lit("err "), F.col("event_id").cast("string"))).alias("error"),
        F.when(et == "signup", F.lit(403)).when(et == "click", F.lit(200)).otherwise(F.lit(500)).alias("status"),
        (F.col("value") > 45).alias("timed_out"),
        F.col("event_id"))


def fx_rule_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Blocklist subscription text derived from page URLs: every rule form,
    allow rules, comments, blanks, unsupported lines and bad regexes."""
    pg = (read_table(spark, sf, "pages").select("page_id", "url")
          .withColumn("_h", extract_domain(F.col("url")))
          .withColumn("_lp", lower_path(F.col("url"))))
    host = F.col("_h")
    seg = F.regexp_extract(F.col("_lp"), "^(/[^/]*)", 1)
    pid = F.col("page_id")
    hre = F.regexp_replace(host, r"\.", r"\\.")
    line = (F.when(pid % 12 == 0, F.concat(F.lit("*://*."), host, F.lit("/*")))
            .when(pid % 12 == 1, F.concat(F.lit("*://"), F.upper(host), F.lit("/*")))
            .when(pid % 12 == 2, F.concat(F.lit("  *://"), host, seg, F.lit("/*  ")))
            .when(pid % 12 == 3, F.concat(F.lit("*://*."), host, F.col("_lp")))
            .when(pid % 12 == 4, F.concat(F.lit("@*://*."), host, F.lit("/*")))
            .when(pid % 12 == 5, F.concat(F.lit("/"), hre, F.lit(r"/[a-z]{2}/\d+\?page=/")))
            .when(pid % 12 == 6, F.concat(F.lit("! "), host))
            .when(pid % 12 == 7, F.concat(F.lit("# "), host))
            .when(pid % 12 == 8, F.lit("   "))
            .when(pid % 12 == 9, host)
            .when(pid % 12 == 10, F.concat(F.lit("/("), hre, F.lit("/")))
            .otherwise(F.concat(F.lit("@ *://"), host, F.lit("/*"))))
    return pg.select(F.lit("pages").alias("source"), pid.cast("int").alias("line_no"), line.alias("line"))


def fx_meta_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with meta tags: a description in the head, in the body or blank in the head and
    given in the body; robots by name, by property or not; Open Graph fields on every third page."""
    pg = read_table(spark, sf, "pages").select("page_id", "html")
    pid = F.col("page_id")
    n = pid.cast("string")
    described = F.concat(F.lit('<meta content="About &lt;page&gt; '), n, F.lit('" name=description>'))
    blank = F.lit("<meta name='description' content=' '>")
    robots = (F.when(pid % 4 == 0, F.lit('<META NAME="Robots" CONTENT=" noindex ">'))
              .when(pid % 4 == 1, F.lit("<meta property='robots' content='all'><meta name='other' content='x > y'>"))
              .when(pid % 4 == 2, F.lit('<meta property="robots" content="all"><meta name="robots" content="none">'))
              .otherwise(F.lit("")))
    graph = F.when(pid % 3 == 0, F.concat(
        F.lit('<meta property="og:title" content="It&#39;s '), n,
        F.lit('"><meta property="og:locale:alternate" content="fr_FR"><meta property="og:locale:alternate" content="">'
              '<meta property="og:locale:alternate" content="es_ES">'))).otherwise(F.lit(""))
    head = F.concat(F.when(pid % 5 == 0, described).when(pid % 5 == 1, blank).otherwise(F.lit("")), robots, graph)
    body = F.when((pid % 5 == 1) | (pid % 5 == 2), described).otherwise(F.lit(""))
    html = F.replace(F.replace(F.col("html"), F.lit("<head>"), F.concat(F.lit("<head>"), head)),
                     F.lit("<body>"), F.concat(F.lit("<body>"), body))
    return pg.select("page_id", html.alias("html"))


# Markup that the given pages lack, put behind the body's start by page_id: hidden parts, links
# around elements, empty containers, and elements that nothing closes.  Fixed values: the SQL states them too.
BLOCK_MARKUP = [
    '<div style="display: none">no<p>no</div><div class="x hidden-xs">no</div><p title="t" class="c" id="i">yes</p>',
    '<a href="/x"><img src="y" class="c"></a><a><span class="hidden" id="i">x<b id="j">y</b><img src="z"></span></a><img src="z">',
    '<div><span> </span><br></div><ul><li>a<li><li>b<li></ul><p>&nbsp;</p><section><h2></h2></section>',
    '<ul><li class=hide>a<ul><li>b</li></ul><li>c</ul><section><form>x<p>y</section>',
    '<div role="banner">no</div><div role="Banner">yes</div><div aria-hidden=true>no<div>no</div></div></nav></p>',
    '<div>a<span><p></div><table><tr><td class=hide>a<td>b<tr><td>c</table><svg><g>no</g></svg>',
    '<a aria-hidden="true"><img src="y">t</a><a><nav id="n">in<nav>out</nav></nav></a>',
]


def fx_block_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with further markup for boilerplate removal."""
    pg = read_table(spark, sf, "pages").select("page_id", "html")
    extra = F.element_at(F.array(*[F.lit(m) for m in BLOCK_MARKUP]), (F.col("page_id") % len(BLOCK_MARKUP) + 1).cast("int"))
    return pg.select("page_id", F.replace(F.col("html"), F.lit("<body>"), F.concat(F.lit("<body>"), extra)).alias("html"))


# What stands before a list item of a nested list, by its place in a cycle of six: items at the
# depths 1, 2, 3, 2, 1, 2.  Fixed values.
LIST_STEPS = ["</li>{inner_end}</li>", "{inner}", '<OL class="x" start="5">', "</li></OL></li>", "</li>{inner_end}</li>", "{inner}"]


def fx_list_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's words of letters as items of nested lists: numbered ones with bullets in
    them on even ids, bullets with numbered ones in them on odd ids, and numbers from 5 in both."""
    docs = read_dealt(spark, sf, "documents", "doc_id")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))

    def page(outer: str, inner: str):
        before = F.array(*[F.lit(x.format(inner=f"<{inner}>", inner_end=f"</{inner}>")) for x in LIST_STEPS])
        items = F.transform(F.col("words"), lambda w, j: F.concat(
            F.when(j == 0, F.lit("")).otherwise(F.element_at(before, (j % len(LIST_STEPS) + 1).cast("int"))), F.lit("<li>\n <p>"), w, F.lit("</p> ")))
        close = {1: "</li>", 2: f"</li></{inner}></li>", 3: f"</li></OL></li></{inner}></li>"}
        last = (F.size("words") - 1) % len(LIST_STEPS)
        end = F.when(last.isin(0, 4), close[1]).when(last == 2, close[3]).otherwise(close[2])
        body = F.concat(F.lit(f"<{outer}>"), F.array_join(items, ""), end, F.lit(f"</{outer}>"))
        return F.when(F.size("words") > 0, body).otherwise(F.lit(""))

    made = F.when(F.col("doc_id") % 2 == 0, page("ol", "ul")).otherwise(page("ul", "ol"))
    return (docs.select("doc_id", words.alias("words"))
            .select("doc_id", F.concat(F.lit("<h2>Words</h2>"), made, F.lit("<p>End</p>")).alias("html")))


def fx_dns(spark: SparkSession, sf: str) -> DataFrame:
    """Host → address table (several addresses per host, some private)."""
    pg = read_table(spark, sf, "pages")
    pid = F.col("page_id")
    ip = F.concat_ws(".", ((pid * 37) % 224).cast("string"), ((pid * 11) % 256).cast("string"),
                     (pid % 256).cast("string"), F.lit("7"))
    return pg.select(extract_domain(F.col("url")).alias("host"), ip.alias("ip"), pid.alias("pos"))


def fx_scrape_req(spark: SparkSession, sf: str) -> DataFrame:
    pg = read_table(spark, sf, "pages")
    pid = F.col("page_id")
    fmts = (F.when(pid % 4 == 0, F.lit(None).cast("array<string>"))
            .when(pid % 4 == 1, F.array(F.lit("markdown")))
            .when(pid % 4 == 2, F.array(F.lit("Markdown"), F.lit("HTML")))
            .otherwise(F.array(F.lit("html"))))
    return pg.select(pid.alias("request_id"), "url", fmts.alias("formats"),
                     F.lit(None).cast("string").alias("wait_until"), (pid % 3 == 0).alias("skip_ai"))


def fx_robots(spark: SparkSession, sf: str) -> DataFrame:
    """robots.txt for the ``www.`` and ``blog.`` origins (others have none)."""
    pg = read_table(spark, sf, "pages")
    o = pg.groupBy(robots_url(F.col("url")).alias("origin")).agg(F.min("page_id").alias("first_id"))
    return (o.filter(F.col("origin").rlike(r"^https?://(www|blog)\."))
            .select("origin", F.concat(F.lit("User-agent: *\nDisallow: /private/"),
                                       F.col("first_id").cast("string")).alias("robots_txt")))
