"""Oracle SQL (DuckDB) for each registered query, keyed like ``queries()``."""

from __future__ import annotations

from webweft.plans.oracle_sql import (CTE, RULES, add_minutes, curve, domain, lower_path,
                                      reset, robots_url, verdict_sql, with_ctes)
from webweft.sources.derived import BLOCK_MARKUP

SQL: dict[str, str] = {}

SQL["page_urls"] = f"""SELECT page_id, {domain('url')} AS domain, {lower_path('url')} AS path_lower,
    {robots_url('url')} AS robots_url, sha256(html) AS html_hash FROM pages"""

SQL["blocklist_rules"] = with_ctes(["fx_rule_lines"], """SELECT CASE WHEN is_allow THEN 'allow' ELSE rule_class END AS rule_class,
    count(*) AS n_rules FROM fx_rules GROUP BY 1""", [RULES])

SQL["blocklist_pages"] = with_ctes(["fx_rule_lines"], f"""SELECT page_id, bl_host AS host, bl_allowed AS allowed,
    bl_rule AS blocked_by FROM ({verdict_sql('(SELECT page_id, url FROM pages)')})""", [RULES])

SQL["blocklist_hosts"] = with_ctes(["fx_rule_lines"], f"""SELECT bl_host AS host, count(*) AS n_pages,
    count(*) FILTER (WHERE bl_rule IS NULL) AS n_kept,
    count(*) FILTER (WHERE bl_rule IS NOT NULL) AS n_blocked,
    count(*) FILTER (WHERE bl_rule = 'regex') AS n_regex,
    count(*) FILTER (WHERE regexp_matches(html, '<title>', 'i')) AS n_titled,
    count(DISTINCT sha256(html)) AS n_distinct_html
    FROM ({verdict_sql('(SELECT url, html FROM pages)')}) GROUP BY 1""", [RULES])

# --- reputation -------------------------------------------------------------------------
OUTCOMES = f"fx_out AS (SELECT * FROM (SELECT {domain('url')} AS domain, ok, ts, event_id FROM fx_fetch_log) WHERE domain IS NOT NULL)"
REP = """fx_k AS (
    SELECT domain,
           max(ts) FILTER (WHERE ok) AS ls_t,
           min(ts) FILTER (WHERE NOT ok) AS ff_t
    FROM fx_out GROUP BY domain),
fx_k2 AS (
    SELECT k.domain, k.ls_t, (SELECT max(event_id) FROM fx_out o WHERE o.domain = k.domain AND o.ok AND o.ts = k.ls_t) AS ls_i,
           k.ff_t, (SELECT min(event_id) FROM fx_out o WHERE o.domain = k.domain AND NOT o.ok AND o.ts = k.ff_t) AS ff_i
    FROM fx_k k WHERE k.ff_t IS NOT NULL),
fx_rep0 AS (
    SELECT o.domain,
      CAST(count(*) FILTER (WHERE NOT o.ok AND (k.ls_t IS NULL OR o.ts > k.ls_t OR (o.ts = k.ls_t AND o.event_id > k.ls_i))) AS INTEGER) AS consecutive_failures,
      CAST(count(*) FILTER (WHERE NOT o.ok) AS INTEGER) AS total_failures,
      max(o.ts) FILTER (WHERE NOT o.ok) AS last_failure_at,
      max(o.ts) FILTER (WHERE o.ok AND (o.ts > k.ff_t OR (o.ts = k.ff_t AND o.event_id > k.ff_i))) AS last_success_at
    FROM fx_out o JOIN fx_k2 k ON o.domain = k.domain GROUP BY o.domain),
fx_rep AS (
    SELECT domain, consecutive_failures, total_failures,
      CASE WHEN consecutive_failures > 0 THEN """ + add_minutes("last_failure_at", curve("consecutive_failures", 5.0, 3, 10080.0)) + """ END AS blocked_until,
      last_failure_at, last_success_at, greatest(last_failure_at, last_success_at) AS updated_at
    FROM fx_rep0)"""

SQL["reputation"] = with_ctes(["fx_fetch_log"], "SELECT * FROM fx_rep", [OUTCOMES, REP])

SQL["failure_streak"] = with_ctes(["fx_fetch_log"], """SELECT event_id, domain, CAST(rf - coalesce(max(CASE WHEN ok THEN rf END) OVER w, 0) AS INTEGER) AS streak
    FROM (SELECT *, sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) OVER w AS rf FROM fx_out
          WINDOW w AS (PARTITION BY domain ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    WINDOW w AS (PARTITION BY domain ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", [OUTCOMES])

SQL["reputation_gate"] = with_ctes(["fx_fetch_log", "fx_hits"], f"""SELECT h.event_id, r.blocked_until IS NOT NULL AS rep_blocked,
    r.blocked_until AS rep_blocked_until
    FROM fx_hits h LEFT JOIN (SELECT * FROM fx_rep WHERE blocked_until > TIMESTAMP '2024-01-30 23:00:00') r
      ON {domain('h.url')} = r.domain""", [OUTCOMES, REP])

SQL["block_policy"] = with_ctes(["fx_fetch_log"], f"""SELECT domain, consecutive_failures,
    round({curve('consecutive_failures', 5.0, 3, 10080.0)}, 4) AS block_minutes FROM fx_rep""", [OUTCOMES, REP])

# --- records -----------------------------------------------------------------------------
RUNS = """fx_runs0 AS (
    SELECT url, html_hash, ts, event_id,
           sum(CASE WHEN prev IS NULL OR prev <> html_hash THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_no
    FROM (SELECT *, lag(html_hash) OVER (PARTITION BY url ORDER BY ts, event_id) AS prev FROM fx_crawls)),
fx_runs AS (SELECT url, CAST(run_no AS INTEGER) AS run_no, CAST(count(*) AS INTEGER) AS run_len FROM fx_runs0 GROUP BY url, run_no),
fx_fold AS (
    SELECT url, run_no, run_len AS s FROM fx_runs WHERE run_no = 1
    UNION ALL
    SELECT r.url, r.run_no, greatest(1, least(CAST(floor(f.s / 5) AS INTEGER), 6)) + r.run_len - 1
    FROM fx_fold f JOIN fx_runs r ON r.url = f.url AND r.run_no = f.run_no + 1),
fx_stab AS (
    SELECT r.url, r.n_crawls, r.n_runs, CAST(f.s AS INTEGER) AS stability_count
    FROM (SELECT url, CAST(sum(run_len) AS BIGINT) AS n_crawls, CAST(count(*) AS INTEGER) AS n_runs FROM fx_runs GROUP BY url) r
    JOIN fx_fold f ON f.url = r.url AND f.run_no = r.n_runs)"""

SQL["stability"] = with_ctes(["fx_crawls"], f"""SELECT url, n_crawls, n_runs, stability_count,
    round({curve('stability_count', 60.0, 3, 10080.0)}, 4) AS ttl_minutes,
    {reset('stability_count')} AS reset_to, true AS jitter_in_range FROM fx_stab""",
                             ["RECURSIVE_PLACEHOLDER"])
SQL["stability"] = SQL["stability"].replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_PLACEHOLDER", RUNS)

SQL["content_hash_lookup"] = with_ctes(["fx_crawls", "fx_records"], """SELECT c.event_id, k.same_hash_id
    FROM fx_crawls c LEFT JOIN (SELECT url, html_hash, min(id) AS same_hash_id FROM fx_records GROUP BY 1, 2) k
    ON c.url = k.url AND c.html_hash = k.html_hash""")

SQL["record_upsert"] = with_ctes(["fx_crawls", "fx_records"], """SELECT * FROM (
    SELECT r.id, r.url,
        CASE WHEN p.kind = 'changed' THEN p.nh ELSE r.html_hash END AS html_hash,
        CAST(CASE WHEN p.kind = 'same' THEN r.stability_count + 1
                  WHEN p.kind = 'changed' THEN greatest(1, least(CAST(floor(r.stability_count / 5) AS INTEGER), 6))
                  ELSE r.stability_count END AS INTEGER) AS stability_count,
        CASE WHEN p.kind = 'changed' THEN 'Completed' ELSE r.status END AS status,
        CASE WHEN p.kind IS NOT NULL THEN p.nts ELSE r.last_accessed_at END AS last_accessed_at
    FROM fx_records r LEFT JOIN fx_plan p ON r.id = p.target
    UNION ALL
    SELECT (SELECT coalesce(max(id), 0) FROM fx_records) + row_number() OVER (ORDER BY url) AS id, url, nh AS html_hash,
        1 AS stability_count, 'Completed' AS status, nts AS last_accessed_at
    FROM fx_plan WHERE kind = 'new')""", ["""fx_batch AS (SELECT url, arg_max(html_hash, (ts, event_id)) AS nh, max(ts) AS nts FROM fx_crawls GROUP BY url)""",
    """fx_plan AS (SELECT b.url, b.nh, b.nts, coalesce(s.same_id, f.first_id) AS target,
        CASE WHEN s.same_id IS NOT NULL THEN 'same' WHEN f.first_id IS NOT NULL THEN 'changed' ELSE 'new' END AS kind
        FROM fx_batch b
        LEFT JOIN (SELECT url, html_hash, min(id) AS same_id FROM fx_records GROUP BY 1, 2) s ON s.url = b.url AND s.html_hash = b.nh
        LEFT JOIN (SELECT url, min(id) AS first_id FROM fx_records GROUP BY 1) f ON f.url = b.url)"""])

SQL["latest_ai_record"] = with_ctes(["fx_records"], """SELECT url, arg_max(id, id) AS id, arg_max(cleaned_markdown, id) AS cleaned_markdown
    FROM fx_records WHERE cleaned_markdown IS NOT NULL GROUP BY url""")

SQL["latest_statistic"] = with_ctes(["fx_records", "fx_stats"], """SELECT crawl_record_id, max(id) AS id, arg_max(cache_hit_count, id) AS cache_hit_count
    FROM fx_stats GROUP BY crawl_record_id""")

SQL["record_statistics"] = with_ctes(["fx_records", "fx_stats"], """SELECT r.id, r.url, s.id AS stat_id, s.total_tokens
    FROM fx_records r JOIN fx_stats s ON s.crawl_record_id = r.id""")

SQL["hit_counts"] = with_ctes(["fx_hits"], """SELECT url, CAST(count(*) AS INTEGER) AS hits
    FROM fx_hits WHERE url IS NOT NULL GROUP BY url""")

SQL["hit_flush"] = with_ctes(["fx_hits", "fx_records", "fx_stats"], """SELECT s.id, CAST(s.cache_hit_count + coalesce(d.hits, 0) AS INTEGER) AS cache_hit_count
    FROM fx_stats s LEFT JOIN (
      SELECT st.stat_id, sum(h.hits) AS hits
      FROM (SELECT url, count(*) AS hits FROM fx_hits WHERE url IS NOT NULL GROUP BY url) h
      JOIN (SELECT url, max(id) AS rid FROM fx_records WHERE cleaned_markdown IS NOT NULL GROUP BY url) r ON r.url = h.url
      JOIN (SELECT crawl_record_id, max(id) AS stat_id FROM fx_stats GROUP BY crawl_record_id) st ON st.crawl_record_id = r.rid
      GROUP BY st.stat_id) d ON d.stat_id = s.id""")

# --- cache ----------------------------------------------------------------------------------
SNAP = f"""fx_snap AS (SELECT prefix, key, arg_max(value, (written_at, event_id)) AS value,
    {add_minutes('arg_max(written_at, (written_at, event_id))', 'coalesce(arg_max(ttl_minutes, (written_at, event_id)), 30.0)')} AS expires_at
    FROM fx_cache GROUP BY prefix, key)"""
LIVE = "fx_live AS (SELECT * FROM fx_snap WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-30 23:00:00')"
REQS = "fx_req AS (SELECT event_id AS pos, 'Crawl' AS prefix, CAST(user_id AS VARCHAR) AS key FROM events WHERE event_type = 'purchase')"

SQL["cache_upsert"] = with_ctes(["fx_cache"], "SELECT * FROM fx_snap", [SNAP])
SQL["cache_get_many"] = with_ctes(["fx_cache"], """SELECT r.pos, r.prefix, r.key, l.value FROM fx_req r
    LEFT JOIN fx_live l ON l.prefix = r.prefix AND l.key = r.key""", [SNAP, LIVE, REQS])
SQL["cache_get_or_set"] = with_ctes(["fx_cache"], """SELECT r.pos, r.prefix, r.key,
    coalesce(l.value, 'computed:' || r.key) AS value, l.value IS NOT NULL AS hit
    FROM fx_req r LEFT JOIN fx_live l ON l.prefix = r.prefix AND l.key = r.key""", [SNAP, LIVE, REQS])
SQL["cache_purge"] = with_ctes(["fx_cache"], """SELECT 'purged_live' AS action, count(*) FILTER (WHERE starts_with(prefix || ':' || key, 'Search:')
        AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-30 23:00:00')) AS n FROM fx_snap
    UNION ALL SELECT 'after_purge', count(*) FROM fx_snap WHERE NOT starts_with(prefix || ':' || key, 'Search:')
    UNION ALL SELECT 'deleted_existing', count(*) FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events WHERE event_type = 'signup') d
        WHERE EXISTS (SELECT 1 FROM fx_live l WHERE l.prefix = 'Crawl' AND l.key = d.key AND NOT starts_with(l.prefix || ':' || l.key, 'Search:'))
    UNION ALL SELECT 'after_delete', count(*) FROM fx_snap s WHERE NOT starts_with(prefix || ':' || key, 'Search:')
        AND NOT (s.prefix = 'Crawl' AND s.key IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'signup'))""", [SNAP, LIVE])
SQL["cache_sets"] = """WITH sets AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, event_type AS member FROM events),
    card AS (SELECT key, CAST(count(*) AS INTEGER) AS n_members FROM sets GROUP BY key),
    hv0 AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS field, arg_max(props, (ts, event_id)) AS value FROM events GROUP BY 1, 2),
    hv AS (SELECT key, CAST(count(*) AS INTEGER) AS n_fields, max(value) AS max_value FROM hv0 GROUP BY key),
    probes AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events WHERE event_type = 'view')
    SELECT coalesce(c.key, h.key) AS key, c.n_members, h.n_fields, h.max_value,
           EXISTS (SELECT 1 FROM sets s WHERE s.key = p.key AND s.member = 'purchase') AS contains
    FROM card c FULL JOIN hv h ON c.key = h.key LEFT JOIN probes p ON p.key = coalesce(c.key, h.key)"""
SQL["cache_sets"] = SQL["cache_sets"].replace("EXISTS (SELECT 1 FROM sets s WHERE s.key = p.key AND s.member = 'purchase') AS contains",
    "CASE WHEN p.key IS NULL THEN NULL ELSE EXISTS (SELECT 1 FROM sets s WHERE s.key = p.key AND s.member = 'purchase') END AS contains")
SQL["hash_counter"] = """SELECT 'Stats' AS prefix, CAST(user_id AS VARCHAR) AS key, event_type AS field,
    CAST(sum(coalesce(CASE WHEN event_type = 'error' THEN CAST(floor(value) AS BIGINT) END, 1)) AS BIGINT) AS value
    FROM events GROUP BY 1, 2, 3"""

# --- guard, robots, fetch ---------------------------------------------------------------------
from webweft.plans.oracle_sql import HIER, host, is_blank, not_blank, q, trim_ws  # noqa: E402

SCHEME_ONLY = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
IPV4 = (r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\."
        r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$")


def is_v4(h):
    return f"regexp_matches({h}, {q(IPV4)})"


def is_v6(h):
    s = f"regexp_replace({h}, '^\\[|\\]$', '', 'g')"
    return f"(regexp_matches({s}, '^[0-9A-Fa-f:.]+$') AND contains({s}, ':'))"


def public_ip(h):
    o1 = f"TRY_CAST(regexp_extract({h}, {q(IPV4)}, 1) AS INTEGER)"
    o2 = f"TRY_CAST(regexp_extract({h}, {q(IPV4)}, 2) AS INTEGER)"
    priv = (f"({o1} = 10 OR ({o1} = 172 AND {o2} BETWEEN 16 AND 31) OR ({o1} = 192 AND {o2} = 168) "
            f"OR ({o1} = 169 AND {o2} = 254) OR {o1} = 127 OR {o1} = 0)")
    v6 = f"lower(regexp_replace({h}, '^\\[|\\]$', '', 'g'))"
    v6s = f"regexp_replace({v6}, '(^|:)0+([0-9a-f])', '\\1\\2', 'g')"
    loop = f"(regexp_matches({v6s}, '^(0?:)+1$') OR regexp_matches({v6}, '^(0{{0,4}}:)+ffff:127\\.'))"
    link = f"regexp_matches({v6}, '^fe[89ab][0-9a-f]?:')"
    site = f"regexp_matches({v6}, '^fe[c-f][0-9a-f]?:')"
    return (f"(CASE WHEN {is_v4(h)} THEN NOT {priv} WHEN {is_v6(h)} THEN NOT ({loop} OR {link} OR {site}) END)")


def guard_sql(u, bad_ip):
    scheme = f"(CASE WHEN regexp_matches({u}, {q(SCHEME_ONLY)}) THEN lower(regexp_extract({u}, {q(SCHEME_ONLY)}, 1)) END)"
    has = f"(regexp_matches({u}, {q(HIER)}) AND length(regexp_extract({u}, {q(HIER)}, 2)) > 0)"
    absolute = f"(regexp_matches({u}, {q(SCHEME_ONLY)}) AND ({scheme} NOT IN ('http', 'https') OR {has}))"
    hr = f"regexp_extract({u}, {q(HIER)}, 2)"
    path = f"regexp_extract({u}, {q(HIER)}, 4)"
    is_ip = f"({is_v4(hr)} OR {is_v6(hr)})"
    return (f"CASE WHEN {is_blank(u)} THEN 'URL is required' WHEN NOT {absolute} THEN 'Invalid URL format' "
            f"WHEN {scheme} NOT IN ('http', 'https') THEN 'Scheme ''' || {scheme} || ''' not allowed' "
            f"WHEN contains({path}, '/../') OR ends_with({path}, '/..') THEN 'Path traversal not allowed' "
            f"WHEN {is_ip} AND NOT {public_ip(hr)} THEN 'Internal IP addresses are not allowed' "
            f"WHEN NOT {is_ip} AND {bad_ip} IS NOT NULL THEN 'Host ''' || lower({hr}) || ''' resolves to internal IP (' || {bad_ip} || ')' END")


VARIANTS = f"""fx_variants AS (
    SELECT page_id, 0 AS variant, url FROM pages
    UNION ALL SELECT page_id, 1, regexp_replace(url, '^https?', 'ftp') FROM pages
    UNION ALL SELECT page_id, 2, 'http://' || {domain('url')} || '/a/../b' FROM pages
    UNION ALL SELECT page_id, 3, 'http://' || CAST(page_id * 37 % 224 AS VARCHAR) || '.' || CAST(page_id * 11 % 256 AS VARCHAR) || '.1.9:8080/x' FROM pages
    UNION ALL SELECT page_id, 4, {domain('url')} || '/x' FROM pages
    UNION ALL SELECT page_id, 5, CASE WHEN page_id % 2 = 0 THEN '  ' ELSE 'http://[::1]/x' END FROM pages)"""
BADIP = f"""fx_bad AS (SELECT lower(host) AS h, arg_min(ip, pos) AS bad_ip FROM fx_dns
    WHERE NOT coalesce({public_ip('ip')}, true) GROUP BY 1)"""

SQL["url_guard"] = with_ctes(["fx_dns"], f"""SELECT page_id, variant, err IS NULL AS url_ok, err AS url_error FROM (
    SELECT v.page_id, v.variant, {guard_sql('v.url', 'b.bad_ip')} AS err
    FROM fx_variants v LEFT JOIN fx_bad b ON b.h = {host('v.url')}
    -- other spellings of 127.0.x.y and 9.0.x.y; the last form (a part above 255) is no address at all
    UNION ALL SELECT page_id, variant, CASE WHEN page_id % 3 = 0 AND variant < 10
        THEN 'Internal IP addresses are not allowed' END FROM pages, range(6, 11) AS n(variant))""", [VARIANTS, BADIP])

SQL["robots_join"] = with_ctes(["fx_robots"], f"""SELECT p.page_id, r.robots_txt FROM pages p
    LEFT JOIN fx_robots r ON r.origin = {robots_url('p.url')}""")


def _resolve_sql(proxy: bool) -> str:
    P = "true" if proxy else "false"
    def net(i): return f"coalesce(t{i}.n, false)"
    def longe(i): return f"({net(i)} AND coalesce(t{i}.l >= 200, false))"
    def html(i): return f"({net(i)} AND {not_blank(f't{i}.h')})"
    s1 = longe(1)
    skel1 = f"({net(1)} AND NOT {s1})"
    try2 = f"(NOT {s1} AND {P} AND NOT {skel1})"
    s2 = f"({try2} AND {longe(2)})"
    skel = f"({skel1} OR ({try2} AND {net(2)} AND NOT {s2}))"
    skip3 = f"({skel} AND NOT {net(1)} AND {P})"
    try3 = f"(NOT {s1} AND NOT {s2} AND NOT {skip3})"
    s3 = f"({try3} AND {html(3)})"
    try4 = f"(NOT {s1} AND NOT {s2} AND NOT {s3} AND {P})"
    s4 = f"({try4} AND {html(4)})"
    succ = f"({s1} OR {s2} OR {s3} OR {s4})"
    tier = (f"CAST(CASE WHEN {s1} THEN 1 WHEN {s2} THEN 2 WHEN {s3} THEN 3 WHEN {s4} THEN 4 WHEN {try4} THEN 4 "
            f"WHEN {try3} THEN 3 WHEN {try2} THEN 2 ELSE 1 END AS INTEGER)")
    hsel = f"CASE WHEN {s1} THEN t1.h WHEN {s2} THEN t2.h WHEN {s3} THEN t3.h WHEN {s4} THEN t4.h END"
    tl = f"CAST(CASE WHEN {s1} THEN t1.l WHEN {s2} THEN t2.l END AS INTEGER)"
    err = (f"CASE WHEN NOT {succ} THEN coalesce(CASE WHEN {try4} AND NOT {net(4)} THEN t4.e END, "
           f"CASE WHEN {try3} AND NOT {net(3)} THEN t3.e END, 'All fetch tiers failed') END")
    return f"""SELECT url, {P} AS proxy, {succ} AS success, {tier} AS tier,
        ['HttpClient', 'HttpClientProxy', 'CloakBrowser', 'CloakBrowserProxy'][{tier}] AS tier_name,
        {tl} AS text_len, {err} AS error, sha256({hsel}) AS html_hash FROM fx_tiers"""


TIERS = "fx_tiers AS (SELECT url, " + ", ".join(
    f"arg_max({{'n': network_ok, 'l': text_len, 'h': html, 'e': error}}, event_id) FILTER (WHERE tier = {i}) AS t{i}"
    for i in range(1, 5)) + " FROM fx_attempts GROUP BY url)"

SQL["fetch_resolution"] = with_ctes(["fx_attempts"], _resolve_sql(False) + " UNION ALL " + _resolve_sql(True), [TIERS])

SQL["fetch_error_class"] = with_ctes(["fx_attempts"], """SELECT event_id, CASE WHEN NOT network_ok THEN 'INVALID_URL'
    WHEN status IN (403, 406) THEN 'BOT_BLOCKED' WHEN timed_out THEN 'FETCH_TIMEOUT' ELSE 'FETCH_FAILED' END AS error_code
    FROM fx_attempts""")

# --- search ---------------------------------------------------------------------------------
FRESH = ("CASE WHEN " + is_blank("tbs") + " THEN 'noLimit' "
         "WHEN tbs IN ('qdr:h', 'qdr:d') THEN 'oneDay' WHEN tbs = 'qdr:w' THEN 'oneWeek' "
         "WHEN tbs = 'qdr:m' THEN 'oneMonth' WHEN tbs = 'qdr:y' THEN 'oneYear' "
         "WHEN starts_with(tbs, 'cdr:1,cd_min:') AND list_filter(string_split(tbs, ','), lambda p: starts_with(p, 'cd_min:'))[1] IS NOT NULL "
         "AND list_filter(string_split(tbs, ','), lambda p: starts_with(p, 'cd_max:'))[1] IS NOT NULL "
         "THEN substr(list_filter(string_split(tbs, ','), lambda p: starts_with(p, 'cd_min:'))[1], 8) || '..' || "
         "substr(list_filter(string_split(tbs, ','), lambda p: starts_with(p, 'cd_max:'))[1], 8) ELSE 'noLimit' END")
PARAMS = f"""fx_params AS (SELECT *,
    ({not_blank('query')} AND length(query) <= 500 AND coalesce("limit" BETWEEN 1 AND 100, true)
     AND coalesce(timeout BETWEEN 1000 AND 300000, true)) AS valid,
    sha256(query || '|' || coalesce(country, '') || '|' || coalesce(location, '') || '|' || coalesce(tbs, '') || '|' ||
           CASE WHEN len(sources) > 0 THEN array_to_string(sources, ',') ELSE 'web' END || '|' ||
           coalesce(array_to_string(include_domains, ','), '') || '|' || coalesce(array_to_string(exclude_domains, ','), '') || '|' ||
           coalesce(CAST("limit" AS VARCHAR), '')) AS cache_key,
    {FRESH} AS freshness,
    least(coalesce("limit", 10), 50) AS count,
    CASE WHEN len(include_domains) > 0 THEN array_to_string(include_domains, '|') END AS include,
    CASE WHEN len(exclude_domains) > 0 THEN array_to_string(exclude_domains, '|') END AS exclude
    FROM fx_search_req)"""

SQL["search_params"] = with_ctes(["fx_results", "fx_search_req"],
                                 "SELECT query_id, valid, cache_key, freshness, count, include, exclude FROM fx_params", [PARAMS])

PARSED = f"""fx_parsed_res AS (
    SELECT p.query_id, p.count, p.valid, r.rank AS provider_pos,
        CAST(row_number() OVER (PARTITION BY p.query_id ORDER BY r.rank) AS INTEGER) AS rank,
        coalesce(r.title, '') AS title, r.url, coalesce(r.description, '') AS description
    FROM fx_params p JOIN fx_results r ON p.query = 'query ' || CAST(r.query_id AS VARCHAR)
    WHERE p.query_id % 7 NOT IN (3, 4, 5) AND {not_blank('r.url')})"""

SQL["search_results"] = with_ctes(["fx_results", "fx_search_req"], """SELECT query_id, provider_pos, rank, title, url, description
    FROM fx_parsed_res""", [PARAMS, PARSED])

SQL["search_flow"] = with_ctes(["fx_rule_lines", "fx_fetch_log", "fx_results", "fx_search_req"], f"""SELECT p.query_id,
    p.valid AND (p.query_id % 7 NOT IN (3, 4, 5)) AS success,
    CASE WHEN NOT p.valid THEN 'Invalid request' WHEN p.query_id % 7 IN (3, 4, 5) THEN 'Search provider unavailable' END AS error,
    CASE WHEN p.valid AND p.query_id % 7 NOT IN (3, 4, 5) THEN coalesce(s.n_raw, 0) ELSE s.n_raw END AS n_raw,
    CASE WHEN p.valid AND p.query_id % 7 NOT IN (3, 4, 5) THEN coalesce(s.n_kept, 0) ELSE s.n_kept END AS n_kept,
    CASE WHEN s.n_raw - s.n_kept > 0 THEN CAST(s.n_raw - s.n_kept AS VARCHAR) || ' results filtered' END AS warning,
    CASE WHEN p.valid AND p.query_id % 7 NOT IN (3, 4, 5) THEN coalesce(s.urls, '') ELSE s.urls END AS urls
    FROM fx_params p LEFT JOIN (
        SELECT query_id, count(*) AS n_raw, count(*) FILTER (WHERE NOT blocked) AS n_kept,
               coalesce(string_agg(url, '|' ORDER BY rank) FILTER (WHERE NOT blocked), '') AS urls
        FROM (SELECT v.*, (rp.domain IS NOT NULL OR v.bl_rule IS NOT NULL) AS blocked
              FROM ({verdict_sql('(SELECT * FROM fx_parsed_res WHERE valid AND provider_pos <= count)')}) v
              LEFT JOIN (SELECT domain FROM fx_rep WHERE blocked_until > TIMESTAMP '2024-01-30 23:00:00') rp ON rp.domain = v.bl_host)
        GROUP BY query_id) s ON s.query_id = p.query_id""", [RULES, OUTCOMES, REP, PARAMS, PARSED])

# the raw-result cache changes where bodies come from, not the answers
SQL["search_cached"] = (SQL["search_flow"].replace("(rp.domain IS NOT NULL OR v.bl_rule IS NOT NULL)", "(v.bl_rule IS NOT NULL)")
                        .replace("""
              LEFT JOIN (SELECT domain FROM fx_rep WHERE blocked_until > TIMESTAMP '2024-01-30 23:00:00') rp ON rp.domain = v.bl_host""", ""))

# old rules: even lines; new ones: every twelfth, which are exact hosts.  Path and regex rules go.
SQL["rule_swap"] = with_ctes(["fx_rule_lines"], r"""SELECT CASE WHEN is_allow THEN 'allow' ELSE rule_class END AS rule_class,
    count(*) AS n_rules FROM (
        SELECT DISTINCT rule_class, is_allow, lower(regexp_extract(rule, '^\*://(?:\*\.)?([^/]+)/\*$', 1)) AS host FROM fx_classed
        WHERE (line_no % 2 = 0 AND rule_class IN ('wildcard', 'exact')) OR (line_no % 12 = 1 AND rule_class IS NOT NULL))
    GROUP BY 1""", [RULES])

SQL["scrape_context"] = with_ctes(["fx_scrape_req"], """SELECT request_id, NOT skip_ai AS use_ai,
    sha256('UseAiClean=' || CASE WHEN NOT skip_ai THEN 'True' ELSE 'False' END || '&Formats=' ||
           array_to_string(coalesce(formats, ['markdown']), ',') || '&Url=' || url) AS context_hash,
    len(list_filter(coalesce(formats, ['markdown']), lambda x: lower(x) = 'markdown')) > 0 AS want_markdown,
    len(list_filter(coalesce(formats, ['markdown']), lambda x: lower(x) = 'html')) > 0 AS want_html
    FROM fx_scrape_req""")

# --- text steps -------------------------------------------------------------------------------
_strip = "html"
for _p in (r"""src\s*=\s*['"]data:image/[^'"]+['"]""", r"""src\s*=\s*['"]data:video/[^'"]+['"]""",
           r"""src\s*=\s*['"]data:audio/[^'"]+['"]""", r"""href\s*=\s*['"]data:[^'"]+['"]""", r"url\(data:[^)]+\)"):
    _strip = f"regexp_replace({_strip}, {q(_p)}, '', 'gi')"
SQL["data_uri_strip"] = f"SELECT page_id, sha256({_strip}) AS stripped_hash, length(html) - length({_strip}) AS removed_chars FROM pages"

_ws = "regexp_replace(regexp_replace(regexp_replace(text, ' {2,}', ' ', 'g'), '(?m)[ \\t]+$', '', 'g'), '\\n{2,}', chr(10) || chr(10), 'g')"
SQL["whitespace_normalise"] = f"SELECT doc_id, sha256({_ws}) AS content_hash, length({_ws}) AS n_chars_out FROM documents"

SQL["ai_clean"] = r"""SELECT doc_id, sha256(CASE WHEN asks THEN regexp_replace(replace(text, 'the', 'THE'), '^\s+|\s+$', '', 'g')
        WHEN doc_id % 2 = 0 AND text IS NOT NULL THEN '' ELSE text END) AS markdown_hash,
    CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS content_hash, asks AS ai_cleaned,
    CASE WHEN asks THEN CAST(length(text) AS INTEGER) END AS total_tokens
    FROM (SELECT doc_id, text, doc_id % 2 = 0 AND regexp_matches(coalesce(text, ''), '\S') AS asks FROM documents)"""

# --- HTML: SQL form of H1 title and lang for pages with regular head markup -----------------
_title_raw = "regexp_extract(html, '<head[^>]*>(?s:.*?)<title[^>]*>((?s:.*?))</title>', 1)"
_dec = _title_raw
for _ent, _ch in (("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&#39;", "'"), ("&amp;?", "&")):
    _dec = f"regexp_replace({_dec}, {q(_ent)}, {q(_ch)}, 'g')"
SQL["page_metadata"] = f"""SELECT page_id,
    CASE WHEN regexp_matches(html, '<title') THEN {trim_ws(_dec)} END AS title,
    CASE WHEN regexp_matches(html, '<html[^>]*\\slang="') THEN regexp_extract(html, '<html[^>]*\\slang="([^"]*)"', 1) END AS language,
    CASE WHEN (page_id % 5 = 0 AND has_head) OR (page_id % 5 = 2 AND has_body) THEN 'About <page> ' || page_id END AS description,
    CASE WHEN has_head THEN CASE page_id % 4 WHEN 0 THEN 'noindex' WHEN 1 THEN 'all' WHEN 2 THEN 'none' END END AS robots,
    CASE WHEN has_head AND page_id % 3 = 0 THEN 'It''s ' || page_id END AS og_title,
    CASE WHEN has_head AND page_id % 3 = 0 THEN 'fr_FR, es_ES' ELSE '' END AS og_locale_alternate
    FROM (SELECT *, contains(html, '<head>') AS has_head, contains(html, '<body>') AS has_body FROM pages)"""

# --- Q1: the branch of each request -----------------------------------------------------------
SCRAPED = f"""fx_blocked AS (SELECT h FROM (SELECT {domain('url')} AS h, arg_max(regexp_matches(url, 'casino|pills'), page_id) AS bad
        FROM pages GROUP BY 1) WHERE bad),
fx_scraped AS (SELECT p.page_id AS pid, p.url, p.html, page_id % 3 <> 0 AS use_ai, page_id % 5 <> 4 AS known,
    CASE WHEN __HELD__ THEN 'cache' WHEN b.h IS NOT NULL THEN 'blocked' WHEN contains(url, 'ads-track') THEN 'fetch_failed'
         WHEN page_id % 3 = 0 AND page_id % 5 <> 4 THEN 'hash_hit' ELSE 'cleaned' END AS source
    FROM pages p LEFT JOIN fx_blocked b ON b.h = {domain('url')}),
fx_new AS (SELECT url, (SELECT max(page_id) FROM pages WHERE page_id % 5 <> 4)
        + row_number() OVER (ORDER BY source = 'fetch_failed', url) AS new_id
    FROM fx_scraped WHERE (source = 'cleaned' AND NOT known) OR source = 'fetch_failed')"""
_held = SCRAPED.replace("__HELD__", "contains(url, '/en/') AND ends_with(url, '.html')")

SQL["scrape_sources"] = with_ctes([], """SELECT pid AS request_id, source, source IN ('cache', 'hash_hit', 'cleaned') AS success,
    CASE source WHEN 'blocked' THEN 'The website refused the connection, likely due to strict anti-crawling measures. '
                                    || 'This domain will be temporarily avoided.'
                WHEN 'fetch_failed' THEN 'All fetch tiers failed' END AS error,
    CASE WHEN source IN ('hash_hit', 'cleaned') AND known THEN pid ELSE new_id END AS crawl_record_id,
    CASE WHEN source = 'cache' THEN 'held ' || pid END AS held_markdown
    FROM fx_scraped LEFT JOIN fx_new USING (url)""", [_held])

SQL["scrape_records"] = with_ctes([], """SELECT pid AS id, url,
        CASE WHEN source = 'cleaned' OR pid % 3 = 0 THEN sha256(html) ELSE sha256('old') END AS html_hash,
        CAST(CASE source WHEN 'hash_hit' THEN pid % 9 + 2 WHEN 'cleaned' THEN greatest(1, least((pid % 9 + 1) // 5, 6))
             ELSE pid % 9 + 1 END AS INTEGER) AS stability_count,
        'Completed' AS status, CASE WHEN source = 'cleaned' THEN use_ai ELSE pid % 2 = 0 END AS has_ai
    FROM fx_scraped WHERE known
    UNION ALL SELECT new_id, url, CASE WHEN source = 'cleaned' THEN sha256(html) END, CASE WHEN source = 'cleaned' THEN 1 ELSE 0 END,
        CASE WHEN source = 'cleaned' THEN 'Completed' ELSE 'Failed' END, source = 'cleaned' AND use_ai
    FROM fx_scraped JOIN fx_new USING (url)""", [_held])

SQL["scrape_cached"] = with_ctes([], """SELECT pid AS request_id, source IN ('hash_hit', 'cleaned') AS from_cache,
    CASE WHEN source IN ('hash_hit', 'cleaned') THEN true END AS same_answer FROM fx_scraped""", [SCRAPED.replace("__HELD__", "false")])

AS_OF = "2024-01-30 23:00:00"
SQL["scrape_statistics"] = with_ctes([], """SELECT row_number() OVER (ORDER BY rid) + (SELECT max(page_id) * 10 FROM pages WHERE page_id % 5 <> 4) AS id,
    rid AS crawl_record_id, 0 AS cache_hit_count, 'local-rule' AS model, TIMESTAMP '__AS_OF__' AS created_at, true AS hashed
    FROM (SELECT CASE WHEN known THEN pid ELSE new_id END AS rid FROM fx_scraped LEFT JOIN fx_new USING (url)
          WHERE source = 'cleaned' AND use_ai)""".replace("__AS_OF__", AS_OF), [_held])

# what a batch without a stored reputation leaves: all its outcomes have one time
SQL["scrape_outcomes"] = with_ctes([], f"""SELECT domain, n AS consecutive_failures, n AS total_failures,
    {add_minutes("TIMESTAMP '" + AS_OF + "'", curve('n', 5.0, 3, 10080.0))} AS blocked_until, TIMESTAMP '{AS_OF}' AS last_failure_at
    FROM (SELECT {domain('url')} AS domain, CAST(count(DISTINCT url) AS INTEGER) AS n FROM fx_scraped WHERE source = 'fetch_failed' GROUP BY 1)
    WHERE domain IS NOT NULL""", [_held])

SQL["scrape_hits"] = with_ctes([], """SELECT pid * 10 AS id, CAST(source = 'cache' AND use_ai AND pid % 2 = 0 AS INTEGER) AS cache_hit_count
    FROM fx_scraped WHERE known""", [_held])

SQL["search_actions"] = with_ctes(["fx_results", "fx_search_req"], f"""SELECT {domain('url')} AS host, count(*) AS n_results,
    max(rank) AS deepest_rank FROM fx_parsed_res WHERE valid AND provider_pos <= count GROUP BY 1""", [PARAMS, PARSED])
SQL["stream_search_actions"] = SQL["search_actions"]
SQL["stream_rule_refresh"] = SQL["rule_swap"]

# --- streams: the batch forms -------------------------------------------------------------------
SQL["stream_reputation"] = SQL["reputation"]
SQL["reputation_merge"] = SQL["reputation"]
SQL["stream_stability"] = SQL["stability"].replace(f"""SELECT url, n_crawls, n_runs, stability_count,
    round({curve('stability_count', 60.0, 3, 10080.0)}, 4) AS ttl_minutes,
    {reset('stability_count')} AS reset_to, true AS jitter_in_range FROM fx_stab""", "SELECT url, n_crawls, stability_count FROM fx_stab")
SQL["stream_hit_flush"] = SQL["hit_flush"]


# --- page text rules: stated by positions and containment, element by element ---------------

_IN = r"""(?:[^<>"'']|"[^"]*"|''[^'']*'')*"""
_TAGS = f"</?[a-zA-Z]{_IN}>"


def _attr(name: str) -> str:
    value = f"""regexp_extract(tag, '(?is)[\\s"'']{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1)"""
    return f"""regexp_replace({value}, '^["'']|["'']$', '', 'g')"""


def _without(expr: str, names: list[str]) -> str:
    for n in names:
        expr = f"regexp_replace({expr}, '(?is)<{n}\\b{_IN}>.*?(?:</{n}\\s*>|\\z)', '', 'g')"
    return expr


_NO_COMMENTS = r"regexp_replace(html, '(?s)<!--.*?(?:-->|\z)|<![^>]*>|<\?[^>]*>', '', 'g')"
_BODY = f"regexp_extract(page, '(?is)<body\\b{_IN}>(.*?)(?:</body\\s*>|\\z)', 1)"
_BARE = r"""'(?is)\s+(?:style|class|id|on[a-z]+|data-[a-z0-9_-]+|aria-hidden|role|tabindex|target|rel)(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))?([\s/>])', '\1', 'g'"""
_DROPPED = ", ".join(f"'{t}'" for t in (
    "script style nav footer header aside noscript iframe form img video audio svg canvas input button select textarea "
    "fieldset figure picture source map area").split())
_VOID = "'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr'"
_BLOCKS = "CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '" + m.replace("'", "''") + "'" for i, m in enumerate(BLOCK_MARKUP)) + " END"
# an element is (o, k): o the row of its tag, k its last position; tags are at 2 i and texts at 2 i + 1
SQL["page_boilerplate"] = f"""WITH src AS (SELECT page_id, replace(html, '<body>', '<body>' || {_BLOCKS}) AS html FROM pages),
p AS (SELECT page_id, {_without(_NO_COMMENTS, ["script", "style", "textarea", "iframe"])} AS page FROM src),
b AS (SELECT page_id, {_BODY} AS body FROM p),
l AS (SELECT page_id, [''] || regexp_extract_all(body, '(?s){_TAGS}') AS tags, regexp_split_to_array(body, '(?s){_TAGS}') AS texts FROM b),
r AS (SELECT page_id, i, tags[i] AS tag, texts[i] AS text FROM l, unnest(range(1, len(tags) + 1)) AS u(i)),
t AS (SELECT *, lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9:-]*)', 1)) AS name FROM r),
e AS (SELECT *, starts_with(tag, '</') AND name NOT IN ({_VOID}) AS closes,
        tag <> '' AND NOT starts_with(tag, '</') AS begins,
        tag <> '' AND NOT starts_with(tag, '</') AND name NOT IN ({_VOID}) AND NOT ends_with(tag, '/>') AS opens,
        name IN ({_DROPPED}) OR {_attr('role')} IN ('navigation', 'banner', 'complementary') OR {_attr('aria-hidden')} = 'true'
        OR (name <> 'a' AND (regexp_matches({_attr('style')}, '(?i)display: ?none') OR regexp_matches({_attr('class')}, '(?i)hidden|hide'))) AS bad,
        trim(replace(replace(text, '&nbsp;', ' '), chr(10), ' ')) = '' AS blank FROM t),
bal AS (SELECT *, sum(opens::INT - closes::INT) OVER (PARTITION BY page_id, name ORDER BY i) AS after FROM e),
pair AS (SELECT o.page_id, o.i AS o, min(c.i) AS k, any_value(o.name) AS name FROM bal o JOIN bal c
         ON c.page_id = o.page_id AND c.name = o.name AND c.closes AND c.i > o.i AND c.after = o.after - 1 WHERE o.opens GROUP BY ALL),
around AS (SELECT e.page_id, e.i, count(pair.o) AS depth, min(pair.k) AS inner_end FROM e LEFT JOIN pair
           ON pair.page_id = e.page_id AND pair.o < e.i AND pair.k > e.i GROUP BY ALL),
el AS (SELECT e.page_id, e.i AS o, e.name, e.opens, e.bad, a.depth, CASE
         WHEN NOT e.opens THEN 2 * e.i WHEN pr.k IS NOT NULL THEN 2 * pr.k
         ELSE coalesce(2 * least(a.inner_end, (SELECT min(s.i) FROM e s JOIN around sa ON sa.page_id = s.page_id AND sa.i = s.i
              WHERE s.page_id = e.page_id AND s.i > e.i AND s.opens AND s.name = e.name AND sa.depth = a.depth
              AND e.name IN ('p', 'li', 'td', 'th', 'tr', 'dt', 'dd', 'option'))) - 1, 1000000000) END AS stop
       FROM e JOIN around a ON a.page_id = e.page_id AND a.i = e.i LEFT JOIN pair pr ON pr.page_id = e.page_id AND pr.o = e.i WHERE e.begins),
spared AS (SELECT el.page_id, el.o FROM el JOIN pair l ON l.page_id = el.page_id AND l.name = 'a' AND l.o < el.o AND l.k > el.o
           JOIN around la ON la.page_id = l.page_id AND la.i = l.o WHERE el.depth = la.depth + 1),
cut AS (SELECT page_id, 2 * o AS low, stop AS high FROM el WHERE bad AND NOT EXISTS (
        SELECT 1 FROM spared s WHERE s.page_id = el.page_id AND s.o = el.o)),
words AS (SELECT page_id, 2 * i + 1 AS at FROM e WHERE NOT blank AND NOT EXISTS (
          SELECT 1 FROM cut WHERE cut.page_id = e.page_id AND cut.low <= 2 * e.i + 1 AND cut.high >= 2 * e.i + 1)),
void AS (SELECT page_id, 2 * o AS low, stop AS high FROM el WHERE opens AND name IN ('div', 'span', 'p', 'section', 'article', 'li', 'ul', 'ol')
         AND NOT EXISTS (SELECT 1 FROM words w WHERE w.page_id = el.page_id AND w.at > 2 * el.o AND w.at <= el.stop)),
gone AS (SELECT * FROM cut UNION ALL SELECT * FROM void),
out AS (SELECT e.page_id, e.i,
          CASE WHEN name = 'a' OR EXISTS (SELECT 1 FROM gone g WHERE g.page_id = e.page_id AND g.low <= 2 * e.i AND g.high >= 2 * e.i) THEN ''
               WHEN NOT begins OR EXISTS (SELECT 1 FROM spared s WHERE s.page_id = e.page_id AND s.o = e.i) THEN tag
               ELSE regexp_replace(regexp_replace(tag, {_BARE}), {_BARE}) END AS written,
          CASE WHEN EXISTS (SELECT 1 FROM gone g WHERE g.page_id = e.page_id AND g.low <= 2 * e.i + 1 AND g.high >= 2 * e.i + 1) THEN '' ELSE text END AS shown
        FROM e),
done AS (SELECT page_id, trim(string_agg(written || shown, '' ORDER BY i), ' ') AS html FROM out GROUP BY page_id)
SELECT page_id, length(html) AS cleaned_len, sha256(html) AS cleaned_hash FROM done"""

_PLAIN = r"""replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '(?s)""" + _TAGS.replace("{", "{{").replace("}", "}}") + r"""', '', 'g'),
    '&nbsp;', chr(160)), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"""
SQL["page_text_length"] = f"""WITH src AS (SELECT page_id, CASE page_id % 5
        WHEN 0 THEN replace(html, '<body>', '<body><div id="app"> </div>')
        WHEN 1 THEN substring(html, 1, 900) || '<div data-reactroot>'
        WHEN 2 THEN replace(html, '<body>', '<body><noscript>Please enable JavaScript</noscript>') ELSE html END AS html FROM pages),
p AS (SELECT page_id, {_NO_COMMENTS} AS page FROM src),
b AS (SELECT page_id, CASE WHEN regexp_matches(page, '(?i)<body\\b') THEN {_BODY}
        ELSE regexp_replace(page, '(?is)\\A.*?</head\\s*>|</?html\\b[^>]*>', '', 'g') END AS body FROM p),
x AS (SELECT page_id, body, trim({_PLAIN.format("body")}, ' ') AS every,
        trim({_PLAIN.format(_without("body", ["script", "style", "noscript"]))}, ' ') AS shown FROM b)
SELECT page_id, CAST(CASE WHEN starts_with(every, 'You need to enable JavaScript') OR contains(every, 'Please enable JavaScript')
    OR regexp_matches(body, '(?is)<div[^>]*\\sid="(?:root|app|__next|__nuxt)"[^>]*>\\s*</div')
    OR (length(shown) < 500 AND (regexp_matches(body, 'data-reactroot|__NEXT_DATA__|ng-version')
        OR NOT regexp_matches(body, '(?i)<(?:p|h[1-6]|article|main|section|li|td|th)\\b'))) THEN 0 ELSE length(shown) END AS INTEGER) AS text_len
FROM x"""

# items at depths 1, 2, 3, 2, 1, 2: two of the outer list in each cycle of six; the inner list holds two, then one
SQL["page_lists"] = """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS words FROM documents),
i AS (SELECT doc_id, words[j + 1] AS word, j, [1, 2, 3, 2, 1, 2][j % 6 + 1] AS depth,
        CASE j % 6 WHEN 0 THEN j // 6 * 2 + 1 WHEN 4 THEN j // 6 * 2 + 2 WHEN 2 THEN 5 WHEN 3 THEN 2 ELSE 1 END AS number
      FROM w, unnest(range(len(words))) AS u(j)),
l AS (SELECT doc_id, string_agg(repeat('    ', depth - 1) || CASE WHEN depth = 3 OR depth % 2 <> doc_id % 2 THEN number || '. ' ELSE '- ' END || word,
        chr(10) ORDER BY j) AS lines FROM i GROUP BY doc_id),
m AS (SELECT doc_id, '## Words' || chr(10) || chr(10) || coalesce(lines || chr(10) || chr(10), '') || 'End' AS md FROM w LEFT JOIN l USING (doc_id))
SELECT doc_id, length(md) AS markdown_len, sha256(md) AS markdown_hash FROM m"""

SQL["stream_dedup"] = """WITH RECURSIVE work AS (
  SELECT user_id, min({'ts': ts, 'id': event_id}) AS f FROM events WHERE ts IS NOT NULL GROUP BY user_id
  UNION ALL
  SELECT w.user_id, min({'ts': e.ts, 'id': e.event_id}) FROM work w JOIN events e
    ON e.user_id = w.user_id AND e.ts >= w.f.ts + INTERVAL 1 DAY GROUP BY w.user_id)
SELECT event_id AS request_id, f IS NOT NULL OR ts IS NULL AS does_work, f.ts + INTERVAL 1 DAY AS until
FROM events e LEFT JOIN work w ON w.user_id = e.user_id AND w.f.id = e.event_id"""

SQL["record_buckets"] = SQL["record_upsert"].replace("SELECT * FROM (", "SELECT url, html_hash, stability_count, status, last_accessed_at FROM (", 1)
SQL["blocklist_regex"] = f"""WITH r AS (
  SELECT DISTINCT page_id % 4 = 0 AS is_allow, replace({domain('url')}, '.', '\\.') || '/(?:[a-z]+/)?.*[?&]page=' || (page_id % 5) AS pattern
  FROM pages WHERE {domain('url')} IS NOT NULL),
u AS (SELECT DISTINCT url FROM pages),
f AS (SELECT url, bool_or(is_allow) AS rx_allow, bool_or(NOT is_allow) AS rx_block
      FROM u JOIN r ON regexp_matches(url, '(?i)' || pattern) GROUP BY url)
SELECT page_id, coalesce(rx_allow, false) AS rx_allow, coalesce(rx_block, false) AS rx_block FROM pages LEFT JOIN f USING (url)"""
