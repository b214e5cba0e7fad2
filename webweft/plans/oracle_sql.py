"""DuckDB SQL for the independent oracle.

Only the driver tables are registered on the oracle side, so every derived
view (``fx_*``) is spelled out again here as a CTE with the same definition
as in ``webweft.sources.derived``.  Helper functions return SQL expression
text for a given column expression.
"""

from __future__ import annotations

HIER = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has_auth(u: str) -> str:
    return f"(regexp_matches({u}, {q(HIER)}) AND length(regexp_extract({u}, {q(HIER)}, 2)) > 0)"


def host(u: str) -> str:
    return f"(CASE WHEN {has_auth(u)} THEN lower(regexp_extract({u}, {q(HIER)}, 2)) END)"


def domain(u: str) -> str:
    return f"coalesce({host(u)}, {host(f'(' + chr(39) + 'https://' + chr(39) + ' || ' + u + ')')})"


def abs_or_https(u: str) -> str:
    return f"(CASE WHEN {has_auth(u)} THEN {u} ELSE 'https://' || {u} END)"


def lower_path(u: str) -> str:
    a = abs_or_https(u)
    p0 = f"(CASE WHEN {has_auth(a)} THEN regexp_extract({a}, {q(HIER)}, 4) END)"
    p = f"(CASE WHEN {p0} = '' THEN '/' ELSE {p0} END)"
    segs = f"string_split(substr({p}, 2), '/')"
    fold = (f"list_reduce({segs}, lambda acc, s: CASE WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') "
            f"WHEN s = '.' THEN acc ELSE acc || '/' || s END, '')")
    tail = f"(CASE WHEN {segs}[-1] IN ('.', '..') THEN '/' ELSE '' END)"
    col = f"({fold} || {tail})"
    return (f"lower(CASE WHEN contains({p}, '/.') THEN (CASE WHEN {col} = '' THEN '/' ELSE {col} END) "
            f"ELSE {p} END)")


def robots_url(u: str) -> str:
    return (f"(CASE WHEN {has_auth(u)} THEN lower(regexp_extract({u}, {q(HIER)}, 1)) || '://' || "
            f"lower(regexp_extract({u}, {q(HIER)}, 2)) || '/robots.txt' END)")


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def not_blank(x: str) -> str:
    return f"({x} IS NOT NULL AND regexp_matches({x}, '\\S'))"


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR NOT regexp_matches({x}, '\\S'))"


def curve(n: str, base: float, t: int, cap: float) -> str:
    n = f"CAST({n} AS DOUBLE)"
    at_t = f"({base} * (1 + log2({t} + 1)))"
    raw = (f"(CASE WHEN {n} <= {t} THEN {base} * (1 + log2(greatest({n}, 0) + 1)) "
           f"ELSE {at_t} * pow(2, {n} - {t}) END)")
    return f"least({raw}, {cap})"


def reset(s: str) -> str:
    return f"greatest(1, least(CAST(floor({s} / 5) AS INTEGER), 6))"


def add_minutes(ts: str, minutes: str) -> str:
    return f"({ts} + to_microseconds(CAST(floor(({minutes}) * 60000000.0) AS BIGINT)))"


SITE = "'https://site' || CAST(user_id AS VARCHAR) || '.example.com/p'"

# --- derived views (mirror webweft.sources.derived) ---------------------------
CTE = {
    "fx_fetch_log": f"SELECT {SITE} AS url, event_type = 'purchase' AS ok, ts, event_id FROM events",
    "fx_crawls": f"""SELECT url, html, ts, event_id, sha256(html) AS html_hash FROM (
        SELECT {SITE} AS url,
               'v' || CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (
                   PARTITION BY user_id ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR) AS html,
               ts, event_id FROM events)""",
    "fx_hits": f"SELECT {SITE} AS url, event_id, ts FROM events WHERE event_type = 'view'",
    "fx_records": f"""SELECT event_id AS id, {SITE} AS url,
        sha256('v' || CAST(event_id % 7 AS VARCHAR)) AS html_hash,
        sha256('ctx' || CAST(user_id AS VARCHAR)) AS context_hash,
        'md ' || props AS markdown_content,
        CASE WHEN event_id % 2 = 0 THEN 'clean ' || props END AS cleaned_markdown,
        '<p>' || props || '</p>' AS cleaned_html,
        '{{"Title":"t' || CAST(user_id AS VARCHAR) || '"}}' AS metadata_json,
        'Completed' AS status, CAST(NULL AS VARCHAR) AS error_code, CAST(NULL AS VARCHAR) AS error_message,
        'HttpClient' AS fetch_tier,
        CAST(CAST(floor(value) AS BIGINT) % 10 + 1 AS INTEGER) AS stability_count,
        ts AS created_at, ts AS completed_at, ts AS last_accessed_at
        FROM events WHERE event_type = 'click'""",
    "fx_stats": """SELECT id * 3 + k AS id, id AS crawl_record_id,
        sha256('c' || CAST(id AS VARCHAR)) AS content_hash, CAST(k AS INTEGER) AS cache_hit_count,
        CAST(id % 100 AS INTEGER) AS prompt_tokens, CAST(id % 50 AS INTEGER) AS completion_tokens,
        CAST(id % 100 + id % 50 AS INTEGER) AS total_tokens, CAST(NULL AS INTEGER) AS reasoning_tokens,
        CAST(id % 10 AS INTEGER) AS cache_hit_tokens, CAST(id % 100 - id % 10 AS INTEGER) AS cache_miss_tokens,
        'm1' AS model, created_at
        FROM (SELECT id, created_at, unnest(list_filter([0, 1], lambda x: x < id % 3)) AS k FROM fx_records)""",
    "fx_results": """SELECT query_id,
        CASE WHEN page_id % 9 = 0 THEN NULL ELSE 'title ' || CAST(page_id AS VARCHAR) END AS title,
        CASE WHEN page_id % 13 = 0 THEN '  ' ELSE url END AS url,
        CASE WHEN page_id % 11 = 0 THEN NULL ELSE 'about ' || CAST(page_id AS VARCHAR) END AS description,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS INTEGER) AS rank
        FROM (SELECT CAST(floor(page_id / 25) AS BIGINT) AS query_id, page_id, url FROM pages)""",
    "fx_search_req": """SELECT query_id,
        CASE WHEN query_id % 17 = 5 THEN '   ' WHEN query_id % 17 = 6 THEN repeat('x', 501)
             ELSE 'query ' || CAST(query_id AS VARCHAR) END AS query,
        CAST([NULL, 0, 1, 5, 10, 50, 51, 100, 101][query_id % 9 + 1] AS INTEGER) AS "limit",
        CASE WHEN query_id % 3 = 0 THEN ['web', 'news'] WHEN query_id % 3 = 1 THEN CAST([] AS VARCHAR[]) END AS sources,
        CASE WHEN query_id % 4 = 0 THEN ['a.com', 'b.org'] END AS include_domains,
        CASE WHEN query_id % 5 = 0 THEN ['c.net'] WHEN query_id % 5 = 1 THEN CAST([] AS VARCHAR[]) END AS exclude_domains,
        [NULL, '', 'qdr:h', 'qdr:d', 'qdr:w', 'qdr:m', 'qdr:y', 'cdr:1,cd_min:2024-01-01,cd_max:2024-02-01',
         'cdr:1,cd_min:2024-01-01', 'qdr:x'][query_id % 10 + 1] AS tbs,
        CASE WHEN query_id % 2 = 0 THEN 'Berlin' END AS location,
        CASE WHEN query_id % 3 = 2 THEN 'de' END AS country,
        query_id % 2 = 1 AS summary,
        CAST(CASE WHEN query_id % 6 = 0 THEN NULL WHEN query_id % 6 = 1 THEN 500 ELSE 60000 END AS INTEGER) AS timeout
        FROM (SELECT DISTINCT query_id FROM fx_results)""",
    "fx_cache": """SELECT CASE WHEN event_type IN ('view', 'click') THEN 'Crawl' ELSE 'Search' END AS prefix,
        CAST(user_id AS VARCHAR) AS key, props AS value, ts AS written_at, value AS ttl_minutes, event_id
        FROM events""",
    "fx_attempts": f"""SELECT {SITE} AS url, CAST(event_id % 4 + 1 AS INTEGER) AS tier,
        event_type <> 'error' AS network_ok, CAST(floor(value * 20) AS INTEGER) AS text_len,
        CASE WHEN event_type = 'error' THEN NULL WHEN value < 5 THEN ' ' ELSE props END AS html,
        CASE WHEN event_type = 'error' THEN 'err ' || CAST(event_id AS VARCHAR) END AS error,
        CASE WHEN event_type = 'signup' THEN 403 WHEN event_type = 'click' THEN 200 ELSE 500 END AS status,
        value > 45 AS timed_out, event_id FROM events""",
    "fx_rule_lines": f"""SELECT 'pages' AS source, CAST(page_id AS INTEGER) AS line_no,
        CASE page_id % 12
          WHEN 0 THEN '*://*.' || h || '/*'
          WHEN 1 THEN '*://' || upper(h) || '/*'
          WHEN 2 THEN '  *://' || h || regexp_extract(lp, '^(/[^/]*)', 1) || '/*  '
          WHEN 3 THEN '*://*.' || h || lp
          WHEN 4 THEN '@*://*.' || h || '/*'
          WHEN 5 THEN '/' || replace(h, '.', '\\.') || '/[a-z]{{2}}/\\d+\\?page=/'
          WHEN 6 THEN '! ' || h
          WHEN 7 THEN '# ' || h
          WHEN 8 THEN '   '
          WHEN 9 THEN h
          WHEN 10 THEN '/(' || replace(h, '.', '\\.') || '/'
          ELSE '@ *://' || h || '/*' END AS line
        FROM (SELECT page_id, {domain('url')} AS h, {lower_path('url')} AS lp FROM pages)""",
    "fx_dns": f"""SELECT {domain('url')} AS host,
        CAST(page_id * 37 % 224 AS VARCHAR) || '.' || CAST(page_id * 11 % 256 AS VARCHAR) || '.' ||
        CAST(page_id % 256 AS VARCHAR) || '.7' AS ip, page_id AS pos FROM pages""",
    "fx_scrape_req": """SELECT page_id AS request_id, url,
        CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ['markdown'] WHEN 2 THEN ['Markdown', 'HTML']
             ELSE ['html'] END AS formats,
        CAST(NULL AS VARCHAR) AS wait_until, page_id % 3 = 0 AS skip_ai FROM pages""",
    "fx_robots": f"""SELECT origin, 'User-agent: *' || chr(10) || 'Disallow: /private/' || CAST(first_id AS VARCHAR) AS robots_txt
        FROM (SELECT {robots_url('url')} AS origin, min(page_id) AS first_id FROM pages GROUP BY 1)
        WHERE regexp_matches(origin, '^https?://(www|blog)\\.')""",
}

# CTEs that the rule table needs, in dependency order
RULES = f"""fx_parsed AS (
    SELECT source, line_no, starts_with(t, '@') AS is_allow,
           CASE WHEN starts_with(t, '@') THEN {trim_ws('substr(t, 2)')} ELSE t END AS rule
    FROM (SELECT source, line_no, {trim_ws('line')} AS t FROM fx_rule_lines)
    WHERE {not_blank('t')} AND NOT starts_with(t, '!') AND NOT starts_with(t, '#')),
fx_classed AS (
    SELECT *, CASE WHEN regexp_matches(rule, '^/(.+)/$') THEN 'regex'
                   WHEN regexp_matches(rule, '^\\*://\\*\\.([^/]+)/\\*$') THEN 'wildcard'
                   WHEN regexp_matches(rule, '^\\*://([^/]+)/\\*$') THEN 'exact'
                   WHEN regexp_matches(rule, '^\\*://(\\*\\.)?(.+?)(/.+)$') THEN 'path' END AS rule_class
    FROM fx_parsed),
fx_rules AS (
    SELECT DISTINCT rule_class, is_allow,
        CASE rule_class WHEN 'wildcard' THEN lower(regexp_extract(rule, '^\\*://\\*\\.([^/]+)/\\*$', 1))
                        WHEN 'exact' THEN lower(regexp_extract(rule, '^\\*://([^/]+)/\\*$', 1))
                        WHEN 'path' THEN lower(regexp_extract(rule, '^\\*://(\\*\\.)?(.+?)(/.+)$', 2)) END AS host,
        CASE WHEN rule_class = 'path' THEN lower(CASE WHEN ends_with(pp, '/*') THEN substr(pp, 1, length(pp) - 2) ELSE pp END) END AS path,
        CASE WHEN rule_class = 'path' THEN ends_with(pp, '/*') END AS is_prefix,
        CASE WHEN rule_class = 'regex' THEN regexp_extract(rule, '^/(.+)/$', 1) END AS pattern
    FROM (SELECT *, CASE WHEN rule_class = 'path' THEN regexp_extract(rule, '^\\*://(\\*\\.)?(.+?)(/.+)$', 3) END AS pp
          FROM fx_classed WHERE rule_class IS NOT NULL)
    -- oracle-side regex validity: balanced parentheses (the Spark side compiles each pattern)
    WHERE rule_class <> 'regex' OR length(regexp_replace(pattern, '[^(]', '', 'g')) = length(regexp_replace(pattern, '[^)]', '', 'g')))"""


def with_ctes(names: list[str], body: str, extra: list[str] | None = None) -> str:
    parts = [f"{n} AS ({CTE[n]})" for n in names]
    parts += extra or []
    return "WITH " + ",\n".join(parts) + "\n" + body


def verdict_sql(src: str, url: str = "url") -> str:
    """J2-J6 over relation ``src`` (needs fx_rules): adds bl_host, bl_path,
    bl_allowed, bl_rule."""
    return f"""SELECT v.*, CASE WHEN bl_allowed OR bl_host IS NULL THEN NULL
              WHEN EXISTS (SELECT 1 FROM fx_rules r WHERE r.rule_class = 'wildcard' AND NOT r.is_allow AND r.host = v.bl_host) THEN 'wildcard'
              WHEN EXISTS (SELECT 1 FROM fx_rules r WHERE r.rule_class = 'exact' AND NOT r.is_allow AND r.host = v.bl_host) THEN 'exact'
              WHEN EXISTS (SELECT 1 FROM fx_rules r WHERE r.rule_class = 'path' AND NOT r.is_allow AND r.host = v.bl_host
                           AND (CASE WHEN r.is_prefix THEN starts_with(v.bl_path, r.path) ELSE v.bl_path = r.path END)) THEN 'path'
              WHEN EXISTS (SELECT 1 FROM fx_rules r WHERE r.rule_class = 'regex' AND NOT r.is_allow
                           AND regexp_matches(v.{url}, r.pattern, 'i')) THEN 'regex' END AS bl_rule
    FROM (SELECT s.*, coalesce(
              EXISTS (SELECT 1 FROM fx_rules r WHERE r.is_allow AND r.rule_class IN ('wildcard', 'exact') AND r.host = s.bl_host)
              OR EXISTS (SELECT 1 FROM fx_rules r WHERE r.is_allow AND r.rule_class = 'path' AND r.host = s.bl_host
                         AND (CASE WHEN r.is_prefix THEN starts_with(s.bl_path, r.path) ELSE s.bl_path = r.path END))
              OR EXISTS (SELECT 1 FROM fx_rules r WHERE r.is_allow AND r.rule_class = 'regex' AND regexp_matches(s.{url}, r.pattern, 'i')),
              false) AS bl_allowed
          FROM (SELECT t.*, {domain('t.' + url)} AS bl_host, {lower_path('t.' + url)} AS bl_path FROM {src} t) s) v"""
