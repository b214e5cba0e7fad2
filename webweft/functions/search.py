"""Search-request projections: freshness, result count, domain lists,
validity; fetch error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webweft.functions.text import _c, is_blank, not_blank

# --- fixed values -------------------------------------------------------------
# tbs value -> provider freshness
TBS_TO_FRESHNESS = {
    "qdr:h": "oneDay",
    "qdr:d": "oneDay",
    "qdr:w": "oneWeek",
    "qdr:m": "oneMonth",
    "qdr:y": "oneYear",
}
NO_LIMIT = "noLimit"
CUSTOM_RANGE_PREFIX = "cdr:1,cd_min:"
DEFAULT_LIMIT = 10
MAX_RESULT_COUNT = 50
PROVIDER_ERROR = "Search provider unavailable"
FETCH_ERROR_CODES = ["INVALID_URL", "BOT_BLOCKED", "FETCH_TIMEOUT", "FETCH_FAILED"]
# -----------------------------------------------------------------------------


def freshness(tbs) -> Column:
    """P10."""
    t = _c(tbs)
    lookup = F.create_map(*[F.lit(x) for kv in TBS_TO_FRESHNESS.items() for x in kv])
    parts = F.split(t, ",")
    lo = F.get(F.filter(parts, lambda p: p.startswith("cd_min:")), 0)
    hi = F.get(F.filter(parts, lambda p: p.startswith("cd_max:")), 0)
    rng = F.concat(F.substring(lo, 8, 1 << 30), F.lit(".."), F.substring(hi, 8, 1 << 30))
    return (F.when(is_blank(t), F.lit(NO_LIMIT))
            .when(F.try_element_at(lookup, t).isNotNull(), F.try_element_at(lookup, t))
            .when(t.startswith(CUSTOM_RANGE_PREFIX) & lo.isNotNull() & hi.isNotNull(), rng)
            .otherwise(F.lit(NO_LIMIT)))


def result_count(limit, max_count: int = MAX_RESULT_COUNT) -> Column:
    """``min(coalesce(limit, 10), max)``."""
    return F.least(F.coalesce(_c(limit), F.lit(DEFAULT_LIMIT)), F.lit(max_count))


def pipe_list(arr) -> Column:
    """Pipe-joined list, null when empty or null."""
    a = _c(arr)
    return F.when(F.size(a) > 0, F.array_join(a, "|"))


def request_valid(query, limit, timeout) -> Column:
    """query not blank and at most 500 chars; limit 1..100 and timeout
    1000..300000 when set (a null passes, as in the validator)."""
    q, lim, to = _c(query), _c(limit), _c(timeout)
    return (not_blank(q) & (F.length(q) <= 500)
            & F.coalesce(lim.between(1, 100), F.lit(True))
            & F.coalesce(to.between(1000, 300000), F.lit(True)))


def empty_if_null(col) -> Column:
    """P21."""
    return F.coalesce(_c(col), F.lit(""))


def fetch_error_code(url_ok, status, timed_out) -> Column:
    """P20: error class of a failed browser fetch."""
    return (F.when(~_c(url_ok), F.lit("INVALID_URL"))
            .when(_c(status).isin(403, 406), F.lit("BOT_BLOCKED"))
            .when(_c(timed_out), F.lit("FETCH_TIMEOUT"))
            .otherwise(F.lit("FETCH_FAILED")))
