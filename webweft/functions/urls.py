"""URL projections (domain, path, robots URL, guard, public-IP test).

All are Catalyst expressions: regexes are literal, so they are compiled once
per task and stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webweft.functions.text import _c, is_blank

# --- fixed values (URL rules) ------------------------------------------------
ALLOWED_SCHEMES = ["http", "https"]
MSG_URL_REQUIRED = "URL is required"
MSG_INVALID_URL = "Invalid URL format"
MSG_TRAVERSAL = "Path traversal not allowed"
MSG_INTERNAL_IP = "Internal IP addresses are not allowed"
# -----------------------------------------------------------------------------

# scheme://[userinfo@]host[:port][path][?query][#fragment]
_HIER = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)"
_SCHEME_ONLY = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _hier(col: Column, group: int) -> Column:
    return F.regexp_extract(col, _HIER, group)


def has_authority(col) -> Column:
    return _c(col).rlike(_HIER + ".*") & (F.length(_hier(_c(col), 2)) > 0)



def url_scheme(col) -> Column:
    c = _c(col)
    return F.when(c.rlike(_SCHEME_ONLY), F.lower(F.regexp_extract(c, _SCHEME_ONLY, 1)))


def url_host(col) -> Column:
    """Host of an absolute URL, lower-cased; null when there is none (one
    regex evaluation: no match and an empty host both give '')."""
    return F.nullif(F.lower(_hier(_c(col), 2)), F.lit(""))


def extract_domain(col) -> Column:
    """Host of the URL, else of ``https://`` + text; null if both fail."""
    c = _c(col)
    return F.coalesce(url_host(c), url_host(F.concat(F.lit("https://"), c)))


def raw_path(col) -> Column:
    c = _c(col)
    https = F.concat(F.lit("https://"), c)
    return (F.when(_hier(c, 2) != "", _hier(c, 4))
            .when(_hier(https, 2) != "", _hier(https, 4)))


def collapse_dot_segments(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments the way a URI class does."""
    segs = F.split(F.substring(path, 2, 1 << 30), "/")
    folded = F.aggregate(
        segs, F.lit(""),
        lambda acc, x: F.when(x == "..", F.regexp_replace(acc, "/[^/]*$", ""))
        .when(x == ".", acc)
        .otherwise(F.concat(acc, F.lit("/"), x)))
    last = F.element_at(segs, -1)
    trailing = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    out = F.concat(folded, trailing)
    return F.when(path.contains("/."), F.when(out == "", F.lit("/")).otherwise(out)).otherwise(path)


def lower_path(col) -> Column:
    """Lower-cased absolute path, no query or fragment, ``/`` when empty."""
    p = raw_path(col)
    p = F.when(p == "", F.lit("/")).otherwise(p)
    return F.lower(collapse_dot_segments(p))


def robots_url(col) -> Column:
    """P5: ``scheme://host/robots.txt`` (port dropped); null if not absolute."""
    c = _c(col)
    return F.when(has_authority(c), F.concat(F.lower(_hier(c, 1)), F.lit("://"),
                                             F.lower(_hier(c, 2)), F.lit("/robots.txt")))


# --- P4 -----------------------------------------------------------------------

def ipv4_number(col) -> Column:
    """An IPv4 address as a number, in any form a URL parser takes for one: one to
    four parts, each decimal, octal (leading 0) or hexadecimal (0x); the last
    part fills the bytes that are left.  Null for any other text."""
    host = F.regexp_replace(F.lower(_c(col)), r"\.$", "")
    parts = F.split(host, r"\.")
    n = F.size(parts)

    def number(p: Column) -> Column:
        value = (F.when(p.rlike(r"^0x[0-9a-f]{1,12}$"), F.conv(F.substring(p, 3, 12), 16, 10))
                 .when(p.rlike(r"^0[0-7]{1,15}$"), F.conv(p, 8, 10))
                 .when(p.rlike(r"^(0|[1-9][0-9]{0,11})$"), p))
        return value.try_cast("long")

    values = F.transform(parts, number)
    last = F.element_at(values, -1)
    head = F.slice(values, 1, F.greatest(n - 1, F.lit(0)))
    room = F.pow(F.lit(256.0), F.lit(5) - n).cast("long")
    fits = (n.between(1, 4) & F.forall(head, lambda v: F.coalesce(v.between(0, 255), F.lit(False)))
            & F.coalesce(last < room, F.lit(False)))
    high = F.aggregate(head, F.lit(0).cast("long"), lambda acc, v: acc * 256 + v)
    return F.when(fits, high * room + last)


def is_ipv4(col) -> Column:
    return ipv4_number(col).isNotNull()


def is_ipv6_literal(col) -> Column:
    c = F.regexp_replace(_c(col), r"^\[|\]$", "")
    return c.rlike(r"^[0-9A-Fa-f:.]+$") & c.contains(":")


def is_ip_literal(col) -> Column:
    return is_ipv4(col) | is_ipv6_literal(col)


def is_public_ip(col) -> Column:
    """P4 for an IPv4 or (bracketed or bare) IPv6 literal.  Null when the text
    is not an IP literal."""
    c = _c(col)
    ip = ipv4_number(c)
    o1, o2 = F.shiftright(ip, 24), F.shiftright(ip, 16).bitwiseAND(F.lit(255))
    v4_private = ((o1 == 10) | ((o1 == 172) & o2.between(16, 31)) | ((o1 == 192) & (o2 == 168))
                  | ((o1 == 169) & (o2 == 254)) | (o1 == 127) | (o1 == 0))
    v6 = F.lower(F.regexp_replace(c, r"^\[|\]$", ""))
    v6s = F.regexp_replace(v6, "(^|:)0+([0-9a-f])", "$1$2")
    v6_loop = v6s.rlike(r"^(0?:)+1$") | v6.rlike(r"^(0{0,4}:)+ffff:127\.")
    v6_link = v6.rlike(r"^fe[89ab][0-9a-f]?:")
    v6_site = v6.rlike(r"^fe[c-f][0-9a-f]?:")
    return (F.when(ip.isNotNull(), ~v4_private)
            .when(is_ipv6_literal(c), ~(v6_loop | v6_link | v6_site)))


def scheme_message(scheme: Column) -> Column:
    return F.concat(F.lit("Scheme '"), scheme, F.lit("' not allowed"))


def host_message(host: Column, ip: Column) -> Column:
    return F.concat(F.lit("Host '"), host, F.lit("' resolves to internal IP ("), ip, F.lit(")"))


def guard_error(url_col, bad_ip: Column | None = None) -> Column:
    """P3 without DNS (first match wins); ``bad_ip`` is the first non-public
    address the host resolves to (J11), or null."""
    u = _c(url_col)
    scheme = url_scheme(u)
    absolute = u.rlike(_SCHEME_ONLY) & (~scheme.isin(*ALLOWED_SCHEMES) | has_authority(u))
    host_raw = _hier(u, 2)
    path = _hier(u, 4)
    err = (F.when(is_blank(u), F.lit(MSG_URL_REQUIRED))
           .when(~absolute, F.lit(MSG_INVALID_URL))
           .when(~scheme.isin(*ALLOWED_SCHEMES), scheme_message(scheme))
           .when(path.contains("/../") | path.endswith("/.."), F.lit(MSG_TRAVERSAL))
           .when(is_ip_literal(host_raw) & ~is_public_ip(host_raw), F.lit(MSG_INTERNAL_IP)))
    if bad_ip is not None:
        err = err.when(~is_ip_literal(host_raw) & bad_ip.isNotNull(),
                       host_message(F.lower(host_raw), bad_ip))
    return err
