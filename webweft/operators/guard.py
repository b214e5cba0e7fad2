"""URL guard over request tables (P3 + J11 + F1) and robots join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.functions.urls import guard_error, is_public_ip, robots_url, url_host


def first_private_address(dns: DataFrame) -> DataFrame:
    """Per host, the first (by ``pos``) resolved address that is not
    public; hosts whose addresses are all public give no row."""
    bad = dns.filter(~F.coalesce(is_public_ip(F.col("ip")), F.lit(True)))
    return bad.groupBy(F.lower("host").alias("_dns_host")).agg(F.min_by("ip", "pos").alias("_bad_ip"))


def guard(requests: DataFrame, dns: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """Adds ``url_ok`` and ``url_error`` (first failing rule).  Hosts
    missing from the DNS table count as unresolvable, hence allowed."""
    df = requests
    bad_ip = None
    if dns is not None:
        bad = first_private_address(dns)
        df = df.withColumn("_g_host", url_host(F.col(url_col)))
        df = df.join(bad, df["_g_host"] == bad["_dns_host"], "left").drop("_dns_host", "_g_host")
        bad_ip = F.col("_bad_ip")
    err = guard_error(F.col(url_col), bad_ip)
    out = df.withColumn("url_error", err).withColumn("url_ok", F.col("url_error").isNull())
    return out.drop("_bad_ip") if dns is not None else out


def join_robots(pages: DataFrame, robots: DataFrame, url_col: str = "url") -> DataFrame:
    """Robots text per page by origin (``scheme://host``); missing → null.
    One robots row per origin, joined on the origin key."""
    r = robots.select(F.col("origin").alias("_origin"), "robots_txt")
    p = pages.withColumn("_origin_k", robots_url(F.col(url_col)))
    return p.join(r, p["_origin_k"] == r["_origin"], "left").drop("_origin", "_origin_k")
