"""Tiered fetch resolution over recorded attempts.

Network I/O is out of scope: the input is an attempts table
``(url, tier, network_ok, text_len, html, error)`` with one attempt per
(url, tier) (the latest one is used when there are several).  The decision
is a per-URL conditional aggregate over at most four tiers, then a chain of
``when`` expressions: no Python, one shuffle on the URL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.functions.text import not_blank

# --- fixed values --------------------------------------------------------------
TIER_NAMES = {1: "HttpClient", 2: "HttpClientProxy", 3: "CloakBrowser", 4: "CloakBrowserProxy"}
MIN_TEXT_LENGTH = 200
ALL_TIERS_FAILED = "All fetch tiers failed"
# ---------------------------------------------------------------------------------


def enough_text(text_len, min_len: int = MIN_TEXT_LENGTH):
    """F3."""
    return F.col(text_len) >= min_len if isinstance(text_len, str) else text_len >= min_len


def resolve(attempts: DataFrame, proxy: bool, min_len: int = MIN_TEXT_LENGTH,
            order: str = "event_id") -> DataFrame:
    """Per URL ``(success, tier, tier_name, html, text_len, error)``."""
    a = attempts
    val = F.struct("network_ok", "text_len", "html", "error")
    key = F.struct(order) if order in a.columns else F.struct(F.lit(0))
    t = a.groupBy("url").agg(*[
        F.max_by(F.when(F.col("tier") == i, val), F.when(F.col("tier") == i, key)).alias(f"t{i}")
        for i in range(1, 5)])

    def net(i):  # attempt ran and the network worked
        return F.coalesce(F.col(f"t{i}.network_ok"), F.lit(False))

    def long_enough(i):
        return net(i) & F.coalesce(F.col(f"t{i}.text_len") >= min_len, F.lit(False))

    def has_html(i):
        return net(i) & not_blank(F.col(f"t{i}.html"))

    p = F.lit(proxy)
    s1 = long_enough(1)
    skel1 = net(1) & ~s1
    try2 = ~s1 & p & ~skel1
    s2 = try2 & long_enough(2)
    skel = skel1 | (try2 & net(2) & ~s2)
    skip3 = skel & ~net(1) & p
    try3 = ~s1 & ~s2 & ~skip3
    s3 = try3 & has_html(3)
    try4 = ~s1 & ~s2 & ~s3 & p
    s4 = try4 & has_html(4)
    err3 = F.when(try3 & ~net(3), F.col("t3.error"))
    err4 = F.when(try4 & ~net(4), F.col("t4.error"))
    tier = (F.when(s1, 1).when(s2, 2).when(s3, 3).when(s4, 4)
            .when(try4, 4).when(try3, 3).when(try2, 2).otherwise(1))
    success = s1 | s2 | s3 | s4
    html = (F.when(s1, F.col("t1.html")).when(s2, F.col("t2.html"))
            .when(s3, F.col("t3.html")).when(s4, F.col("t4.html")))
    tlen = F.when(s1, F.col("t1.text_len")).when(s2, F.col("t2.text_len"))
    last_err = F.coalesce(err4, err3)
    names = F.create_map(*[F.lit(x) for kv in TIER_NAMES.items() for x in kv])
    return t.select(
        "url", success.alias("success"), tier.cast("int").alias("tier"),
        F.element_at(names, tier.cast("int")).alias("tier_name"),
        html.alias("html"), tlen.cast("int").alias("text_len"),
        F.when(~success, F.coalesce(last_err, F.lit(ALL_TIERS_FAILED))).alias("error"))
