"""Content, context and cache-key hashes (SHA-256, lower hex)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webweft.functions.text import _c


def sha256_hex(col) -> Column:
    """SHA-256 of the UTF-8 text."""
    return F.sha2(_c(col), 256)


def _dotnet_bool(col: Column) -> Column:
    return F.when(col, F.lit("True")).otherwise(F.lit("False"))


def context_hash(use_ai, formats, url) -> Column:
    """``UseAiClean=<True|False>&Formats=<a,b>&Url=<url>``."""
    key = F.concat(F.lit("UseAiClean="), _dotnet_bool(_c(use_ai)),
                   F.lit("&Formats="), F.coalesce(F.array_join(_c(formats), ","), F.lit("")),
                   F.lit("&Url="), F.coalesce(_c(url), F.lit("")))
    return F.sha2(key, 256)


def _s(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def search_cache_key(query, country, location, tbs, sources, include, exclude, limit) -> Column:
    """SHA-256 over eight pipe-joined fields; nulls render empty, sources
    default to ``web``; summary and timeout are not part of the key."""
    src = F.when(F.size(_c(sources)) > 0, F.array_join(_c(sources), ",")).otherwise(F.lit("web"))
    inc = F.coalesce(F.array_join(_c(include), ","), F.lit(""))
    exc = F.coalesce(F.array_join(_c(exclude), ","), F.lit(""))
    raw = F.concat_ws("|", _s(_c(query)), _s(_c(country)), _s(_c(location)), _s(_c(tbs)),
                      src, inc, exc, _s(_c(limit)))
    return F.sha2(raw, 256)
