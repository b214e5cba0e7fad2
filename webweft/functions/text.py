"""Whitespace helpers with .NET semantics (trim and blank test over all
Unicode whitespace, not only the space character)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def once(value, change) -> Column:
    """``change`` of a value that it names more than once: the value is computed once."""
    return F.get(F.transform(F.array(_c(value)), change), F.lit(0))


def where(test, change):
    """``change`` of the texts that pass a cheap test, which every text that it would alter passes."""
    return lambda text: once(text, lambda t: F.when(test(t), change(t)).otherwise(t))


def ws_trim(col) -> Column:
    """Strip leading and trailing whitespace (Unicode aware)."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def is_blank(col) -> Column:
    """True for null, empty or whitespace-only text."""
    c = _c(col)
    return c.isNull() | ~c.rlike(r"(?U)\S")


def not_blank(col) -> Column:
    c = _c(col)
    return c.isNotNull() & c.rlike(r"(?U)\S")
