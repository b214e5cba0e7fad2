"""Size checks in front of broadcasts.

A side is broadcast only after its bytes have been measured against a bound;
beyond the bound the plan keeps a shuffled join (sort-merge or shuffled hash,
chosen by Catalyst/AQE)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes (as JSON text) of a rule / reputation / lookup side that may be shipped to every task.
MAX_BROADCAST_BYTES = 64 << 20


def table_bytes(df: DataFrame) -> int:
    """Size of a small table as JSON text: a partial aggregate in each task."""
    row = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    return table_bytes(df) <= max_bytes


def sized_broadcast(df: DataFrame, ok: bool | None = None,
                    max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when ``ok`` (or a fresh measurement) says it is small."""
    if ok is None:
        ok = fits_broadcast(df, max_bytes)
    return F.broadcast(df) if ok else df
