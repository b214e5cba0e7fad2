"""Cache TTL, block duration, jitter and stability reset curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webweft.functions.text import _c

# --- fixed values (defaults of the curves) -----------------------------------
CACHE_BASE_MINUTES = 60
CACHE_THRESHOLD = 3
CACHE_MAX_MINUTES = 10080
CACHE_RESET_DIVISOR = 5
CACHE_RESET_CAP = 6
BLOCK_BASE_MINUTES = 5
BLOCK_THRESHOLD = 3
BLOCK_MAX_MINUTES = 10080
JITTER_LOW = 0.85
JITTER_SPAN = 0.30
# -----------------------------------------------------------------------------


def growth_curve(n, base: float, threshold: int, cap: float) -> Column:
    """``base*(1+log2(max(n,0)+1))`` up to the threshold, then doubling from
    the threshold value; capped."""
    n = _c(n).cast("double")
    at_t = base * (1.0 + F.log2(F.lit(float(threshold + 1))))
    raw = (F.when(n <= threshold, base * (1.0 + F.log2(F.greatest(n, F.lit(0.0)) + 1.0)))
           .otherwise(at_t * F.pow(F.lit(2.0), n - threshold)))
    return F.least(raw, F.lit(float(cap)))


def cache_ttl_minutes(n, base=CACHE_BASE_MINUTES, threshold=CACHE_THRESHOLD,
                      cap=CACHE_MAX_MINUTES) -> Column:
    """P13 before jitter."""
    return growth_curve(n, base, threshold, cap)


def jitter_factor(key, seed: int = 42) -> Column:
    """Deterministic factor in [0.85, 1.15) from a hash of the key."""
    h = F.pmod(F.xxhash64(_c(key), F.lit(seed)), F.lit(1_000_000)).cast("double") / 1e6
    return F.lit(JITTER_LOW) + F.lit(JITTER_SPAN) * h



def block_minutes(n, base=BLOCK_BASE_MINUTES, threshold=BLOCK_THRESHOLD,
                  cap=BLOCK_MAX_MINUTES) -> Column:
    """Same curve, no jitter."""
    return growth_curve(n, base, threshold, cap)


def stability_reset(s, divisor=CACHE_RESET_DIVISOR, cap=CACHE_RESET_CAP) -> Column:
    """``max(1, min(s div 5, 6))``."""
    return F.greatest(F.lit(1), F.least(F.floor(_c(s) / divisor).cast("int"), F.lit(cap)))


def add_minutes(ts, minutes) -> Column:
    """Timestamp plus fractional minutes, at microsecond precision (floor)."""
    micros = F.floor(_c(minutes) * 60_000_000.0).cast("long")
    return F.timestamp_add("MICROSECOND", micros, _c(ts))
