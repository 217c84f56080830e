"""Rounding, clipping and banding helpers (F5s, F6s, F10s)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def round_half_even(x: str | Column, digits: int) -> Column:
    """F6s, report rounding: half-even on the printed decimal (``bround``).
    Agrees with Python's ``round`` except on decimal ties such as 2.675 (``round_exact``)."""
    return F.bround(_c(x), digits)


def round_exact(x: str | Column, digits: int) -> Column:
    """F6s, Python's ``round``: half-even on the exact binary value of a double.

    ``x * 10^d`` is taken with its rounding error (both factors split into halves of 26
    bits, whose products are exact); the error decides where the product is a tie.  Infinite,
    NaN and values without room for ``digits`` stay as they are (0 <= digits <= 15)."""
    x, scale = _c(x).cast("double"), float(10 ** digits)
    half = F.lit(134217729.0)                       # 2^27 + 1
    big = F.isnan(x) | (F.abs(x) * scale >= F.lit(2.0 ** 52))
    v = F.when(big, F.lit(0.0)).otherwise(x)
    p = v * F.lit(scale)
    high = half * v - (half * v - v)
    low = v - high
    s_high = 134217729.0 * scale - (134217729.0 * scale - scale)
    s_low = scale - s_high
    error = ((high * s_high - p) + high * s_low + low * s_high) + low * s_low
    floor = F.floor(p).cast("double")
    side = (p - floor) - F.lit(0.5)
    up = (side > 0) | ((side == 0) & ((error > 0) | ((error == 0) & (F.pmod(floor, F.lit(2.0)) == 1))))
    return F.when(big, x).otherwise((floor + up.cast("double")) / F.lit(scale))


def round_rint(x: str | Column, digits: int) -> Column:
    """F6s, numpy rounding: ``rint(x * 10^d) / 10^d``."""
    scale = float(10 ** digits)
    return F.rint(_c(x) * F.lit(scale)) / F.lit(scale)


def clip(x: str | Column, lo: float = 0, hi: float = 255) -> Column:
    """F10s: saturate to ``lo..hi``."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


# Warming-rate bands (degrees per decade) -> status and colour.
STATUS_BANDS = [
    (0.2, "Rapid Warming", "danger"),
    (0.1, "Moderate Warming", "warning"),
    (0.0, "Slight Warming", "info"),
]
STATUS_DEFAULT = ("Stable/Cooling", "success")


def climate_status(rate_per_decade: str | Column) -> tuple[Column, Column]:
    """F5s: status text and colour for a warming rate per decade."""
    r = _c(rate_per_decade)
    status = colour = None
    for limit, name, col in STATUS_BANDS:
        status = (F.when(r > limit, name) if status is None else status.when(r > limit, name))
        colour = (F.when(r > limit, col) if colour is None else colour.when(r > limit, col))
    return status.otherwise(STATUS_DEFAULT[0]), colour.otherwise(STATUS_DEFAULT[1])
