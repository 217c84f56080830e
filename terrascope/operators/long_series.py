"""Row-positional series operators without a per-series window (W1-W7 for
very long series, SURVEY section 7 "hard part 2").

The window operators in ``series.py`` put each series in one window
partition, which is right for calendar series (bounded by ~12 rows a year).
These give the same results for a series of any length:

1. ``positions`` numbers rows 1..n per series: rows are counted per
   (key, month) -- a small table bounded by keys x months -- whose running
   sum gives each month's offset; a rank inside the month completes the
   position.  No window spans more than one month of one series.
2. ``positional_features`` sends each row's value to the 12 positions after
   it (map-side explode) and one ``groupBy(key, position)`` -- with partial
   aggregation -- reads lag 1, lag 12 and the 3- and 12-row means, with the
   same NULL rules as ``lag`` / ``count(...) == n`` windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrascope.operators.series import _keys, month_cycle

ORDER = ("Year", "Month", "dt")
CHUNK = ("Year", "Month")


def positions(df: DataFrame, series_key=None, order: Sequence[str] = ORDER,
              chunk: Sequence[str] = CHUNK) -> DataFrame:
    """Adds ``rn`` (1-based position in ``order`` within the series) and
    ``n`` (series length)."""
    keys = _keys(series_key)
    counts = df.groupBy(*keys, *chunk).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, *chunk,
                            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
                            F.sum("_c").over(Window.partitionBy(*keys)).alias("n"))
    local = F.row_number().over(Window.partitionBy(*keys, *chunk).orderBy(*order))
    return (df.join(offsets, [*keys, *chunk])
            .withColumn("rn", (F.col("_off") + local).cast("long")).drop("_off"))


def positional_features(df: DataFrame, value: str, series_key=None, prefix: str = "LandTemp",
                        order: Sequence[str] = ORDER) -> DataFrame:
    """Same columns and values as ``series.add_features`` (W1-W5, F1s, F2s)
    for a series of any length."""
    keys = _keys(series_key)
    pos = positions(df, series_key, order)
    carry = [c for c in df.columns if c not in keys and c != value]
    span = 12
    spread = pos.select(*keys, "rn", value, *carry,
                        F.explode(F.sequence(F.lit(0), F.lit(span))).alias("_d"))
    spread = spread.select(*keys, (F.col("rn") + F.col("_d")).alias("rn"), "_d", value, *carry)
    v, d = F.col(value), F.col("_d")
    agg = spread.groupBy(*keys, "rn").agg(
        F.count(F.when(d == 0, F.lit(1))).alias("_self"),
        *[F.max(F.when(d == 0, F.col(c))).alias(c) for c in carry],
        F.max(F.when(d == 0, v)).alias(value),
        F.max(F.when(d == 1, v)).alias(f"{prefix}_Lag1"),
        F.max(F.when(d == 12, v)).alias(f"{prefix}_Lag12"),
        F.count(F.when(d <= 2, v)).alias("_c3"), F.avg(F.when(d <= 2, v)).alias("_m3"),
        F.count(F.when(d <= 11, v)).alias("_c12"), F.avg(F.when(d <= 11, v)).alias("_m12"),
    ).filter(F.col("_self") == 1)
    if keys:
        first = df.groupBy(*keys).agg(F.min("Year").alias("_y0"))
        agg = agg.join(first, keys)
        base = F.col("_y0")
    else:
        base = df.select(F.min("Year")).scalar()
    sin_m, cos_m = month_cycle()
    out = agg.select(
        *keys, *carry, value,
        (F.col("Year") - base).alias("YearSinceStart"), sin_m.alias("MonthSin"), cos_m.alias("MonthCos"),
        f"{prefix}_Lag1", f"{prefix}_Lag12",
        F.when(F.col("_c3") == 3, F.col("_m3")).alias(f"{prefix}_MA3"),
        F.when(F.col("_c12") == 12, F.col("_m12")).alias(f"{prefix}_MA12"))
    return (out.withColumn("TempChange_1Month", F.col(value) - F.col(f"{prefix}_Lag1"))
               .withColumn("TempChange_1Year", F.col(value) - F.col(f"{prefix}_Lag12")))


def positional_split(df: DataFrame, test_fraction: float = 0.2, series_key=None, k: int | None = None) -> DataFrame:
    """W6 (+W7 when ``k``): ``rn``, ``is_train`` (last ``ceil(f*n)`` rows are
    test) and contiguous ``fold`` 0..k-1 of the training rows (first
    ``m mod k`` folds one row larger), from positions -- no window over a
    series."""
    pos = positions(df, series_key)
    n_train = F.col("n") - F.ceil(F.lit(test_fraction) * F.col("n"))
    out = pos.withColumn("is_train", F.col("rn") <= n_train)
    if k:
        q = F.floor(n_train / k)
        r = n_train - q * k
        big = r * (q + 1)
        fold = F.when(F.col("rn") <= big, F.floor((F.col("rn") - 1) / (q + 1))) \
            .otherwise(r + F.floor((F.col("rn") - 1 - big) / q))
        out = out.withColumn("fold", F.when(F.col("is_train"), fold.cast("int")))
    return out
