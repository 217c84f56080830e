"""Time-series window operators.

Row-positional semantics (lag by rows, moving means by rows, positional
splits) need a total order: ``(Year, Month, dt)``.  All windows partition by
``series_key`` when one is given (country, city ...), so each series is one
window partition and the series are spread over the cluster.

Without a key the input must be a calendar-aggregated series (one row per
month, ~12 rows a year): a single window partition is then bounded by the
calendar, not by the data volume -- raw observations are reduced by the
monthly ``groupBy`` (with map-side partial aggregation) before they reach a
window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ORDER = ("Year", "Month", "dt")


def _keys(series_key: str | Sequence[str] | None) -> list[str]:
    if series_key is None:
        return []
    return [series_key] if isinstance(series_key, str) else list(series_key)


def monthly_series(df: DataFrame, value: str, series_key=None, out: str | None = None,
                   date_col: str = "dt") -> DataFrame:
    """Raw observations -> one row per (series key, month) with the mean
    value: the input shape of every window operator here.  A hash aggregate
    with partial aggregation, so a key holding a third of all rows is reduced
    inside each map task; the result is bounded by keys x months."""
    keys = _keys(series_key)
    return (df.groupBy(*keys, F.trunc(date_col, "month").alias("dt"))
            .agg(F.avg(value).alias(out or value)))


def series_window(series_key=None, order: Sequence[str] = ORDER):
    """Window in time order, partitioned by the series key when given."""
    w = Window.orderBy(*order)
    keys = _keys(series_key)
    return w.partitionBy(*keys) if keys else w


def row_lag(value: str, k: int, series_key=None, order: Sequence[str] = ORDER) -> Column:
    """Value ``k`` rows earlier (rows, not calendar months)."""
    return F.lag(F.col(value), k).over(series_window(series_key, order))


def moving_mean(value: str, n: int, series_key=None, order: Sequence[str] = ORDER) -> Column:
    """Mean of the current and ``n - 1`` preceding rows, NULL until
    ``n`` values exist (a plain windowed avg would emit partial windows)."""
    w = series_window(series_key, order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.col(value)).over(w) == n, F.avg(F.col(value)).over(w))


def calendar_lag(df: DataFrame, value: str, months: int = 12, series_key=None,
                 out: str | None = None) -> DataFrame:
    """W2 option ``calendar=True``: value of the same series ``months``
    calendar months earlier -- an equi self-join on ``add_months(dt, -k)``
    (no window, so it scales with any series length)."""
    keys = _keys(series_key)
    out = out or f"{value}_CalLag{months}"
    # One row per (key, month) on the lookup side -- several rows of a month
    # are averaged (partial aggregation) -- so no row ever meets more than one
    # partner: the join cannot emit all pairs of a crowded month.
    prev = (df.groupBy(*[F.col(k).alias(f"_prev_{k}") for k in keys], F.col("dt").alias("_prev_dt"))
            .agg(F.avg(value).alias(out)))
    cond = [F.add_months(F.col("dt"), -months) == F.col("_prev_dt")] + \
        [F.col(k) == F.col(f"_prev_{k}") for k in keys]
    return df.join(prev, cond, "left").drop("_prev_dt", *[f"_prev_{k}" for k in keys])


def years_since_start(df: DataFrame, series_key=None) -> Column:
    """F2s: ``Year - min(Year)`` (per series when keyed).  Unkeyed input is a
    calendar series (see module note), already in one window partition."""
    # Same partitioning as the lag / moving-mean windows, so it shares their
    # exchange (no extra scan, no scalar subquery over the raw data).
    return F.col("Year") - F.min("Year").over(Window.partitionBy(*_keys(series_key)))


def month_cycle(month: str = "Month") -> tuple[Column, Column]:
    """F1s: sin and cos of 2*pi*month/12."""
    angle = F.lit(2.0) * F.pi() * F.col(month) / F.lit(12.0)
    return F.sin(angle), F.cos(angle)


FEATURES = ["YearSinceStart", "MonthSin", "MonthCos", "LandTemp_Lag1", "LandTemp_Lag12",
            "LandTemp_MA3", "LandTemp_MA12", "TempChange_1Month", "TempChange_1Year"]
TARGET = "LandAverageTemperature"


def add_features(df: DataFrame, value: str = TARGET, series_key=None, prefix: str = "LandTemp") -> DataFrame:
    """W1-W5, F1s, F2s: calendar, lag, moving-mean and change features.

    ``YearSinceStart`` is measured from the first year *before* incomplete
    rows are dropped, like the original pipeline.
    """
    sin_m, cos_m = month_cycle()
    out = df.select(
        "*",
        years_since_start(df, series_key).alias("YearSinceStart"),
        sin_m.alias("MonthSin"),
        cos_m.alias("MonthCos"),
        row_lag(value, 1, series_key).alias(f"{prefix}_Lag1"),
        row_lag(value, 12, series_key).alias(f"{prefix}_Lag12"),
        moving_mean(value, 3, series_key).alias(f"{prefix}_MA3"),
        moving_mean(value, 12, series_key).alias(f"{prefix}_MA12"),
    )
    return (out.withColumn("TempChange_1Month", F.col(value) - F.col(f"{prefix}_Lag1"))
               .withColumn("TempChange_1Year", F.col(value) - F.col(f"{prefix}_Lag12")))


def time_split(df: DataFrame, test_fraction: float = 0.2, series_key=None,
               order: Sequence[str] = ORDER) -> DataFrame:
    """Positional split in time order; the last ``ceil(test_fraction*n)``
    rows are the test part.  Adds ``rn`` (1-based) and ``is_train``."""
    keys = _keys(series_key)
    w = series_window(series_key, order)
    # series length from a whole-partition window: the same partitioning as
    # the row numbers, so no second pass over the input
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rn = F.row_number().over(w)
    n_test = F.ceil(F.lit(test_fraction) * n)
    return df.withColumn("rn", rn).withColumn("is_train", F.col("rn") <= n - n_test)


def kfold_assign(df: DataFrame, k: int = 5, series_key=None, order: Sequence[str] = ORDER) -> DataFrame:
    """Contiguous folds 0..k-1 in time order; the first ``n mod k`` folds
    get one extra row (``ntile`` has the same sizing rule)."""
    return df.withColumn("fold", F.ntile(k).over(series_window(series_key, order)) - 1)


def last_observation(df: DataFrame, order: Sequence[str] = ("Year", "Month")) -> DataFrame:
    """L3: the last row in time order (``TakeOrderedAndProject``, no full sort)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(1)
