"""User-facing climate reports (Q1-Q5).

Each report returns lazy DataFrames; the caller runs the action.  When
several reports come from one predictions table, ``cache()`` it first.
Reports sort only at the edge (``orderBy`` of a small aggregate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascope.functions.calendar import now_text
from terrascope.functions.numeric import climate_status, round_half_even
from terrascope.operators import aggregates as A
from terrascope.operators.joins import scalars


def global_trends(pred: DataFrame, recent_years: int = 30) -> dict[str, DataFrame]:
    """Q1: annual, decade, recent window, slope, latest anomaly, extremes."""
    annual = A.annual_means(pred)
    return {
        "annual_data": annual.orderBy("Year"),
        "decade_data": A.decade_means(pred).orderBy("Decade"),
        "recent_trend": A.recent_window(annual, recent_years).orderBy("Year"),
        "temperature_change_rate": A.recent_slope(annual, years=recent_years),
        "extremes": A.annual_extremes(annual),
    }


def country_analysis(obs: DataFrame, pattern: str | None = None, since: int = 2000, k: int = 10,
                     key: str = "Country") -> dict[str, DataFrame]:
    """Q2: with no (or a blank) pattern the top-``k`` warming keys and the
    key count; with a pattern the pooled annual series and its stats."""
    if pattern is None or not str(pattern).strip():
        return {
            "top_warming_countries": A.top_warming(A.country_trends(obs, since, key=key), k),
            "total_countries": A.country_count(obs, key),
        }
    return {
        "annual_data": A.country_annual(obs, pattern, key).orderBy("Year"),
        "stats": A.country_stats(obs, pattern, key),
    }


def seasonal(pred: DataFrame) -> DataFrame:
    """Q3: monthly profile with month names."""
    return A.seasonal_profile(pred).orderBy("Month")


def climate_summary(pred: DataFrame, forecast_rows: DataFrame | None = None,
                    recent_years: int = 30, with_timestamp: bool = True) -> DataFrame:
    """Q5: one row -- status band, warming rate per decade, latest anomaly,
    annual range, hottest / coldest month, years of data, forecast flag and
    (``with_timestamp``) the time of the report."""
    annual = A.annual_means(pred)
    rate = A.recent_slope(annual, years=recent_years).select(
        (F.col("temperature_change_rate") * 10).alias("rate")).scalar()
    ext = A.annual_extremes(annual)
    months = scalars(A.seasonal_profile(pred), hottest=F.max_by("Month_Name", F.struct(F.col("Avg_Temperature"), -F.col("Month"))),
                     coldest=F.min_by("Month_Name", F.struct(F.col("Avg_Temperature"), F.col("Month"))))
    status, colour = climate_status(rate)
    has_forecast = (F.lit(False) if forecast_rows is None
                    else forecast_rows.select(F.count(F.lit(1)) > 0).scalar())
    return ext.select(
        status.alias("climate_status"),
        colour.alias("status_color"),
        round_half_even(rate, 3).alias("warming_rate_per_decade"),
        round_half_even(F.coalesce("current_anomaly", F.lit(0.0)), 2).alias("current_anomaly"),
        round_half_even(F.coalesce("max_temperature", F.lit(0.0)), 2).alias("max_temperature"),
        round_half_even(F.coalesce("min_temperature", F.lit(0.0)), 2).alias("min_temperature"),
        months["hottest"].alias("hottest_month"),
        months["coldest"].alias("coldest_month"),
        "data_years",
        *([now_text().alias("last_updated")] if with_timestamp else []),
        has_forecast.alias("future_predictions_available"),
    )
