"""Cleaning and filtering operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_missing(df: DataFrame, value: str) -> DataFrame:
    """Drop rows whose ``value`` is NULL or NaN (``na.drop`` covers both)."""
    return df.na.drop(subset=[value])


def parse_dates(df: DataFrame, col: str = "dt") -> DataFrame:
    """``col`` as DATE.  Text goes through ``try_to_date`` (bad text -> NULL
    instead of an ANSI error); timestamps are truncated to their date."""
    dtype = dict(df.dtypes)[col]
    if dtype == "string":
        parsed = F.coalesce(F.try_to_date(F.col(col), "yyyy-MM-dd"), F.try_to_date(F.col(col)))
    else:
        parsed = F.col(col).cast("date")
    return df.withColumn(col, parsed)


def calendar_parts(df: DataFrame, col: str = "dt") -> DataFrame:
    """Add integer ``Year`` and ``Month``."""
    return df.withColumn("Year", F.year(col)).withColumn("Month", F.month(col))


def year_cutoff(df: DataFrame, from_year: int = 1900, col: str = "dt") -> DataFrame:
    """Keep ``year(col) >= from_year``, written as a date range so the
    predicate reaches the parquet reader (``year(dt) >= y`` would not)."""
    return df.filter(F.col(col) >= F.make_date(F.lit(from_year), F.lit(1), F.lit(1)))


def clean(df: DataFrame, value: str, from_year: int = 1900, col: str = "dt") -> DataFrame:
    """P1-P4 in the order of the original pipeline."""
    out = drop_missing(df, value)
    out = parse_dates(out, col)
    out = year_cutoff(out, from_year, col)
    return calendar_parts(out, col)


def complete_rows(df: DataFrame) -> DataFrame:
    """P5: drop rows with a NULL or NaN in any column."""
    return df.na.drop(how="any")


def pattern_match(col: str | Column, pattern: str) -> Column:
    """Case-insensitive, partial regular-expression match; NULL -> false."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))


def match_rows(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """P8 as a filter: every key matching ``pattern`` is pooled."""
    return df.filter(pattern_match(key, pattern))


def clamp_years(n: Column | int | str | None, default: int = 5, lo: int = 1, hi: int = 10):
    """Forecast horizon clamp.

    Python values: non-integers give ``default``, then clamp to ``lo..hi``.
    Columns: ``greatest(lo, least(hi, try_cast(n as int)))`` with the default
    for NULL / non-integer text.
    """
    if isinstance(n, Column):
        as_int = F.coalesce(n.try_cast("int"), F.lit(default))
        return F.greatest(F.lit(lo), F.least(F.lit(hi), as_int))
    try:
        v = int(n) if not isinstance(n, bool) else default
        if isinstance(n, float) and not n.is_integer():
            v = default
    except (TypeError, ValueError):
        v = default
    return max(lo, min(hi, v))
