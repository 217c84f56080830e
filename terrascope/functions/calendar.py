"""Calendar column functions: decade, month names, date text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations used by the seasonal report.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def decade(year: str | Column = "Year") -> Column:
    """F3s: ``Year // 10 * 10`` as an integer."""
    return (F.floor(_c(year) / 10) * 10).cast("int")


def month_name(month: str | Column = "Month") -> Column:
    """Month number (1-12) -> abbreviation; a literal array lookup, no join."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), _c(month).cast("int"))


def month_start_text(year: str | Column, month: str | Column) -> Column:
    """F7s: ``YYYY-MM-01`` with a zero-padded month."""
    return F.date_format(F.make_date(_c(year), _c(month), F.lit(1)), "yyyy-MM-dd")


def now_text() -> Column:
    """F8s: current timestamp as ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
