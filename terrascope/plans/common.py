"""Small helpers shared by the query registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every floating column (report output format).  ``+ 0.0`` turns a
    negative zero into zero so rounded values print alike everywhere."""
    overrides = overrides or {}
    cols = []
    for name, dtype in df.dtypes:
        if dtype in ("double", "float"):
            d = overrides.get(name, digits)
            cols.append((F.round(F.col(name).cast("double"), d) + F.lit(0.0)).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)
