"""Climate CSV sources (S1-S5): read by header name in one pass, no
inference job; ``''`` / ``NA`` read as NULL, a literal ``NaN`` as a NaN
double -- the cleaning step (``na.drop``) removes both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from pyspark.sql import functions as F

# Columns the operators read, by name; every other column of a file is kept
# as text and carried through (the original keeps unread columns too).
GLOBAL_VALUE = "LandAverageTemperature"
LOCAL_VALUE = "AverageTemperature"
#: The numeric columns of the three climate files.
NUMERIC = {f"{c}{u}" for u in ("", "Uncertainty") for c in (
    "AverageTemperature", "LandAverageTemperature", "LandMaxTemperature", "LandMinTemperature",
    "LandAndOceanAverageTemperature")}


def read_climate_csv(spark: SparkSession, path: str, value: str, numeric: tuple[str, ...] = ()) -> DataFrame:
    """Read a climate CSV **by header name**: every field arrives as text (no
    schema-inference pass, no positional schema), then ``dt`` becomes a DATE
    (``try_to_date``) and ``value`` plus the columns named in ``numeric`` or
    ``NUMERIC`` (exact names) a DOUBLE
    (``try_cast``: ``''`` and ``NA`` -> NULL, ``NaN`` stays NaN for the
    cleaning step).  Extra columns in any order are fine."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    cols = []
    for c in raw.columns:
        if c == "dt":
            cols.append(F.coalesce(F.try_to_date(F.col(c), "yyyy-MM-dd"), F.try_to_date(F.col(c))).alias(c))
        elif c == "obs_id":
            cols.append(F.col(c).try_cast("long").alias(c))
        elif c == value or c in numeric or c in NUMERIC:
            cols.append(F.col(c).try_cast("double").alias(c))
        else:
            cols.append(F.col(c))
    return raw.select(*cols)


def read_global(spark: SparkSession, path: str) -> DataFrame:
    """The global monthly series (``dt, LandAverageTemperature, ...``)."""
    return read_climate_csv(spark, path, GLOBAL_VALUE)


def read_country(spark: SparkSession, path: str) -> DataFrame:
    """The country-by-month table (``dt, AverageTemperature, ..., Country``)."""
    return read_climate_csv(spark, path, LOCAL_VALUE)


def read_city(spark: SparkSession, path: str) -> DataFrame:
    """S3: the city table, all rows."""
    return read_climate_csv(spark, path, LOCAL_VALUE)


def read_optional(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None,
                  **options) -> DataFrame | None:
    """``None`` when the path does not exist (optional tables); other
    errors propagate, so a mandatory table fails loudly."""
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or "") or "Path does not exist" in str(e):
            return None
        raise


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Reload a predictions (or features) table written by ``write_table``."""
    return spark.read.parquet(path)
