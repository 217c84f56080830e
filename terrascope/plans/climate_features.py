"""Q6: prepare -> features (P1-P6, W1-W5, F1s, F2s)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrascope.operators.clean import clean, complete_rows
from terrascope.operators.series import FEATURES, TARGET, add_features
from terrascope.sources import fixtures


def build_features(series: DataFrame, value: str = TARGET, from_year: int = 1900,
                   series_key=None) -> DataFrame:
    """Clean a monthly series and add the nine model features; rows with any
    missing value (the first 12 of each series) are dropped."""
    cleaned = clean(series, value, from_year)
    return complete_rows(add_features(cleaned, value, series_key))


def global_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the global monthly series F2."""
    return build_features(fixtures.global_series(spark, sf_dir))


def feature_projection(features: DataFrame, value: str = TARGET) -> DataFrame:
    """The nine features and the target."""
    return features.select(*FEATURES, value)
