"""Sinks (K1-K8): tables, metrics, model info, pixel tables, run counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None,
                fmt: str = "parquet", mode: str = "overwrite") -> None:
    """K1/K3: write a table; ``partition_by`` (e.g. Decade) enables
    partition pruning on read.

    With ``partition_by`` the rows are first rebalanced on those columns
    (``rebalance`` hint): AQE groups each partition value into few tasks and
    splits oversized ones, so every folder gets a few well-sized files
    instead of one small file per upstream task, and a hot value is not
    written by a single task."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """K4: one row per model, ``model`` first."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def metrics_long(metrics: DataFrame) -> DataFrame:
    """K4 transpose: ``model, metric, value`` (unpivot of the wide table)."""
    value_cols = [c for c, t in metrics.dtypes if t == "double"]
    return metrics.unpivot(["model"], value_cols, "metric", "value")


def model_info(metrics: DataFrame, best: str, n_train: int | None = None, n_test: int | None = None) -> DataFrame:
    """K5: one-row record about the chosen model."""
    row = metrics.filter(F.col("model") == best)
    return row.select(
        F.col("model").alias("best_model"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("training_date"),
        F.col("test_r2"),
        F.sqrt("test_mse").alias("test_rmse"),
        F.lit(n_train).cast("long").alias("training_samples"),
        F.lit(n_test).cast("long").alias("test_samples"),
    )


def write_model_info(info: DataFrame, path: str) -> None:
    """K5: the one-row model record as JSON."""
    info.coalesce(1).write.mode("overwrite").json(path)


def write_pixels(pixels: DataFrame, path: str) -> None:
    """K7: mask / overlay pixel tables as one table whose files hold whole images
    in order where they fit (rebalanced on ``image_id``; AQE splits a huge image),
    so a reader of one image skips files by their statistics and the number of
    folders does not grow with the number of images."""
    pixels.hint("rebalance", "image_id").sortWithinPartitions("image_id", "y", "x").write.mode("overwrite").parquet(path)


def observed(df: DataFrame, name: str = "rows", *extra) -> tuple[DataFrame, Observation]:
    """K8: row counts (and more) collected by the next action on ``df``
    itself -- no extra job.

    Caveat (Spark 4.1): once a session has run an ``observe``, later MLlib
    ``transform`` + aggregate plans in that session fail with "Task not
    serializable".  Use it on a session of its own (``spark.newSession()``)
    or use ``counted`` instead.
    """
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows"), *extra), obs


def counted(df: DataFrame, *extra) -> dict:
    """K8 without ``observe``: one aggregate job returning ``rows`` and the
    ``extra`` aggregates as a dict."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *extra).first().asDict()
