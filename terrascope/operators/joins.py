"""Join helpers: size-checked broadcast and scalar attachment.

* ``broadcast_if_small_files`` hints a broadcast only for a table whose files are
  small; otherwise Catalyst / AQE choose a shuffle join from runtime statistics.
* ``scalar`` turns a one-row aggregate into a scalar-subquery column
  (``DataFrame.scalar()``), so "value - mean(value)" or "year >= max(year) - 30"
  needs neither a join nor an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_bytes(spark, paths) -> int:
    """Bytes on disk under ``paths`` (Hadoop file-system metadata; no Spark
    job, no data read)."""
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in ([paths] if isinstance(paths, str) else paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(hconf)
        for found in fs.globStatus(path) or []:  # a plain path is a glob of one
            total += fs.getContentSummary(found.getPath()).getLength()
    return total


def broadcast_if_small_files(df: DataFrame, paths, max_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Broadcast a table read straight from ``paths`` when its files total at
    most ``max_bytes`` (a bound known before planning, checked from
    file-system metadata); otherwise return it for a shuffle join."""
    return F.broadcast(df) if path_bytes(df.sparkSession, paths) <= max_bytes else df


def scalar(df: DataFrame, expr: Column) -> Column:
    """``expr`` aggregated over all of ``df`` as a scalar-subquery column."""
    return df.select(expr).scalar()


def scalars(df: DataFrame, **exprs: Column) -> dict[str, Column]:
    """Several aggregates of ``df`` as ONE scalar subquery returning a struct;
    each returned column reads one field.  The references share one
    subquery plan, which Spark evaluates once (subquery reuse), so ``df`` is
    aggregated in a single pass however many statistics are used."""
    packed = df.select(F.struct(*[e.alias(k) for k, e in exprs.items()]).alias("s")).scalar()
    return {k: packed.getField(k) for k in exprs}
