"""Session helpers.

``get_session`` is only a convenience for tests, benchmarks and scripts: on a
cluster the caller's session (with its own shuffle sizing, checkpoint dir and
so on) is used unchanged.  Nothing here overrides a setting that is already
present.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter for correctness of the operators (time zone for date
# parts) or for the plan shape (AQE re-planning, skew splitting).
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "terrascope") -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TERRASCOPE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only when it is unset
    (local tests) a fresh scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder every executor shares "
                             "(a machine-local scratch folder is only used in local mode)")
        conf_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of a session, once:
    its sources go as one zip file through the shared checkpoint folder."""
    import io
    import uuid
    import zipfile
    from pathlib import Path
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for source in sorted((root / "terrascope").rglob("*.py")):
            z.write(source, source.relative_to(root))
    uri = scratch_path(spark, f"terrascope-{uuid.uuid4().hex}.zip")
    # through Hadoop's file systems, as Spark itself reads and writes that folder
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(uri)
    _shipped.add(app)


def materialize(df, name: str = "table"):
    """Cut lineage: write ``df`` as a parquet table under the shared
    checkpoint folder and read it back (never ``localCheckpoint``).  A lost
    executor then re-reads the table instead of recomputing the plan.

    A written table rather than ``Dataset.checkpoint()``: the latter fails
    with "Task not serializable" once the session has used ``observe()``.
    """
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}_{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    # A small table reads back as few splits (AQE coalesced its last shuffle);
    # iterative consumers (MLlib) then leave cores idle.  Large tables already
    # have many splits and are returned as read.
    want = spark.sparkContext.defaultParallelism
    if back.rdd.getNumPartitions() < want:
        back = back.repartition(want)
    return back


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 * 1024 * 1024,
               min_partitions: int = 200, max_partitions: int = 2_000_000) -> dict[str, str]:
    """Settings sized to the input volume so shuffle partitions fit in
    executor memory: ~``target_partition_bytes`` per scan split and per
    shuffle partition (AQE coalesces small ones and splits skewed ones at
    run time, but only from a large enough starting count)."""
    parts = max(min_partitions, min(max_partitions, -(-int(input_bytes) // target_partition_bytes)))
    size = f"{target_partition_bytes // (1024 * 1024)}m"
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{4 * target_partition_bytes // (1024 * 1024)}m",
    }


def apply_scale_conf(spark: SparkSession, paths: list[str], **kw) -> dict[str, str]:
    """Measure the input folders (Hadoop file system sizes, no data read) and
    set ``scale_conf`` -- only keys the user has not set, at launch or in the
    session.  Returns what was set."""
    from terrascope.operators.joins import path_bytes
    total = path_bytes(spark, paths)
    live = spark._jsparkSession.sessionState().conf()
    applied = {k: v for k, v in scale_conf(total, **kw).items() if not live.contains(k)}
    for k, v in applied.items():
        spark.conf.set(k, v)
    return applied


@contextmanager
def scaled_conf(spark: SparkSession, paths: list[str], **kw):
    """``apply_scale_conf`` for the time of a block; no paths change nothing."""
    applied = apply_scale_conf(spark, paths, **kw) if paths else {}
    try:
        yield applied
    finally:
        for k in applied:
            spark.conf.unset(k)
