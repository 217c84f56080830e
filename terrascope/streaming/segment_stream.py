"""Score images as they arrive and emit coverage per image.

``readStream.format("image")`` picks up new files in a folder; each
micro-batch is decoded into pixel rows, segmented with a trained model and
its per-image coverage written to a Parquet folder.  The write for batch
``k`` goes to ``<out>/batch_id=k`` in overwrite mode, so a batch re-run after
a failure replaces its own output instead of duplicating it; together with
the checkpoint (source offsets) every image is reported exactly once.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.image import ImageSchema
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrascope.operators.raster import decode_image
from terrascope.plans.segmentation import segment, with_errors
from terrascope.session import materialize
from terrascope.sources.images import named


def image_stream(spark: SparkSession, folder: str, glob: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming image source with the image schema declared up front."""
    r = spark.readStream.format("image").schema(ImageSchema.imageSchema).option("dropInvalid", False)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return named(r.load(folder), F.col("image.origin"), "path", "image")


def coverage_sink(model: PipelineModel, out_path: str, size: int = 128):
    """``foreachBatch`` function: decode the batch once, segment it, write a row
    per file (coverage, or the error of a file that cannot be decoded)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        files = materialize(batch, "decoded_batch")
        cov = with_errors(files, segment(model, decode_image(files), size)["coverage"])
        cov.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    return run


def start_coverage_stream(spark: SparkSession, model: PipelineModel, folder: str, out_path: str,
                          checkpoint: str | None = None, size: int = 128, glob: str | None = None,
                          available_now: bool = True) -> StreamingQuery:
    """Start T1.  ``available_now`` processes everything present and stops
    (the batch-like trigger); otherwise it polls every 10 seconds.  The default
    checkpoint belongs to ``out_path`` (``_checkpoint`` in it, which readers of
    the folder skip), so a restarted application goes on where the last ended."""
    checkpoint = checkpoint or f"{out_path.rstrip('/')}/_checkpoint"
    w = (image_stream(spark, folder, glob).writeStream
         .foreachBatch(coverage_sink(model, out_path, size))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
