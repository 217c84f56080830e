"""Forest / deforested pixel segmentation.

Training: pair images with masks, resize both to a common grid (bilinear for
images, nearest for masks), threshold the mask, join pixel features with
labels, split by class, fit a random forest on all training pixels (or on a sample
per image, if a caller wants one), report.
Scoring: resize, featurise, predict, scale the class grid back to the
original size, then coverage, colour mask and overlay per image.

The pixel table is the unit of distribution.  Forests are grown on whole tables
(``grow``); pixels are labelled by the forest's node arrays (``forest``).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascope.operators import metrics as MET
from terrascope.operators import raster as RA
from terrascope.operators.pairing import pixel_label_join
from terrascope.operators.sampling import in_hash_share, sample_per_image, sample_rows, stratified_split
from terrascope.plans import grow
from terrascope.plans.forest import Forest
from terrascope.session import ensure_checkpoint_dir, materialize

FEATURE_COLS = ["b", "g", "r", "yn", "xn"]


#: Training rows of the original, 50 images of 500 pixels: a bound for callers that want one (``max_rows``).
MAX_ROWS = 25_000
#: Image ids that are sent to all tasks, at most.
MAX_BROADCAST = 1 << 20
#: Rows that a node needs to be split.
MIN_SPLIT = 10


def classifier(**params) -> RandomForestClassifier:
    """M10 with the original hyper-parameters as defaults (``minInstancesPerNode`` is
    the leaf size; MLlib has no minimum split size, see ``grow`` and ``forest.pruned``)."""
    p = dict(numTrees=100, maxDepth=20, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=42,
             cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=1024)
    p.update(params)
    return RandomForestClassifier(featuresCol="features", labelCol="label", predictionCol="prediction", **p)


def training_pixels(images: DataFrame, masks: DataFrame, size: int = 128, max_samples: int | None = None,
                    seed: int = 42, mask_value: str = "v", share: float = 1.0) -> DataFrame:
    """Q8 data part: resized image pixels with mask labels, all of them or ``max_samples`` per image.

    ``images``: pixel table with ``b, g, r``; ``masks``: pixel table with a
    grey value column ``mask_value``; both keyed by ``image_id``.  With ``share`` only the
    sampled pixels in the first ``share`` of the hash order: the others are left out
    before the resize (images without such a pixel) and before the join.
    """
    masks = masks.select("image_id", "y", "x", "height", "width", mask_value)
    if share < 1:
        cells = (images.select("image_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
                 .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))))
        some = materialize(cells.where(in_hash_share(share, seed)).select("image_id").distinct(), "sampled_images")
        some = F.broadcast(some) if some.count() <= MAX_BROADCAST else some
        images, masks = images.join(some, "image_id", "left_semi"), masks.join(some, "image_id", "left_semi")
    img = RA.resize_bilinear(images, size, size, ("b", "g", "r"))
    msk = RA.resize_nearest(masks, size, size, [mask_value])
    if share < 1:
        img = img.where(in_hash_share(share, seed))
        if dict(img.dtypes)["image_id"] == dict(msk.dtypes)["image_id"]:      # another type hashes otherwise
            msk = msk.where(in_hash_share(share, seed))
    joined = pixel_label_join(RA.pixel_features(img), RA.mask_labels(msk, mask_value))
    return joined if max_samples is None else sample_per_image(joined, max_samples, seed)


def bounded_samples(images: DataFrame, masks: DataFrame, size: int, max_samples: int | None, max_rows: int, seed: int) -> DataFrame:
    """The first ``max_rows`` in hash order of all samples (``training_pixels``), written.  The images
    and samples of a whole large table are neither joined nor written: a first share of the hash order that holds
    twice ``max_rows`` samples if every pixel has a mask; more of it, in the end all, where it holds too few."""
    pixels = images.select("image_id").distinct().count() * size * size
    share = 2.0 * max_rows / max(pixels, 1)
    if pixels * min((max_samples or size ** 2) / size ** 2, 1.0) <= 4 * max_rows:
        share = 1.0
    while True:
        samples = materialize(training_pixels(images, masks, size, max_samples, seed, share=share), "segmenter_samples")
        n = samples.count()
        if n >= max_rows or share >= 1:
            break
        share = min(8 * share, 1.0)
    return materialize(sample_rows(samples, max_rows, seed), "segmenter_sample") if n > max_rows else samples


def pair_problems(images: DataFrame, masks: DataFrame) -> DataFrame:
    """J1 check on file listings (``image_id``, one row per file): ids that lack a
    partner, files without an id and ids that several files share, as
    ``(image_id, problem)``."""
    def counted(df, n):
        return df.groupBy("image_id").agg(F.count("*").alias(n))
    both = counted(images, "images").join(counted(masks, "masks"), "image_id", "full")
    null = F.col("image_id").isNull()
    problem = (F.when(null, "a file name has no number")
               .when(F.col("images").isNull(), "has no image").when(F.col("masks").isNull(), "has no mask")
               .when(F.col("images") > 1, "has several images").when(F.col("masks") > 1, "has several masks"))
    return both.select("image_id", problem.alias("problem")).where("problem is not null")


def require_pairs(images: DataFrame, masks: DataFrame) -> None:
    """J1 check: every image file has exactly one mask file and vice versa (the
    original stops on unequal counts); raises with a few offending ids."""
    bad = pair_problems(images, masks).limit(5).collect()
    if bad:
        raise ValueError("images and masks do not pair: " + ", ".join(f"{r.image_id} {r.problem}" for r in bad))


def train_segmenter(images: DataFrame, masks: DataFrame, size: int = 128, max_samples: int | None = None,
                    seed: int = 42, test_fraction: float = 0.2, strict: bool = True, max_rows: int | None = None,
                    min_split: int = MIN_SPLIT, **rf_params):
    """Q8: returns ``(model, report_df, test_predictions)``.  ``strict``
    requires every image to have a mask and vice versa.  All pixels are used, unless a caller
    wants at most ``max_samples`` an image or ``max_rows`` in all (in hash order); no split of the
    forest has fewer than ``min_split`` rows."""
    if strict:
        require_pairs(images.select("image_id").distinct(), masks.select("image_id").distinct())
    # The training pixels are written before the split, which reads them twice, and after it,
    # as growing reads them several times: a lost executor re-reads files instead of
    # re-running the resize / join / sample plan.
    if max_rows is None:
        samples = materialize(training_pixels(images, masks, size, max_samples, seed), "segmenter_samples")
    else:
        samples = bounded_samples(images, masks, size, max_samples, max_rows, seed)
    data = materialize(stratified_split(samples, test_fraction=test_fraction, seed=seed), "segmenter_training")
    spark = data.sparkSession
    ensure_checkpoint_dir(spark)
    forest = grow.fit(classifier(**rf_params), data.filter("is_train"), FEATURE_COLS, ["image_id", "y", "x"], min_split)
    model = PipelineModel([VectorAssembler(inputCols=FEATURE_COLS, outputCol="features"), forest])
    test_pred = Forest.of(spark, model).label(data.filter(~F.col("is_train")), FEATURE_COLS, "prediction")
    return model, MET.classification_report(test_pred), test_pred


def predict_pixels(model: PipelineModel, pixels: DataFrame, size: int = 128) -> DataFrame:
    """Resize to the model grid and classify every pixel: ``image_id, y, x,
    height, width, src_height, src_width, label``."""
    small = RA.resize_bilinear(pixels, size, size, ("b", "g", "r"), keep_source_size=True)
    feats = RA.pixel_features(small, carry=("src_height", "src_width"))
    scored = Forest.of(pixels.sparkSession, model).label(feats, FEATURE_COLS)
    return scored.select("image_id", "y", "x", "height", "width", "src_height", "src_width", "label")


def segment(model: PipelineModel, pixels: DataFrame, size: int = 128, keep_grid: bool = False) -> dict[str, DataFrame]:
    """Class grid scaled back to each image's own size (nearest),
    coverage per image (counted after the upscale), colour mask, overlay.
    ``keep_grid`` writes the class grid (at most ``size``^2 rows an image) to the
    shared folder once, so several outputs do not run the model again."""
    grid = predict_pixels(model, pixels, size)        # carries each image's source size
    if keep_grid:
        grid = materialize(grid, "label_grid")
    full = RA.resize_nearest(grid, "src_height", "src_width", ["label"]).drop("src_height", "src_width")
    colored = RA.color_mask(full)
    over = RA.overlay(pixels.select("image_id", "y", "x", "b", "g", "r")
                      .join(colored.select("image_id", "y", "x", "mb", "mg", "mr"), ["image_id", "y", "x"]))
    return {"mask": colored, "overlay": over, "coverage": RA.coverage(full)}


def with_errors(files: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row per file of a decoded folder: its coverage, or an ``error``."""
    named = files.select("image_id", "file_name", "path", F.when(
        F.col("image.height").isNull() | (F.col("image.height") <= 0), "the file cannot be decoded").alias("error"))
    return named.join(coverage, "image_id", "left")


def score_instances(model: PipelineModel, instances: DataFrame, size: int = 128) -> DataFrame:
    """Request instances (nested arrays) -> ``size x size`` class grid
    per instance."""
    px = RA.explode_instances(instances)
    return RA.grid_pack(predict_pixels(model, px, size).drop("src_height", "src_width"), "label")
