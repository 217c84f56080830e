"""Registered raster queries over F3 (8x8 pixel grids from ``embeddings``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascope.operators import metrics as MET
from terrascope.operators import pairing as PA
from terrascope.operators import raster as RA
from terrascope.operators.aggregates import class_balance
from terrascope.operators.sampling import sample_per_image, stratified_split
from terrascope.plans import segmentation as SEG
from terrascope.plans.common import rounded
from terrascope.sources import fixtures as FX
from terrascope.sources import images as IM

# Elliptical patches (cx, cy, w, h) for the theta-join key.
PATCHES = [(2, 2, 2, 1), (5, 5, 1, 2)]
UP, DOWN = 16, 4              # resampling targets for the 8 x 8 fixture
MODEL_GRID = 16               # segmentation grid for the 8 x 8 fixture
PX = ["image_id", "y", "x", "height", "width", "b", "g", "r"]


def _px(spark, sf):
    return FX.pixel_grids(spark, sf).select(*PX)


def _truth(spark, sf):
    return FX.pixel_truth(FX.pixel_grids(spark, sf)).select(*PX, "label")


def _masks(spark, sf):
    """Grey masks: forest 255, deforested 0."""
    return _truth(spark, sf).select("image_id", "y", "x", "height", "width", (F.col("label") * 255).alias("v"))


def q_pixel_features(spark, sf):
    decoded = RA.decode_image(IM.encode_image_struct(_px(spark, sf)))
    return rounded(RA.pixel_features(decoded).drop("height", "width"))


def q_pixel_hsv(spark, sf):
    h, s, v = RA.hsv()
    return _px(spark, sf).select("image_id", "y", "x", h.alias("h"), s.alias("s"), v.alias("v"))


def q_pixel_lab(spark, sf):
    L, a, b = RA.lab()
    return _px(spark, sf).select("image_id", "y", "x", L.alias("l"), a.alias("a"), b.alias("lab_b"))


def q_focal_stats(spark, sf):
    return rounded(RA.focal_stats(_px(spark, sf)))


def q_focal_close(spark, sf):
    return RA.morph_close(_truth(spark, sf)).select("image_id", "y", "x", "label")


def q_focal_smooth(spark, sf):
    return RA.smooth(_px(spark, sf))


def q_resample_bilinear(spark, sf):
    return RA.resize_bilinear(_px(spark, sf), UP, UP).select("image_id", "y", "x", "b", "g", "r")


def q_resample_nearest(spark, sf):
    px = _px(spark, sf)
    up = RA.resize_nearest(px, UP, UP, ["b", "g", "r"])
    down = RA.resize_nearest(px, DOWN, DOWN, ["b", "g", "r"])
    return up.unionByName(down).select("image_id", "height", "width", "y", "x", "b", "g", "r")


def q_mask_labels(spark, sf):
    return RA.mask_labels(_masks(spark, sf)).select("image_id", "y", "x", "v", "label")


def q_color_mask(spark, sf):
    return RA.color_mask(_truth(spark, sf)).select("image_id", "y", "x", "label", "mb", "mg", "mr")


def q_overlay_pixels(spark, sf):
    out = RA.overlay(RA.color_mask(_truth(spark, sf)))
    return out.select("image_id", "y", "x", "ob", "og", "or")


def q_grid_pack(spark, sf):
    return RA.grid_pack(_truth(spark, sf), "label")


def q_explode_nested_image(spark, sf):
    return RA.explode_instances(RA.pack_instances(_px(spark, sf)))


def q_image_ext_filter(spark, sf):
    pages = FX.read_table(spark, sf, "pages", "page_id", "url")
    name = IM.file_name("url")
    return pages.select("page_id", name.alias("file_name"), IM.file_extension(name).alias("ext"),
                        IM.allowed_file(name).alias("allowed"))


def _names(spark, sf):
    return FX.image_names(FX.read_table(spark, sf, "embeddings", "vec_id").withColumnRenamed("vec_id", "image_id"))


def q_pair_by_id(spark, sf):
    images, masks = _names(spark, sf)
    return PA.pair_by_id(images, masks)


def q_pair_unmatched(spark, sf):
    images, masks = _names(spark, sf)
    return PA.pair_unmatched(images, masks)


def q_pixel_label_join(spark, sf):
    labels = RA.mask_labels(_masks(spark, sf))
    return PA.pixel_label_join(_px(spark, sf), labels).select(*PX, "label")


def q_ellipse_label(spark, sf):
    return RA.ellipse_label(_px(spark, sf), PATCHES).select("image_id", "y", "x", "label")


def q_union_pixels(spark, sf):
    px = _px(spark, sf)
    small = RA.resize_nearest(px, DOWN, DOWN, ["b", "g", "r"])
    return PA.union_pixels(px, small, names=["original", "small"]).select("source", *PX)


def q_class_balance(spark, sf):
    return rounded(class_balance(_truth(spark, sf)))


def q_forest_coverage(spark, sf):
    up = RA.resize_nearest(_truth(spark, sf), UP, UP, ["label"])
    return RA.coverage(up)


def q_classification_report(spark, sf):
    pred = _truth(spark, sf).withColumn("prediction", (F.col("g") > F.col("r")).cast("int"))
    return rounded(MET.classification_report(pred))


def q_sample_per_image(spark, sf):
    return sample_per_image(_truth(spark, sf), 32).select("image_id", "y", "x", "label")


def q_sample_per_image_md5(spark, sf):
    """W8 with the engine-independent md5 order: the same operator, oracle-checkable."""
    return sample_per_image(_truth(spark, sf), 32, hash_fn="md5").select("image_id", "y", "x", "label")


def q_stratified_split_md5(spark, sf):
    """W9 with the engine-independent md5 order: exact per-class counts, oracle-checkable."""
    return stratified_split(_truth(spark, sf), hash_fn="md5").select("image_id", "y", "x", "label", "is_train")


def q_stratified_split(spark, sf):
    return stratified_split(_truth(spark, sf)).select("image_id", "y", "x", "label", "is_train")


def _trained(spark, sf):
    """Segmenter trained once per context and folder: ``(model, report, test_predictions)``."""
    from terrascope.plans.model_cache import cached_model
    return cached_model(spark, sf, "segmenter", lambda: SEG.train_segmenter(
        _px(spark, sf), _masks(spark, sf), size=MODEL_GRID))


def q_pixel_classifier(spark, sf):
    _, report, _ = _trained(spark, sf)
    return report


def _model(spark, sf):
    return _trained(spark, sf)[0]


def q_score_images(spark, sf):
    model = _model(spark, sf)
    return SEG.score_instances(model, RA.pack_instances(_px(spark, sf)), MODEL_GRID)


def q_segment_images(spark, sf):
    model = _model(spark, sf)
    return SEG.segment(model, _px(spark, sf), MODEL_GRID)["coverage"]


QUERIES = {
    "pixel_features": q_pixel_features,
    "pixel_hsv": q_pixel_hsv,
    "pixel_lab": q_pixel_lab,
    "focal_stats": q_focal_stats,
    "focal_close": q_focal_close,
    "focal_smooth": q_focal_smooth,
    "resample_bilinear": q_resample_bilinear,
    "resample_nearest": q_resample_nearest,
    "mask_labels": q_mask_labels,
    "color_mask": q_color_mask,
    "overlay_pixels": q_overlay_pixels,
    "grid_pack": q_grid_pack,
    "explode_nested_image": q_explode_nested_image,
    "image_ext_filter": q_image_ext_filter,
    "pair_by_id": q_pair_by_id,
    "pair_unmatched": q_pair_unmatched,
    "pixel_label_join": q_pixel_label_join,
    "ellipse_label": q_ellipse_label,
    "union_pixels": q_union_pixels,
    "class_balance": q_class_balance,
    "forest_coverage": q_forest_coverage,
    "classification_report": q_classification_report,
    "sample_per_image": q_sample_per_image,
    "stratified_split": q_stratified_split,
    "sample_per_image_md5": q_sample_per_image_md5,
    "stratified_split_md5": q_stratified_split_md5,
    "pixel_classifier": q_pixel_classifier,
    "score_images": q_score_images,
    "segment_images": q_segment_images,
}
