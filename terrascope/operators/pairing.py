"""Pairing operators: image <-> mask by id (J1), pixel <-> label (J2),
stacking pixel sources (U1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID_PATTERN = r"_(\d+)\."


def id_from_name(c: F.Column) -> F.Column:
    """Numeric id in a file name such as ``satellite_0042.jpg`` -> 42; NULL for
    a name without one."""
    return F.regexp_extract(c, ID_PATTERN, 1).try_cast("long")


def name_id(col: str) -> F.Column:
    """``id_from_name`` of a column given by name."""
    return id_from_name(F.col(col))


def pair_by_id(images: DataFrame, masks: DataFrame, image_col: str = "image_name",
               mask_col: str = "mask_name") -> DataFrame:
    """Image and mask with the same parsed id (an equi-join instead of
    positional pairing of two sorted lists)."""
    im = images.select(name_id(image_col).alias("image_id"), image_col)
    mk = masks.select(name_id(mask_col).alias("image_id"), mask_col)
    return im.join(mk, "image_id")


def pair_unmatched(images: DataFrame, masks: DataFrame, image_col: str = "image_name",
                   mask_col: str = "mask_name") -> DataFrame:
    """J1 check: names without a partner, both directions (``left_anti``)."""
    im = images.select(name_id(image_col).alias("image_id"), F.col(image_col).alias("name"))
    mk = masks.select(name_id(mask_col).alias("image_id"), F.col(mask_col).alias("name"))
    return (im.join(mk.select("image_id"), "image_id", "left_anti").withColumn("missing", F.lit("mask"))
            .unionByName(mk.join(im.select("image_id"), "image_id", "left_anti")
                         .withColumn("missing", F.lit("image"))))


def pixel_label_join(pixels: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Attach each pixel's label by ``(image_id, y, x)``."""
    return pixels.join(labels.select("image_id", "y", "x", label), ["image_id", "y", "x"])


def union_pixels(*tables: DataFrame, source_col: str = "source", names=None) -> DataFrame:
    """Stack pixel tables from several sources by column name."""
    out = None
    for i, t in enumerate(tables):
        tagged = t.withColumn(source_col, F.lit(names[i] if names else str(i)))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
