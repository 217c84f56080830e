"""Image sources (S6-S8) and the image-struct encoding of pixel tables.

Spark's ``image`` data source decodes PNG / BMP / TIFF (and JPEG where the
JVM has a reader) into ``struct<origin, height, width, nChannels, mode,
data>`` with row-major BGR bytes -- one row per image, so decoding is spread
over files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascope.operators.pairing import id_from_name



# Accepted upload extensions (compared case-insensitively).
ALLOWED_EXTENSIONS = ["png", "jpg", "jpeg", "tif", "tiff"]


def named(df: DataFrame, path, key: str, *columns) -> DataFrame:
    """``image_id, file_name, path`` and ``columns``.  ``key="number"`` parses the
    id from the file name (``name_0042.png`` -> 42, NULL without a number) to pair
    images with masks; ``key="path"`` hashes the whole path, so files of any name
    are told apart."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    image_id = F.xxhash64(path) if key == "path" else id_from_name(name)
    return df.select(image_id.alias("image_id"), name.alias("file_name"), path.alias("path"), *columns)


def read_images(spark: SparkSession, path: str, glob: str | None = None, drop_invalid: bool = True,
                recursive: bool = False, key: str = "number") -> DataFrame:
    """Decode images under ``path``; ``glob`` filters names (e.g.
    ``*.{png,jpg}``); invalid files are dropped (training) or kept with
    ``height = -1`` (scoring reports them).  ``image_id, file_name, path, image``;
    see ``named`` for ``key``."""
    r = spark.read.format("image").option("dropInvalid", drop_invalid)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    return named(r.load(path), F.col("image.origin"), key, "image")


def list_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """File listing ``image_id, file_name, path`` without decoding: the
    ``binaryFile`` source reads no content when only ``path`` is selected."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return named(r.load(path), F.col("path"), "number")


def file_name(path_col: str) -> F.Column:
    """F14s: text after the last ``/``."""
    return F.regexp_extract(F.col(path_col), r"([^/]*)$", 1)


def file_extension(name_col) -> F.Column:
    """F14s: lower-cased text after the last dot; NULL without a dot."""
    c = F.col(name_col) if isinstance(name_col, str) else name_col
    return F.when(c.contains("."), F.lower(F.substring_index(c, ".", -1)))


def allowed_file(name_col) -> F.Column:
    """Name has a dot and an allowed extension."""
    return F.coalesce(file_extension(name_col).isin(*ALLOWED_EXTENSIONS), F.lit(False))


def encode_image_struct(pixels: DataFrame) -> DataFrame:
    """Pixel rows ``(image_id, y, x, height, width, b, g, r)`` -> one row per
    image with the image-source struct (BGR, row-major).

    Two levels, like the image source's own layout: each image row's bytes
    are concatenated in ``x`` order, then the rows in ``y`` order, so no sort
    spans more than one image side.  The result holds one image per row, as
    the ``image`` source does."""
    hexed = pixels.select(
        "image_id", "y", "x", "height", "width",
        F.concat(*[F.lpad(F.hex(F.col(c)), 2, "0") for c in ("b", "g", "r")]).alias("_hex"))
    rows = hexed.groupBy("image_id", "y").agg(
        F.max("height").alias("height"), F.max("width").alias("width"),
        F.concat_ws("", F.array_sort(F.collect_list(F.struct("x", "_hex")))["_hex"]).alias("_row"))
    per = rows.groupBy("image_id").agg(
        F.max("height").alias("height"), F.max("width").alias("width"),
        F.array_sort(F.collect_list(F.struct("y", "_row"))).alias("_rows"))
    return per.select(
        "image_id",
        F.struct(F.concat(F.lit("mem://image_"), F.col("image_id").cast("string")).alias("origin"),
                 F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"),
                 F.lit(3).alias("nChannels"), F.lit(16).alias("mode"),
                 F.unhex(F.concat_ws("", F.col("_rows")["_row"])).alias("data")).alias("image"))
