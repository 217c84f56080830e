"""Raster operators on pixel tables (R1, R3-R10, J6, J8, F10s-F12s).

A pixel table has one row per pixel: ``image_id, y, x, height, width`` plus
value columns (``b, g, r`` or ``label``...).  Carrying ``height`` / ``width``
on every row lets bounds checks run inside the row, with no dimension join.

Neighbourhood ("focal") operators and bilinear resampling run on bands of
packed image rows (``bands``): one exchange ships each pixel to its band, plus a
halo of rows that windows read beyond it, so a huge image is spread over many
tasks and a pixel is not copied to every cell it feeds.  Nearest resampling is
written *source side*: each pixel is exploded (map side, no shuffle) to the
output cells that read it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascope.functions.numeric import clip
from terrascope.operators import bands
from terrascope.session import ship

KEY = ("image_id", "y", "x")


# --- decoding (R1, S7) --------------------------------------------------------

PIXEL_SCHEMA = "image_id long, y int, x int, height int, width int, b int, g int, r int"
GREY_SCHEMA = "image_id long, y int, x int, height int, width int, v int"


def _decode_blocks(images: DataFrame, id_col: str, image_col: str, pixels, names: Sequence[str], schema: str) -> DataFrame:
    """Image-source rows (``struct<origin,height,width,nChannels,mode,data>``, row-major
    BGR bytes) -> ``image_id, y, x, height, width`` and the columns that ``pixels`` (numpy,
    one row per pixel and one column per channel) makes of a block of image rows.
    Invalid images (height -1) produce no pixels."""

    ship(images.sparkSession)
    max_pixels = 1 << 20      # pixels per output batch: a huge image is emitted in row blocks

    def decode_batches(batches):
        """Arrow batches of images -> pixel batches of at most ``max_pixels``
        rows (whole image rows), so memory stays bounded for any image size."""
        for batch in batches:
            image = batch.column(1)
            size = [image.field(name).to_pylist() for name in ("height", "width", "nChannels")]
            data = image.field("data")
            for i, (h, w, nc) in enumerate(zip(*size)):
                if h is None or h <= 0 or not image[i].is_valid:
                    continue
                whole = np.frombuffer(data[i].as_buffer(), dtype=np.uint8).reshape(h, w, nc)
                step = max(1, max_pixels // w)
                for y0 in range(0, h, step):
                    block = whole[y0:y0 + step].reshape(-1, nc)
                    n = block.shape[0]
                    p = np.arange(n, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.full(n, i))), pa.array(y0 + p // w), pa.array(p % w),
                         pa.array(np.full(n, h, dtype=np.int32)), pa.array(np.full(n, w, dtype=np.int32)),
                         *[pa.array(c) for c in pixels(block)]],
                        names=["image_id", "y", "x", "height", "width", *names])

    source = images.select(F.col(id_col).cast("long").alias("image_id"), F.col(image_col).alias("image"))
    return source.mapInArrow(decode_batches, schema)


def _bgr(block: np.ndarray) -> list[np.ndarray]:
    """Blue, green and red of a block; one channel gives all three."""
    return [block[:, min(j, block.shape[1] - 1) if block.shape[1] >= 3 else 0].astype(np.int32) for j in range(3)]


def _luma(block: np.ndarray) -> list[np.ndarray]:
    b, g, r = (c.astype(np.float64) for c in _bgr(block))
    return [np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5).astype(np.int32)]


def decode_image(images: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """Image-source rows -> one row per pixel ``image_id, y, x, height, width, b, g, r``
    (``_decode_blocks``).  One-channel images give ``b = g = r``."""
    return _decode_blocks(images, id_col, image_col, _bgr, ["b", "g", "r"], PIXEL_SCHEMA)


def grey(b: str = "b", g: str = "g", r: str = "r") -> Column:
    """8-bit luma ``0.114 b + 0.587 g + 0.299 r`` rounded."""
    return F.floor(F.lit(0.114) * F.col(b) + F.lit(0.587) * F.col(g) + F.lit(0.299) * F.col(r)
                   + F.lit(0.5)).cast("int")


def decode_grey(images: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """Masks as one grey value ``v`` per pixel, by the same block decoder:
    one-channel images give their value, colour images their luma (the weights sum
    to 1, so both cases are ``grey(b, g, r)``)."""
    return _decode_blocks(images, id_col, image_col, _luma, ["v"], GREY_SCHEMA)


def pixel_features(pixels: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """R1/F11s: ``[b, g, r, y/h, x/w]`` per pixel."""
    return pixels.select(*KEY, "height", "width", *carry, "b", "g", "r",
                         (F.col("y") / F.col("height")).alias("yn"),
                         (F.col("x") / F.col("width")).alias("xn"))


def mask_labels(mask: DataFrame, value: str = "v", threshold: int = 127) -> DataFrame:
    """F12s: grey mask value > threshold -> label 1 (forest) else 0."""
    return mask.withColumn("label", (F.col(value) > threshold).cast("int"))


# --- colour (R2, R8, R9) ----------------------------------------------------

def hsv(b: str = "b", g: str = "g", r: str = "r") -> tuple[Column, Column, Column]:
    """R2: 8-bit HSV of BGR bytes (H in 0..179, S and V in 0..255)."""
    B, G, R = F.col(b).cast("double"), F.col(g).cast("double"), F.col(r).cast("double")
    v = F.greatest(B, G, R)
    mn = F.least(B, G, R)
    d = v - mn
    s = F.when(v > 0, F.lit(255.0) * d / v).otherwise(F.lit(0.0))
    h = (F.when(d == 0, F.lit(0.0))
         .when(v == R, F.lit(60.0) * (G - B) / d)
         .when(v == G, F.lit(120.0) + F.lit(60.0) * (B - R) / d)
         .otherwise(F.lit(240.0) + F.lit(60.0) * (R - G) / d))
    h = F.when(h < 0, h + F.lit(360.0)).otherwise(h)
    rnd = lambda c: F.floor(c + F.lit(0.5)).cast("int")
    return rnd(h / F.lit(2.0)), rnd(s), v.cast("int")


def _srgb_linear(c: Column) -> Column:
    c = c / F.lit(255.0)
    return F.when(c <= 0.04045, c / F.lit(12.92)).otherwise(F.pow((c + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))


def lab(b: str = "b", g: str = "g", r: str = "r") -> tuple[Column, Column, Column]:
    """R2: 8-bit CIE L*a*b* of BGR bytes (sRGB, D65 white; L scaled to
    0..255, a and b offset by 128), following the published formulas."""
    R, G, B = _srgb_linear(F.col(r)), _srgb_linear(F.col(g)), _srgb_linear(F.col(b))
    X = (F.lit(0.412453) * R + F.lit(0.357580) * G + F.lit(0.180423) * B) / F.lit(0.950456)
    Y = F.lit(0.212671) * R + F.lit(0.715160) * G + F.lit(0.072169) * B
    Z = (F.lit(0.019334) * R + F.lit(0.119193) * G + F.lit(0.950227) * B) / F.lit(1.088754)

    def f(t):
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(F.lit(7.787) * t + F.lit(16.0 / 116.0))

    L = F.when(Y > 0.008856, F.lit(116.0) * F.pow(Y, F.lit(1.0 / 3.0)) - F.lit(16.0)).otherwise(F.lit(903.3) * Y)
    a = F.lit(500.0) * (f(X) - f(Y)) + F.lit(128.0)
    bb = F.lit(200.0) * (f(Y) - f(Z)) + F.lit(128.0)
    rnd = lambda c: clip(F.floor(c + F.lit(0.5)), 0, 255).cast("int")
    return rnd(L * F.lit(255.0 / 100.0)), rnd(a), rnd(bb)


# Class colours in BGR order (0 = deforested, 1 = forest).
DEFORESTED_BGR = (0, 0, 255)
FOREST_BGR = (0, 255, 0)


def color_mask(labels: DataFrame, label: str = "label") -> DataFrame:
    """Label -> BGR colour columns ``mb, mg, mr``."""
    lab_ = F.col(label)
    cols = []
    for i, name in enumerate(("mb", "mg", "mr")):
        cols.append(F.when(lab_ == 1, F.lit(FOREST_BGR[i])).when(lab_ == 0, F.lit(DEFORESTED_BGR[i]))
                    .otherwise(F.lit(0)).alias(name))
    return labels.select("*", *cols)


def overlay(df: DataFrame, alpha: float = 0.7, beta: float = 0.3) -> DataFrame:
    """R9 + F10s: ``alpha * image + beta * mask`` rounded (ties to even) and saturated."""
    out = []
    for c, m in (("b", "mb"), ("g", "mg"), ("r", "mr")):
        v = F.rint(F.lit(alpha) * F.col(c) + F.lit(beta) * F.col(m))
        out.append(clip(v, 0, 255).cast("int").alias(f"o{c}"))
    return df.select("*", *out)


# --- focal (neighbourhood) operators: R3, R4, R5 -----------------------------

def focal_stats(pixels: DataFrame, values: Sequence[str] = ("b", "g", "r"), radius: int = 1) -> DataFrame:
    """Mean and *population* std of each value over the (2r+1)^2 window,
    cut at the border."""
    out = [(f"{v}_{name}", "double") for v in values for name in ("mean", "std")]
    return bands.tile_map(pixels, values, radius, out, bands.window_stats(radius))


def ellipse_kernel(size: int = 5) -> list[tuple[int, int]]:
    """Offsets of an elliptical structuring element of odd ``size``: row
    ``i`` spans ``|dx| <= round(r * sqrt(1 - (dy / r)^2))`` (for size 5: the
    5x5 square without its four corner pairs)."""
    r = size // 2
    out = []
    for dy in range(-r, r + 1):
        half = int(round(r * math.sqrt(max(0.0, 1.0 - (dy / r) ** 2)))) if r else 0
        if abs(dy) == r:
            half = 0
        out += [(dy, dx) for dx in range(-half, half + 1)]
    return out


def _morph(pixels: DataFrame, value: str, size: int, steps: Sequence[str]) -> DataFrame:
    radius, operator = bands.morphology(ellipse_kernel(size), steps)
    return bands.tile_map(pixels, [value], radius, [(value, dict(pixels.dtypes)[value])], operator, sizes=True)


def dilate(pixels: DataFrame, value: str = "label", size: int = 5) -> DataFrame:
    """Maximum over an elliptical neighbourhood (outside cells ignored)."""
    return _morph(pixels, value, size, ["max"])


def erode(pixels: DataFrame, value: str = "label", size: int = 5) -> DataFrame:
    """Minimum over an elliptical neighbourhood (outside cells ignored)."""
    return _morph(pixels, value, size, ["min"])


def morph_close(pixels: DataFrame, value: str = "label", size: int = 5) -> DataFrame:
    """closing = dilate (max) then erode (min) with an elliptical kernel;
    out-of-image neighbours are ignored.  Both run on one band with a halo of
    twice the kernel's radius: one exchange."""
    return _morph(pixels, value, size, ["max", "min"])


def gaussian_weights(sigma: float = 0.5, radius: int = 1) -> list[float]:
    """Normalised 1-D Gaussian weights for offsets -radius..radius."""
    g = [math.exp(-(i * i) / (2.0 * sigma * sigma)) for i in range(-radius, radius + 1)]
    s = sum(g)
    return [v / s for v in g]


def smooth(pixels: DataFrame, values: Sequence[str] = ("b", "g", "r"), sigma: float = 0.5,
           radius: int = 1) -> DataFrame:
    """Separable Gaussian smoothing (3x3, sigma 0.5), border reflected
    without repeating the edge; results rounded to 8-bit."""
    operator = bands.weighted_window(gaussian_weights(sigma, radius), radius)
    return bands.tile_map(pixels, values, radius, [(v, "int") for v in values], operator)


# --- resampling: R6, R7 / J8 --------------------------------------------------

def resize_nearest(pixels: DataFrame, out_h: int | str, out_w: int | str, values: Sequence[str]) -> DataFrame:
    """Nearest-neighbour resize.  Output cell ``t`` reads source
    ``floor(t * n / out)``; written source side (each source pixel explodes to
    the output cells that read it), so it is map-only -- no shuffle.
    ``out_h`` / ``out_w`` are sizes or names of per-row size columns (e.g. the
    original size when a result is scaled back)."""
    oh = F.lit(out_h) if isinstance(out_h, int) else F.col(out_h)
    ow = F.lit(out_w) if isinstance(out_w, int) else F.col(out_w)

    def rng(s, n, o):
        # output cells t with floor(t * n / o) == s:  ceil(s*o/n) <= t <= ceil((s+1)*o/n) - 1
        lo = F.floor((s * o + n - F.lit(1)) / n).cast("int")
        hi = (F.floor(((s + F.lit(1)) * o + n - F.lit(1)) / n) - F.lit(1)).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi))

    carry = [c for c in pixels.columns if c not in ("image_id", "y", "x", "height", "width", *values)]
    step1 = pixels.select("image_id", "x", "width", *carry, *values,
                          oh.alias("_oh"), ow.alias("_ow"),
                          F.explode(rng(F.col("y"), F.col("height"), oh)).alias("_ty"))
    step2 = step1.select("image_id", "_ty", "_oh", "_ow", *carry, *values,
                         F.explode(rng(F.col("x"), F.col("width"), F.col("_ow"))).alias("_tx"))
    return step2.select("image_id", F.col("_ty").alias("y"), F.col("_tx").alias("x"),
                        F.col("_oh").cast("int").alias("height"), F.col("_ow").cast("int").alias("width"),
                        *carry, *values)


def resize_bilinear(pixels: DataFrame, out_h: int, out_w: int, values: Sequence[str] = ("b", "g", "r"),
                    keep_source_size: bool = False) -> DataFrame:
    """Bilinear resize with pixel-centre alignment: source position
    ``(t + 0.5) * n / out - 0.5``, clamped at the edges, four weighted
    neighbours, rounded to 8-bit.

    Two 1-D passes on bands of output rows; one exchange of the source pixels that
    any output reads, no per-image dimension table, no join.  ``keep_source_size``
    adds ``src_height`` / ``src_width``, so a later resize back to the original size
    needs no join."""
    return bands.resize_bilinear(pixels, out_h, out_w, values, keep_source_size)


# --- theta join: J6 -------------------------------------------------------------

def ellipse_label(pixels: DataFrame, patches: Sequence[tuple[float, float, float, float]],
                  out: str = "label") -> DataFrame:
    """Label 1 where a pixel lies in any elliptical patch ``(cx, cy, w, h)``,
    ``((x-cx)/w)^2 + ((y-cy)/h)^2 <= 1``, else 0: one boolean column, no join.
    ``ellipse_label_per_image`` takes patches as a table."""
    inside = F.lit(False)
    for cx, cy, w, h in patches:
        dx, dy = (F.col("x") - F.lit(cx)) / F.lit(float(w)), (F.col("y") - F.lit(cy)) / F.lit(float(h))
        inside = inside | (dx * dx + dy * dy <= 1)
    return pixels.withColumn(out, inside.cast("int"))


def ellipse_label_per_image(pixels: DataFrame, patches: DataFrame, out: str = "label") -> DataFrame:
    """J6, general form: ``patches`` is a table ``image_id, cx, cy, w, h``
    (any number of patches per image, growing with the data).

    Each patch explodes to the integer cells of its bounding box (bounded by
    the patch size), keeps the cells inside the ellipse, and the distinct
    inside cells left-join the pixels on the full coordinate
    ``(image_id, y, x)`` -- an equi-join, no pixel x patch pairs.
    """
    ys = F.sequence(F.floor(F.col("cy") - F.col("h")).cast("int"), F.ceil(F.col("cy") + F.col("h")).cast("int"))
    xs = F.sequence(F.floor(F.col("cx") - F.col("w")).cast("int"), F.ceil(F.col("cx") + F.col("w")).cast("int"))
    cells = (patches.select("image_id", "cx", "cy", "w", "h", F.explode(ys).alias("_cy"))
             .select("image_id", "cx", "cy", "w", "h", "_cy", F.explode(xs).alias("_cx"))
             .filter(((F.col("_cx") - F.col("cx")) / F.col("w")) ** 2
                     + ((F.col("_cy") - F.col("cy")) / F.col("h")) ** 2 <= 1)
             .select(F.col("image_id").alias("_img"), "_cy", "_cx").distinct()
             .withColumn("_in", F.lit(1)))
    cond = (F.col("image_id") == F.col("_img")) & (F.col("y") == F.col("_cy")) & (F.col("x") == F.col("_cx"))
    return (pixels.join(cells, cond, "left")
            .withColumn(out, F.coalesce(F.col("_in"), F.lit(0))).drop("_img", "_cy", "_cx", "_in"))


# --- packing: R10, S10 ------------------------------------------------------------

def grid_pack(pixels: DataFrame, value: str = "label") -> DataFrame:
    """Pixel rows -> ``array<array<int>>`` grid per image.

    Two levels: rows are packed per ``(image_id, y)`` first, then the rows per
    image, so no step sorts more than one image row or one column of rows.
    A group is one image, bounded by the image size.
    """
    rows = (pixels.groupBy("image_id", "y")
            .agg(F.array_sort(F.collect_list(F.struct("x", value))).alias("_row"))
            .select("image_id", "y", F.col("_row")[value].alias("_vals")))
    return (rows.groupBy("image_id")
            .agg(F.array_sort(F.collect_list(F.struct("y", "_vals"))).alias("_rows"))
            .select("image_id", F.col("_rows")["_vals"].alias("grid")))


def pack_instances(pixels: DataFrame) -> DataFrame:
    """Pixel rows -> request instances ``image: array<array<array<int>>>``
    (``[y][x][b, g, r]``)."""
    px = pixels.withColumn("label", F.array("b", "g", "r"))
    return grid_pack(px, "label").withColumnRenamed("grid", "image")


def explode_instances(instances: DataFrame, image_col: str = "image") -> DataFrame:
    """Nested-array instances -> pixel rows; instances without an image
    are skipped."""
    rows = instances.filter(F.col(image_col).isNotNull()).select(
        "image_id", F.size(image_col).alias("height"), F.posexplode(image_col).alias("y", "_row"))
    px = rows.select("image_id", "height", "y", F.size("_row").alias("width"),
                     F.posexplode("_row").alias("x", "_bgr"))
    return px.select("image_id", "y", "x", "height", "width",
                     F.col("_bgr")[0].alias("b"), F.col("_bgr")[1].alias("g"), F.col("_bgr")[2].alias("r"))


# --- coverage: A15 ------------------------------------------------------------------

def coverage(labels: DataFrame, label: str = "label") -> DataFrame:
    """Forest and deforested share per image in percent, rounded like
    numpy (``rint(x * 100) / 100``)."""
    from terrascope.functions.numeric import round_rint
    agg = labels.groupBy("image_id").agg(
        F.count_if(F.col(label) == 1).alias("_f"), F.count_if(F.col(label) == 0).alias("_d"),
        F.count(F.lit(1)).alias("total_pixels"))
    return agg.select(
        "image_id", "total_pixels",
        round_rint(F.col("_f") / F.col("total_pixels") * F.lit(100.0), 2).alias("forest_percentage"),
        round_rint(F.col("_d") / F.col("total_pixels") * F.lit(100.0), 2).alias("deforested_percentage"))
