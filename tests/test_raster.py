"""Raster operators against brute-force numpy on small hand grids."""

import math

import numpy as np
from pyspark.sql import functions as F

from terrascope.operators import raster as RA
from terrascope.operators.sampling import sample_per_image, stratified_split


def _grid(spark, arr, image_id=1, name="v"):
    h, w = arr.shape
    rows = [(image_id, y, x, h, w, int(arr[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, f"image_id long, y int, x int, height int, width int, {name} int")


def _to_np(df, h, w, col):
    out = np.full((h, w), -1)
    for r in df.collect():
        out[r.y, r.x] = r[col]
    return out


def test_ellipse_kernel_5():
    k = set(RA.ellipse_kernel(5))
    assert len(k) == 17
    assert (0, -2) in k and (-2, 0) in k and (-2, -1) not in k and (-1, -2) in k


def test_close_matches_bruteforce(spark):
    rng = np.random.default_rng(1)
    a = (rng.random((9, 7)) > 0.6).astype(int)
    k = RA.ellipse_kernel(5)

    def morph(src, op):
        out = np.zeros_like(src)
        for y in range(src.shape[0]):
            for x in range(src.shape[1]):
                vals = [src[y + dy, x + dx] for dy, dx in k
                        if 0 <= y + dy < src.shape[0] and 0 <= x + dx < src.shape[1]]
                out[y, x] = op(vals)
        return out

    expect = morph(morph(a, max), min)
    got = _to_np(RA.morph_close(_grid(spark, a, name="label")), 9, 7, "label")
    assert (got == expect).all()


def test_smooth_matches_bruteforce(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (6, 5))
    g = RA.gaussian_weights(0.5, 1)

    def refl(i, n):
        return -i if i < 0 else (2 * (n - 1) - i if i >= n else i)

    expect = np.zeros_like(a)
    for y in range(6):
        for x in range(5):
            s = sum(g[dy + 1] * g[dx + 1] * a[refl(y + dy, 6), refl(x + dx, 5)]
                    for dy in (-1, 0, 1) for dx in (-1, 0, 1))
            expect[y, x] = math.floor(s + 0.5)
    px = _grid(spark, a, name="b").withColumn("g", F.col("b")).withColumn("r", F.col("b"))
    got = _to_np(RA.smooth(px), 6, 5, "b")
    assert (got == expect).all()


def test_focal_stats_border_cut(spark):
    a = np.arange(12).reshape(3, 4)
    px = _grid(spark, a, name="b").withColumn("g", F.col("b")).withColumn("r", F.col("b"))
    out = {(r.y, r.x): r for r in RA.focal_stats(px).collect()}
    corner = a[0:2, 0:2]
    assert math.isclose(out[(0, 0)].b_mean, corner.mean())
    assert math.isclose(out[(0, 0)].b_std, corner.std())
    assert math.isclose(out[(1, 1)].b_std, a[0:3, 0:3].std())


def test_nearest_up_and_down(spark):
    a = np.arange(16).reshape(4, 4)
    up = _to_np(RA.resize_nearest(_grid(spark, a), 8, 6, ["v"]), 8, 6, "v")
    exp = np.array([[a[(y * 4) // 8, (x * 4) // 6] for x in range(6)] for y in range(8)])
    assert (up == exp).all()
    down = _to_np(RA.resize_nearest(_grid(spark, a), 3, 2, ["v"]), 3, 2, "v")
    exp = np.array([[a[(y * 4) // 3, (x * 4) // 2] for x in range(2)] for y in range(3)])
    assert (down == exp).all()


def test_bilinear_constant_and_ramp(spark):
    a = np.full((4, 4), 77)
    px = _grid(spark, a, name="b").withColumn("g", F.col("b")).withColumn("r", F.col("b"))
    out = RA.resize_bilinear(px, 8, 8).collect()
    assert len(out) == 64 and all(r.b == 77 for r in out)
    ramp = np.tile(np.arange(0, 40, 10), (2, 1))      # 2 x 4, values 0 10 20 30
    px = _grid(spark, ramp, name="b").withColumn("g", F.col("b")).withColumn("r", F.col("b"))
    row = sorted((r.x, r.b) for r in RA.resize_bilinear(px, 2, 8).collect() if r.y == 0)
    # centres: (x + 0.5) / 2 - 0.5 -> -0.25 (clamped to 0), 0.25, 0.75, ... 3.25 (clamped)
    assert [b for _, b in row] == [0, 3, 8, 13, 18, 23, 28, 30]


def test_coverage_sums_to_100(spark):
    a = np.array([[1, 1, 0], [0, 1, 1], [1, 1, 1]])
    cov = RA.coverage(_grid(spark, a, name="label")).first()
    assert cov.forest_percentage == round(7 / 9 * 100, 2)
    assert abs(cov.forest_percentage + cov.deforested_percentage - 100) <= 0.01


def test_grid_pack_and_explode_roundtrip(spark):
    a = np.arange(6).reshape(2, 3)
    px = _grid(spark, a, name="b").withColumn("g", F.col("b") + 1).withColumn("r", F.col("b") + 2)
    inst = RA.pack_instances(px)
    assert inst.first().image == [[[v, v + 1, v + 2] for v in row] for row in a.tolist()]
    back = RA.explode_instances(inst).orderBy("y", "x").collect()
    assert [(r.y, r.x, r.b, r.g, r.r) for r in back] == [(y, x, int(a[y, x]), int(a[y, x]) + 1, int(a[y, x]) + 2)
                                                          for y in range(2) for x in range(3)]


def test_sample_per_image_bounds(spark):
    a = np.zeros((10, 10))
    df = _grid(spark, a).unionByName(_grid(spark, np.zeros((2, 2)), image_id=2))
    out = sample_per_image(df, 7).groupBy("image_id").count().orderBy("image_id").collect()
    assert [r["count"] for r in out] == [7, 4]
    again = sample_per_image(df, 7).select("image_id", "y", "x").collect()
    assert sorted(again) == sorted(sample_per_image(df, 7).select("image_id", "y", "x").collect())


import pytest  # noqa: E402


@pytest.mark.parametrize("hash_fn", ["xxhash64", "md5"])
def test_stratified_split_exact_counts(spark, hash_fn):
    rows = [(i // 50, i % 50, 0, 1 if i % 3 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, label int")
    out = stratified_split(df, bits=4, hash_fn=hash_fn).groupBy("label", "is_train").count().collect()
    counts = {(r.label, r.is_train): r["count"] for r in out}
    n1 = sum(1 for i in range(1000) if i % 3 == 0)
    n0 = 1000 - n1
    assert counts[(1, True)] == round(0.8 * n1) and counts[(0, True)] == round(0.8 * n0)
    assert counts[(1, True)] + counts[(1, False)] == n1


def test_ellipse_label_matches_predicate(spark):
    a = np.zeros((8, 8))
    patches = [(2, 2, 2, 1), (5, 5, 1, 2)]
    got = _to_np(RA.ellipse_label(_grid(spark, a), patches), 8, 8, "label")
    exp = np.array([[int(any(((x - cx) / w) ** 2 + ((y - cy) / h) ** 2 <= 1 for cx, cy, w, h in patches))
                     for x in range(8)] for y in range(8)])
    assert (got == exp).all()


def test_hsv_known_colours(spark):
    df = spark.createDataFrame([(0, 0, 255), (0, 255, 0), (255, 0, 0), (10, 10, 10)], "b int, g int, r int")
    h, s, v = RA.hsv()
    out = [(r.h, r.s, r.v) for r in df.select(h.alias("h"), s.alias("s"), v.alias("v")).collect()]
    assert out == [(0, 255, 255), (60, 255, 255), (120, 255, 255), (0, 0, 10)]


def test_ellipse_label_per_image(spark):
    a = np.zeros((8, 8))
    px = _grid(spark, a, image_id=1).unionByName(_grid(spark, a, image_id=2))
    patches = spark.createDataFrame([(1, 2.0, 2.0, 2.0, 1.0), (1, 5.0, 5.0, 1.0, 2.0), (2, 6.0, 1.0, 1.5, 1.5)],
                                    "image_id long, cx double, cy double, w double, h double")
    got = {(r.image_id, r.y, r.x): r.label for r in RA.ellipse_label_per_image(px, patches).collect()}
    per = {1: [(2, 2, 2, 1), (5, 5, 1, 2)], 2: [(6, 1, 1.5, 1.5)]}
    for (img, y, x), v in got.items():
        exp = int(any(((x - cx) / w) ** 2 + ((y - cy) / h) ** 2 <= 1 for cx, cy, w, h in per[img]))
        assert v == exp
    assert len(got) == 128


def _bilinear_np(a, oh, ow):
    h, w = a.shape

    def axis(t, n, o):
        f = (t + 0.5) * n / o - 0.5
        s0 = math.floor(f)
        if s0 < 0 or s0 >= n - 1:
            return min(max(s0, 0), n - 1), min(max(s0, 0), n - 1), 0.0
        return s0, s0 + 1, f - s0

    out = np.zeros((oh, ow), dtype=int)
    for ty in range(oh):
        y0, y1, fy = axis(ty, h, oh)
        for tx in range(ow):
            x0, x1, fx = axis(tx, w, ow)
            v = ((1 - fy) * (1 - fx) * a[y0, x0] + (1 - fy) * fx * a[y0, x1]
                 + fy * (1 - fx) * a[y1, x0] + fy * fx * a[y1, x1])
            out[ty, tx] = min(255, max(0, math.floor(v + 0.5)))
    return out


def test_bilinear_matches_bruteforce_up_and_down(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (7, 5))
    px = _grid(spark, a, name="b").withColumn("g", F.col("b")).withColumn("r", F.col("b"))
    for oh, ow in ((16, 11), (3, 2), (7, 5), (10, 3)):
        got = _to_np(RA.resize_bilinear(px, oh, ow), oh, ow, "b")
        exp = _bilinear_np(a, oh, ow)
        assert np.abs(got - exp).max() <= 1, (oh, ow)
        assert (got == exp).mean() > 0.97, (oh, ow)
