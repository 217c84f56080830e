"""Band operators on images of many bands, sparse tables and nulls, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascope.operators import bands, raster as RA

SCHEMA = "image_id long, y int, x int, height int, width int, b int, g int, r int"


def _rows(image_id, a, keep=None):
    h, w = a.shape
    return [(image_id, y, x, h, w, None if a[y, x] < 0 else int(a[y, x]), int(abs(a[y, x])) // 2, 255 - int(abs(a[y, x])))
            for y in range(h) for x in range(w) if keep is None or keep[y, x]]


def _images():
    rng = np.random.default_rng(8)
    tall, wide, one = rng.integers(0, 256, (53, 7)), rng.integers(0, 256, (18, 41)), rng.integers(0, 256, (1, 1))
    holes = rng.integers(0, 256, (34, 9))
    holes[rng.random(holes.shape) < 0.1] = -1            # null values of b
    keep = rng.random(holes.shape) < 0.7                 # pixels that the table lacks
    return {1: (tall, None), 2: (wide, None), 3: (one, None), 4: (holes, keep)}


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [r for i, (a, keep) in _images().items() for r in _rows(i, a, keep)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def _window(a, keep, y, x, radius, offsets=None):
    out = []
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if offsets is not None and (dy, dx) not in offsets:
                continue
            yy, xx = y + dy, x + dx
            if 0 <= yy < a.shape[0] and 0 <= xx < a.shape[1] and (keep is None or keep[yy, xx]) and a[yy, xx] >= 0:
                out.append(int(a[yy, xx]))
    return out


def test_stats_over_bands(spark, pixels):
    got = {(r.image_id, r.y, r.x): (r.b_mean, r.b_std) for r in RA.focal_stats(pixels, ["b"]).collect()}
    want = {(i, y, x): w for i, (a, keep) in _images().items() for y in range(a.shape[0]) for x in range(a.shape[1])
            if (w := _window(a, keep, y, x, 1))}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert math.isclose(got[k][0], np.mean(w)) and math.isclose(got[k][1], np.std(w), abs_tol=1e-9)


def test_close_over_bands(spark, pixels):
    kernel = set(RA.ellipse_kernel(5))
    for name, steps in (("dilate", (max,)), ("erode", (min,)), ("morph_close", (max, min))):
        want = {}
        for i, (a, keep) in _images().items():
            now, there = a.copy(), (a >= 0) if keep is None else keep & (a >= 0)
            for op in steps:
                new, has = np.zeros_like(now), np.zeros(now.shape, bool)
                for y in range(a.shape[0]):
                    for x in range(a.shape[1]):
                        w = _window(np.where(there, now, -1), None, y, x, 2, kernel)
                        if w:
                            new[y, x], has[y, x] = op(w), True
                now, there = new, has
            want.update({(i, y, x, *a.shape): int(now[y, x]) for y, x in zip(*np.nonzero(there))})
        got = {(r.image_id, r.y, r.x, r.height, r.width): r.b for r in getattr(RA, name)(pixels, "b").collect()}
        assert got == want, name


def test_smooth_over_bands(spark, pixels):
    g = RA.gaussian_weights(0.5, 1)
    got = {(r.image_id, r.y, r.x): r.g for r in RA.smooth(pixels, ["g"]).collect()}

    def fold(i, n):
        return -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    for i in (1, 2):
        a = _images()[i][0] // 2
        h, w = a.shape
        for y in range(h):
            for x in range(w):
                s = sum(g[dy + 1] * g[dx + 1] * a[fold(y + dy, h), fold(x + dx, w)] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
                assert got[i, y, x] == math.floor(s + 0.5)


def test_wide_images_are_cut_at_columns(spark, pixels, monkeypatch):
    whole = {k: {tuple(r) for r in f(pixels).collect()} for k, f in (("stats", RA.focal_stats), ("close", lambda p: RA.morph_close(p, "g")))}
    monkeypatch.setattr(bands, "SPAN", 8)
    monkeypatch.setattr(bands, "CHUNK", 100)
    assert {tuple(r) for r in RA.morph_close(pixels, "g").collect()} == whole["close"]


def test_rows_shuffled_are_input_plus_halos(spark):
    a = np.zeros((160, 6), int)
    px = spark.createDataFrame(_rows(1, a), SCHEMA)
    plan = RA.focal_stats(px)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    # ten bands: 160 rows and one halo row on each side of nine inner borders
    reach = F.explode(F.sequence(F.expr("greatest(floor((y - 1) / 16), 0)"), F.expr("least(floor((y + 1) / 16), floor((height - 1) / 16))")))
    assert px.select("y", "x", reach).count() == (160 + 18) * 6


def test_reduced_images_ship_only_pixels_in_use(spark):
    a = np.arange(200 * 200).reshape(200, 200) % 256
    px = spark.createDataFrame(_rows(1, a), SCHEMA)
    y0, y1 = bands._readers(F.col("y"), F.col("height"), 10)
    used = px.where(y0 <= y1).select("y").distinct().count()
    assert 20 <= used <= 24
    got = {(r.y, r.x): r.b for r in RA.resize_bilinear(px, 10, 10).collect()}
    assert len(got) == 100
    for (y, x), b in got.items():
        fy, fx = (y + 0.5) * 20 - 0.5, (x + 0.5) * 20 - 0.5
        y0, x0 = int(fy), int(fx)
        v = sum(wy * wx * a[y0 + dy, x0 + dx] for dy, wy in ((0, 1 - fy + y0), (1, fy - y0)) for dx, wx in ((0, 1 - fx + x0), (1, fx - x0)))
        assert b == math.floor(v + 0.5)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert RA.focal_stats(none).count() == RA.morph_close(none, "b").count() == RA.resize_bilinear(none, 4, 4).count() == 0
