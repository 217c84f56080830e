"""Rounding against Python, and the degenerate slope against its defining equations."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascope.functions.numeric import round_exact
from terrascope.operators import aggregates as A


@pytest.mark.parametrize("digits", [0, 1, 2, 4, 9])
def test_round_is_that_of_python(spark, digits):
    rnd = random.Random(digits)
    values = [2.675, 0.125, 0.375, 2.5, -2.5, 1e22, -0.4, 0.0, 1.005, 4503599627370495.5, 1e-300, 123456.785, -2.675]
    values += [rnd.uniform(-1000, 1000) for _ in range(3000)] + [rnd.randint(-10 ** 6, 10 ** 6) / 2 ** rnd.randint(0, 12) for _ in range(3000)]
    values += [rnd.randint(-10 ** 7, 10 ** 7) / 10 ** rnd.randint(1, 10) for _ in range(3000)]
    values += [(2 * rnd.randint(0, 10 ** 6) + 1) / (2 * 10 ** digits) for _ in range(3000)]       # near every tie
    values += [v for v in (struct.unpack("d", rnd.randbytes(8))[0] for _ in range(2000)) if abs(v) < 1e300]
    frame = spark.createDataFrame([(v,) for v in values], "x double").select("x", round_exact("x", digits).alias("r"))
    bad = [(r.x, r.r, round(r.x, digits)) for r in frame.collect() if r.r != round(r.x, digits)]
    assert not bad
    odd = spark.createDataFrame([(float("inf"),), (None,), (float("nan"),)], "x double").select(round_exact("x", 2).alias("r")).collect()
    assert odd[0].r == float("inf") and odd[1].r is None and odd[2].r != odd[2].r


def test_slope_of_one_year_is_the_fit_of_least_norm(spark):
    y = [3.0, 5.5, 4.25, 9.0, 1.5, 2.0]
    rows = [("one", 1997.0, v) for v in y] + [("two", 1990.0 + i, v) for i, v in enumerate(y)] + [("zero", 0.0, 1.0)] * 6
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(
        A.least_norm_slope(F.col("y"), F.col("x")).alias("s")).collect()}
    # columns x and 1 scaled to length one, then least squares of least norm
    x = np.full(len(y), 1997.0)
    a = np.stack([x, np.ones(len(y))], axis=1)
    scale = np.sqrt((a * a).sum(axis=0))
    assert got["one"] == pytest.approx((np.linalg.lstsq(a / scale, np.array(y), rcond=1e-10)[0] / scale)[0])
    assert got["two"] == pytest.approx(np.polyfit(np.arange(1990, 1996), y, 1)[0]) and got["zero"] is None
