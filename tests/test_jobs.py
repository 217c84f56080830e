"""Batch jobs end to end on files written by the test."""

import os

from pyspark.sql import functions as F

from terrascope.plans import jobs as J
from terrascope.sources import fixtures as FX
from tests.conftest import SF_SMALL
from tests.pngs import two_half_image, write_png

SMALL = {"random_forest": {"numTrees": 3, "maxDepth": 3}, "gradient_boosting": {"maxIter": 3, "maxDepth": 2}}


def test_climate_job_and_reports(spark, tmpdir_run):
    g = FX.global_series(spark, SF_SMALL).select("dt", "LandAverageTemperature",
                                                 F.lit("0.1").alias("LandAverageTemperatureUncertainty"))
    g.coalesce(1).write.option("header", True).csv(f"{tmpdir_run}/GlobalTemperatures.csv")
    c = FX.country_monthly(spark, SF_SMALL).select("dt", "AverageTemperature", "Country")
    c.coalesce(1).write.option("header", True).csv(f"{tmpdir_run}/ByCountry.csv")
    out = f"{tmpdir_run}/out"
    w = J.climate_job(spark, f"{tmpdir_run}/GlobalTemperatures.csv", out, country_csv=f"{tmpdir_run}/ByCountry.csv",
                      city_csv=f"{tmpdir_run}/missing.csv", params=SMALL, cv_folds=2)
    assert w["best"] == "linear_regression" and "city" not in w
    assert any(d.startswith("Decade=") for d in os.listdir(f"{out}/processed/country"))
    assert spark.read.option("header", True).csv(f"{out}/metrics").count() == 3
    reps = J.climate_reports(spark, out, years=2)
    assert reps["forecast"].count() == 24
    s = reps["summary"].first()
    assert s.future_predictions_available and s.data_years >= 1 and len(s.last_updated) == 19
    assert reps["top_warming_countries"].count() <= 10 and reps["total_countries"].first()[0] >= 1


def test_segmenter_and_scoring_jobs(spark, tmpdir_run):
    for sub in ("images", "masks", "inbox"):
        os.makedirs(f"{tmpdir_run}/{sub}")
    for i in range(3):
        img = two_half_image(10, 10)
        if i % 2:
            img = [r[::-1] for r in img]
        write_png(f"{tmpdir_run}/images/satellite_{i:04d}.png", img)
        write_png(f"{tmpdir_run}/masks/mask_{i:04d}.png", [[255 if p == (34, 139, 34) else 0 for p in r] for r in img],
                  grey=True)
        write_png(f"{tmpdir_run}/inbox/upload_{i:04d}.png", img)
    m = J.segmenter_job(spark, f"{tmpdir_run}/images", f"{tmpdir_run}/masks", f"{tmpdir_run}/out", size=8,
                        numTrees=3, maxDepth=4)
    res = J.scoring_job(spark, m["model"], f"{tmpdir_run}/inbox", f"{tmpdir_run}/out", size=8)
    cov = spark.read.parquet(res["coverage"]).collect()
    assert len(cov) == 3 and all(abs(r.forest_percentage - 50) <= 10 for r in cov)
    assert spark.read.parquet(res["overlay"]).count() == 300
    # names without a number, equal numbers, another format, junk
    os.makedirs(f"{tmpdir_run}/any")
    green, red = [[(0, 200, 0)] * 8] * 8, [[(200, 0, 0)] * 8] * 8
    write_png(f"{tmpdir_run}/any/a_1.png", green)
    write_png(f"{tmpdir_run}/any/b_1.png", red)
    write_png(f"{tmpdir_run}/any/forest.png", green)
    with open(f"{tmpdir_run}/any/junk_7.png", "wb") as f:
        f.write(b"junk")
    write_jpeg(spark, f"{tmpdir_run}/any/photo.jpg")
    res = J.scoring_job(spark, m["model"], f"{tmpdir_run}/any", f"{tmpdir_run}/any_out", size=8)
    got = {r.file_name: r for r in spark.read.parquet(res["coverage"]).collect()}
    assert sorted(got) == ["a_1.png", "b_1.png", "forest.png", "junk_7.png", "photo.jpg"]
    assert got["junk_7.png"].error and got["junk_7.png"].forest_percentage is None
    assert got["a_1.png"].total_pixels == got["b_1.png"].total_pixels == 64 and got["photo.jpg"].total_pixels == 96
    assert got["a_1.png"].forest_percentage == got["forest.png"].forest_percentage
    assert spark.read.parquet(res["mask"]).count() == 3 * 64 + 96


def write_jpeg(spark, path, width=12, height=8):
    """A JPEG written by the JVM's own encoder."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(path))


def test_pair_problems(spark):
    from terrascope.plans.segmentation import pair_problems
    im = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "image_id long")
    mk = spark.createDataFrame([(1,), (2,), (4,), (4,)], "image_id long")
    got = {r.image_id: r.problem for r in pair_problems(im, mk).collect()}
    assert got == {2: "has several images", 3: "has no mask", 4: "has no image", None: "a file name has no number"}


def test_scale_settings_are_kept_and_restored(spark, tmpdir_run):
    from terrascope.operators.joins import path_bytes
    from terrascope.session import scaled_conf
    spark.range(10).write.parquet(f"{tmpdir_run}/t")
    assert path_bytes(spark, f"{tmpdir_run}/t/*.parquet") > 0
    key, other = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(other)
    spark.conf.set(key, "64m")
    try:
        with scaled_conf(spark, [f"{tmpdir_run}/t"]) as applied:
            assert spark.conf.get(key) == "64m" and key not in applied and spark.conf.get(other) == "256m"
        assert spark.conf.get(other) == before and spark.conf.get(key) == "64m"
    finally:
        spark.conf.unset(key)
