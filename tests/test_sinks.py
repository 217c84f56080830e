"""Sinks (K1, K4, K5, K7, K8), optional sources (S5) and empty results."""

import json
import os

from pyspark.sql import functions as F

from terrascope.operators import aggregates as A
from terrascope.plans import reports as R
from terrascope.sources import sinks as K


def test_write_partitioned_and_prune(spark, tmpdir_run):
    df = spark.createDataFrame([(1, 1995, 1990), (2, 2003, 2000)], "id int, Year int, Decade int")
    K.write_table(df, f"{tmpdir_run}/t", partition_by=["Decade"])
    assert sorted(d for d in os.listdir(f"{tmpdir_run}/t") if d.startswith("Decade=")) == ["Decade=1990", "Decade=2000"]
    back = spark.read.parquet(f"{tmpdir_run}/t").filter("Decade = 2000")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and [r.id for r in back.collect()] == [2]


def test_metrics_long_and_model_info(spark, tmpdir_run):
    m = spark.createDataFrame([("linear_regression", 0, 0.01, 0.04, 0.99)],
                              "model string, train_order int, train_mse double, test_mse double, test_r2 double")
    long = {(r.metric, r.value) for r in K.metrics_long(m).collect()}
    assert ("test_r2", 0.99) in long and len(long) == 3
    info = K.model_info(m, "linear_regression", 54, 14)
    K.write_model_info(info, f"{tmpdir_run}/info")
    part = [f for f in os.listdir(f"{tmpdir_run}/info") if f.endswith(".json")][0]
    rec = json.loads(open(f"{tmpdir_run}/info/{part}").read())
    assert rec["best_model"] == "linear_regression" and abs(rec["test_rmse"] - 0.2) < 1e-12
    assert rec["training_samples"] == 54 and len(rec["training_date"]) == 19


def test_write_pixels_per_image(spark, tmpdir_run):
    px = spark.createDataFrame([(1, 0, 0, 5), (2, 0, 0, 6)], "image_id long, y int, x int, v int")
    K.write_pixels(px, f"{tmpdir_run}/px")
    assert not [d for d in os.listdir(f"{tmpdir_run}/px") if d.startswith("image_id=")]
    assert sorted(spark.read.parquet(f"{tmpdir_run}/px").collect()) == sorted(px.collect())


def test_observed_counts_without_extra_job(spark):
    own = spark.newSession()            # see the caveat in K.observed
    df = own.range(100)
    obs_df, obs = K.observed(df, "n", F.max("id").alias("max_id"))
    obs_df.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 100, "max_id": 99}
    assert K.counted(spark.range(100), F.max("id").alias("max_id")) == {"rows": 100, "max_id": 99}


def test_empty_match_gives_empty_report(spark):
    obs = spark.createDataFrame([("Chad", "2000-01-01", 2000, 1.0)], "Country string, dt string, Year int, AverageTemperature double")
    out = R.country_analysis(obs, "atlantis")
    assert out["annual_data"].count() == 0
    stats = out["stats"].first()
    assert stats.data_points == 0 and stats.avg_temperature is None and stats.temperature_trend == 0.0


def test_blank_pattern_means_top_k(spark):
    obs = spark.createDataFrame([("Chad", "2000-01-01", 1.0)], "Country string, dt string, AverageTemperature double")
    out = R.country_analysis(obs, "  ")
    assert set(out) == {"top_warming_countries", "total_countries"}


def test_approx_country_count(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("string").alias("Country"))
    assert A.country_count(df, approx=True).first().total_countries in range(36, 39)


def test_scale_conf_sizes_partitions(spark):
    from terrascope.session import apply_scale_conf, scale_conf
    c = scale_conf(100 * 1024 ** 4)                   # 100 TB
    assert c["spark.sql.shuffle.partitions"] == "409600"
    assert scale_conf(10 * 1024 ** 3)["spark.sql.shuffle.partitions"] == "200"
    assert scale_conf(200 * 1024 ** 3)["spark.sql.shuffle.partitions"] == "800"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    applied = apply_scale_conf(spark, ["/root/testdata/sf0.01"])
    assert "spark.sql.shuffle.partitions" not in applied   # set explicitly by the test session
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    for k, v in applied.items():
        spark.conf.unset(k)


def test_partitioned_write_is_rebalanced(spark, tmpdir_run):
    df = spark.range(20000).repartition(16).select((F.col("id") % 3 * 10 + 1990).cast("int").alias("Decade"), "id")
    K.write_table(df, f"{tmpdir_run}/rb", partition_by=["Decade"])
    files = [f for d in os.listdir(f"{tmpdir_run}/rb") if d.startswith("Decade=")
             for f in os.listdir(f"{tmpdir_run}/rb/{d}") if f.endswith(".parquet")]
    assert len(files) < 16 * 3          # not one file per upstream task and decade
    assert spark.read.parquet(f"{tmpdir_run}/rb").count() == 20000
