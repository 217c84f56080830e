"""A hot group (one image with > 90 % of all pixels, one country with most
rows) must not end up in one task."""

from pyspark.sql import functions as F

from terrascope.operators import aggregates as A
from terrascope.operators import raster as RA


def _pixels(spark):
    hot = spark.range(60 * 60).select(F.lit(0).cast("long").alias("image_id"),
                                      (F.col("id") / 60).cast("int").alias("y"), (F.col("id") % 60).cast("int").alias("x"),
                                      F.lit(60).alias("height"), F.lit(60).alias("width"))
    cold = spark.range(20 * 16).select((F.col("id") / 16 + 1).cast("long").alias("image_id"),
                                       ((F.col("id") % 16) / 4).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("x"),
                                       F.lit(4).alias("height"), F.lit(4).alias("width"))
    px = hot.unionByName(cold)
    return px.select("*", (F.col("x") * 3 % 256).alias("b"), (F.col("y") * 5 % 256).alias("g"),
                     ((F.col("x") + F.col("y")) % 256).alias("r"))


def _largest_share(df) -> float:
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_hot_image_spreads_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        px = _pixels(spark)
        assert px.filter("image_id = 0").count() / px.count() > 0.9
        for out in (RA.focal_stats(px), RA.smooth(px), RA.resize_bilinear(px, 8, 8),
                    RA.morph_close(px.withColumn("label", (F.col("g") > 100).cast("int")))):
            assert _largest_share(out) < 0.3
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_hot_country_is_combined_map_side(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("C"), (F.col("id") % 50).cast("string"))).alias("Country"),
        F.expr("date_add(date'2000-01-01', cast(id % 700 as int))").alias("dt"),
        (F.col("id") % 97 / 10.0).alias("AverageTemperature"))
    out = A.country_trends(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_regr_slope" in plan
    assert out.filter("country = 'HOT'").first().data_points == 6667
