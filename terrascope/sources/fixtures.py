"""Fixtures F1-F3: climate-shaped and raster-shaped inputs derived from the
test tables by Spark itself, so their size grows with the scale factor.

F1  station observations  (orders x customer x nation, one row per order)
F1m country x month means (aggregate of F1)
F2  global monthly series (aggregate of F1)
F3  8x8 pixel grids, one image per embedding row
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascope.operators.joins import broadcast_if_small_files
from terrascope.sources.tables import read_table, table_path

# Fixed values of the fixtures (shared with the DuckDB oracle SQL).
MISSING_EVERY = 17          # 1 in 17 observations has no value
PRICE_TO_TEMP = 10007.0     # o_totalprice / 10007 -> a "temperature"; a prime divisor keeps
                            # means off exact decimal rounding ties
GRID = 8                    # F3 images are 8 x 8
GRID_CELLS = GRID * GRID    # one pixel per embedding dimension
NATION_MAX_BYTES = 16 * 1024 * 1024   # broadcast bound (files on disk) for the nation dimension


def station_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``obs_id, dt, AverageTemperature, Country, City``.

    orders (large) joins customer (large) on the customer key -- a shuffle
    join chosen by Catalyst/AQE from runtime sizes -- and nation through a
    broadcast checked against its size on disk (metadata only, no job).
    """
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nation = broadcast_if_small_files(read_table(spark, sf_dir, "nation", "n_nationkey", "n_name"),
                                      table_path(sf_dir, "nation"), NATION_MAX_BYTES)
    joined = (orders.join(customer, orders.o_custkey == customer.c_custkey)
              .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))
    return joined.select(
        F.col("o_orderkey").alias("obs_id"),
        F.col("o_orderdate").cast("date").alias("dt"),
        F.when(F.col("o_orderkey") % MISSING_EVERY != 0,
               F.col("o_totalprice") / F.lit(PRICE_TO_TEMP)).alias("AverageTemperature"),
        F.col("n_name").alias("Country"),
        F.concat(F.col("n_name"), F.lit("/"), F.col("c_mktsegment")).alias("City"),
    )


def country_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1m: ``Country, dt, AverageTemperature`` -- mean per country and month."""
    from terrascope.operators.series import monthly_series
    return monthly_series(station_observations(spark, sf_dir), "AverageTemperature", "Country")


def global_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dt, LandAverageTemperature`` -- one row per month (80 rows)."""
    from terrascope.operators.series import monthly_series
    return monthly_series(station_observations(spark, sf_dir), "AverageTemperature",
                          out="LandAverageTemperature")


def _channel(emb: Column, shift: int) -> Column:
    idx = (F.col("p") + F.lit(shift)) % F.lit(GRID_CELLS)
    v = F.floor(F.lit(128.0) + F.lit(240.0) * F.get(emb, idx).cast("double"))
    return F.least(F.lit(255), F.greatest(F.lit(0), v)).cast("int")


def pixel_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, grp, y, x, height, width, b, g, r`` -- 64 pixels per embedding row."""
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    exploded = emb.select("vec_id", "label", "embedding",
                          F.posexplode(F.col("embedding")).alias("p", "v"))
    e = F.col("embedding")
    return exploded.select(
        F.col("vec_id").alias("image_id"),
        F.col("label").alias("grp"),
        F.floor(F.col("p") / GRID).cast("int").alias("y"),
        (F.col("p") % GRID).cast("int").alias("x"),
        F.lit(GRID).alias("height"),
        F.lit(GRID).alias("width"),
        _channel(e, 0).alias("b"),
        _channel(e, 1).alias("g"),
        _channel(e, 2).alias("r"),
    )


def pixel_truth(pixels: DataFrame) -> DataFrame:
    """Ground-truth label of an F3 pixel: green dominates -> forest (1)."""
    return pixels.withColumn(
        "label", F.when(F.lit(2) * F.col("g") > F.col("b") + F.col("r"), 1).otherwise(0))


def image_names(pixels_or_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Image and mask file names for the pairing operators.

    Masks of every 50th image are left out so the unmatched check finds rows.
    """
    ids = pixels_or_ids.select("image_id").distinct()
    pad = F.lpad(F.col("image_id").cast("string"), 4, "0")
    images = ids.select(F.concat(F.lit("satellite_"), pad, F.lit(".jpg")).alias("image_name"))
    masks = (ids.filter(F.col("image_id") % 50 != 0)
             .select(F.concat(F.lit("mask_"), pad, F.lit(".jpg")).alias("mask_name")))
    return images, masks
