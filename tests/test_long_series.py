"""Positional (window-free) series operators equal the window operators."""

from pyspark.sql import functions as F

from terrascope.operators import clean as C
from terrascope.operators import long_series as L
from terrascope.operators import series as S
from terrascope.sources import fixtures as FX
from tests.conftest import SF_MID


def _same(a, b, cols):
    ra = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in a.select(*cols).collect())
    rb = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in b.select(*cols).collect())
    assert ra == rb


FEATS = ["YearSinceStart", "MonthSin", "MonthCos", "TempChange_1Month", "TempChange_1Year"]


def test_keyed_series_equal(spark):
    monthly = C.clean(FX.country_monthly(spark, SF_MID), "AverageTemperature")
    a = S.add_features(monthly, "AverageTemperature", series_key="Country", prefix="Temp")
    b = L.positional_features(monthly, "AverageTemperature", series_key="Country", prefix="Temp")
    _same(a, b, ["Country", "dt", "AverageTemperature", "Temp_Lag1", "Temp_Lag12", "Temp_MA3", "Temp_MA12", *FEATS])


def test_global_series_equal(spark):
    g = C.clean(FX.global_series(spark, SF_MID), S.TARGET)
    _same(S.add_features(g), L.positional_features(g, S.TARGET),
          ["dt", S.TARGET, "LandTemp_Lag1", "LandTemp_Lag12", "LandTemp_MA3", "LandTemp_MA12", *FEATS])


def test_gap_rules(spark):
    rows = [(2000, m, v) for m, v in zip(range(1, 6), [0.0, 1.0, None, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "Year int, Month int, v double").withColumn("dt", F.make_date("Year", "Month", F.lit(1)))
    out = L.positional_features(df, "v", prefix="V").orderBy("Month").collect()
    assert [r.V_MA3 for r in out] == [None] * 5 and out[3].V_Lag1 is None and out[4].V_Lag1 == 3.0


def test_split_and_folds_equal(spark):
    g = C.clean(FX.global_series(spark, SF_MID), S.TARGET)
    a = S.time_split(g)
    b = L.positional_split(g, k=5)
    _same(a, b, ["dt", "rn", "is_train"])
    folds = S.kfold_assign(a.filter("is_train").drop("rn", "is_train"))
    _same(folds, b.filter("is_train"), ["dt", "fold"])


def test_positions_many_rows_per_month(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.lit(2000).alias("Year"),
                                  (F.col("id") % 12 + 1).cast("int").alias("Month"), F.col("id").alias("dt"))
    pos = L.positions(df, "k").collect()
    for key in range(3):
        rns = sorted(r.rn for r in pos if r.k == key)
        assert rns == list(range(1, len(rns) + 1))
