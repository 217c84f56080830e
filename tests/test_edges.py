"""Hand-computed edge rules (FIXTURES.md section 4)."""

import math

from pyspark.sql import functions as F

from terrascope.functions.numeric import climate_status, round_half_even, round_rint
from terrascope.operators import aggregates as A
from terrascope.operators import clean as C
from terrascope.operators import series as S
from terrascope.sources import climate_csv as CSV


def test_nan_and_null_dropped(spark, tmpdir_run):
    path = f"{tmpdir_run}/g.csv"
    with open(path, "w") as f:
        f.write("dt,LandAverageTemperature\n2000-01-01,1.5\n2000-02-01,\n2000-03-01,NaN\n2000-04-01,NA\n")
    df = CSV.read_global(spark, path)
    out = C.drop_missing(df, "LandAverageTemperature").collect()
    assert [r.LandAverageTemperature for r in out] == [1.5]


def test_csv_read_by_header_name(spark, tmpdir_run):
    path = f"{tmpdir_run}/c.csv"
    with open(path, "w") as f:
        f.write("dt,AverageTemperature,AverageTemperatureUncertainty,Country\n"
                "1899-12-01,1.0,0.1,Chad\n1900-01-01,,0.2,Chad\n1900-02-01,2.5,NA,Niger\nbad,3.0,0.3,Niger\n")
    df = CSV.read_country(spark, path)
    assert dict(df.dtypes) == {"dt": "date", "AverageTemperature": "double",
                               "AverageTemperatureUncertainty": "double", "Country": "string"}
    out = C.clean(df, "AverageTemperature").collect()
    assert [(str(r.dt), r.AverageTemperature, r.Country, r.Year, r.Month) for r in out] == \
        [("1900-02-01", 2.5, "Niger", 1900, 2)]


def test_missing_optional_table_is_none(spark, tmpdir_run):
    assert CSV.read_optional(spark, f"{tmpdir_run}/does_not_exist") is None


def test_moving_mean_with_gap(spark):
    rows = [(2000, m, v) for m, v in zip(range(1, 6), [0.0, 1.0, None, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "Year int, Month int, v double").withColumn(
        "dt", F.make_date("Year", "Month", F.lit(1)))
    out = df.select("Month", S.moving_mean("v", 3).alias("ma3"), S.row_lag("v", 1).alias("lag1")) \
        .orderBy("Month").collect()
    assert [r.ma3 for r in out] == [None] * 5
    assert out[3].lag1 is None          # row 4's previous row is the gap
    assert out[4].lag1 == 3.0


def test_moving_mean_full_window(spark):
    rows = [(2000, m, float(m)) for m in range(1, 5)]
    df = spark.createDataFrame(rows, "Year int, Month int, v double").withColumn(
        "dt", F.make_date("Year", "Month", F.lit(1)))
    out = df.select("Month", S.moving_mean("v", 3).alias("ma3")).orderBy("Month").collect()
    assert [r.ma3 for r in out] == [None, None, 2.0, 3.0]


def test_single_row_group_sample_std_is_null(spark):
    df = spark.createDataFrame([(1, 5.0, 0.1)], "Month int, LandAverageTemperature double, Temperature_Anomaly double")
    r = A.seasonal_profile(df).first()
    assert r.Temp_Std is None and r.Month_Name == "Jan"


def test_slope_one_year_only_is_null(spark):
    df = spark.createDataFrame([("X", "2000-01-01", 1.0), ("X", "2000-02-01", 3.0), ("X", "2000-03-01", 2.0),
                                ("X", "2000-04-01", 2.0), ("X", "2000-05-01", 2.0), ("X", "2000-06-01", 2.0)],
                               "Country string, dt string, AverageTemperature double")
    df = C.parse_dates(df)
    r = A.country_trends(df).first()
    assert r.trend is None and r.data_points == 6


def test_slope_single_annual_row_is_zero(spark):
    df = spark.createDataFrame([(2000, 1.0)], "Year int, LandAverageTemperature double")
    assert A.recent_slope(df).first().temperature_change_rate == 0.0


def test_slope_matches_least_squares(spark):
    ys = [(1990 + i, 0.5 * i + (1 if i % 2 else -1)) for i in range(10)]
    df = spark.createDataFrame(ys, "Year int, LandAverageTemperature double")
    n = len(ys)
    mx = sum(y for y, _ in ys) / n
    my = sum(v for _, v in ys) / n
    exp = sum((x - mx) * (v - my) for x, v in ys) / sum((x - mx) ** 2 for x, _ in ys)
    got = A.recent_slope(df).first().temperature_change_rate
    assert math.isclose(got, exp, rel_tol=1e-12)


def test_rounding_rules(spark):
    df = spark.createDataFrame([(2.675,), (0.125,)], "v double")
    r = df.select(round_rint("v", 2).alias("rint"), round_half_even("v", 2).alias("even")).collect()
    assert [x.rint for x in r] == [2.68, 0.12]
    assert r[1].even == 0.12


def test_country_pattern(spark):
    df = spark.createDataFrame([("Niger",), ("NIGERIA",), (None,), ("Chad",)], "Country string")
    out = sorted(r.Country for r in C.match_rows(df, "Country", "niger").collect())
    assert out == ["NIGERIA", "Niger"]


def test_status_bands(spark):
    rates = [0.25, 0.2, 0.15, 0.1, 0.05, 0.0, -1.0]
    df = spark.createDataFrame([(r,) for r in rates], "rate double")
    s, c = climate_status("rate")
    out = [(r.s, r.c) for r in df.select(s.alias("s"), c.alias("c")).collect()]
    assert [o[0] for o in out] == ["Rapid Warming", "Moderate Warming", "Moderate Warming", "Slight Warming",
                                   "Slight Warming", "Stable/Cooling", "Stable/Cooling"]
    assert out[0][1] == "danger" and out[-1][1] == "success"


def test_horizon_clamp(spark):
    assert [C.clamp_years(v) for v in (0, 5, 11, "abc", None, 3.5)] == [1, 5, 10, 5, 5, 5]
    df = spark.createDataFrame([("0",), ("5",), ("11",), ("x",)], "n string")
    assert [r.y for r in df.select(C.clamp_years(F.col("n")).alias("y")).collect()] == [1, 5, 10, 5]


def test_country_count_counts_null_once(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), (None,), ("a",)], "Country string")
    assert A.country_count(df).first().total_countries == 3


def test_extreme_months_first_on_ties(spark):
    rows = [(m, 10.0 if m in (3, 7) else 1.0, 0.0) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "Month int, LandAverageTemperature double, Temperature_Anomaly double")
    r = A.extreme_months(A.seasonal_profile(df)).first()
    assert r.hottest_month == "Mar" and r.coldest_month == "Jan"


def test_year_cutoff_is_pushed_down(spark, tmpdir_run):
    path = f"{tmpdir_run}/obs"
    spark.createDataFrame([("1899-12-01", 1.0), ("1900-01-01", 2.0)], "dt string, v double") \
        .select(F.to_date("dt").alias("dt"), "v").write.parquet(path)
    df = C.year_cutoff(spark.read.parquet(path), 1900)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(dt" in plan
    assert [r.v for r in df.collect()] == [2.0]
