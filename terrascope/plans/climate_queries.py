"""Registered climate queries: ``(spark, sf_dir) -> DataFrame``.

Inputs are the fixtures F1 / F1m / F2 derived from the test tables, so every
query's work grows with the scale factor.  Floating outputs are rounded to
6 digits (the report format; the oracle SQL rounds alike).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrascope.functions.numeric import climate_status, round_exact
from terrascope.operators import aggregates as A
from terrascope.operators import clean as C
from terrascope.operators import series as S
from terrascope.operators.joins import scalars
from terrascope.plans import climate_model as M
from terrascope.plans import reports as R
from terrascope.plans.climate_features import build_features, feature_projection
from terrascope.plans.common import rounded
from terrascope.session import materialize, scratch_path
from terrascope.sources import fixtures as FX
from terrascope.sources import climate_csv as CSV

COUNTRY_PATTERN = "nation_1"  # case-insensitive partial match: NATION_1 and NATION_10..19 pooled


def _obs(spark, sf):
    """F1 cleaned (P1-P4) -- the country/city observation table."""
    return C.clean(FX.station_observations(spark, sf), "AverageTemperature")


def _features(spark, sf):
    return build_features(FX.global_series(spark, sf))


def _predictions(spark, sf):
    """Linear model (trained once per context and folder) and its predictions
    table, written once for the several reads of a report."""
    from terrascope.plans.model_cache import cached_model
    features = _features(spark, sf)
    model = cached_model(spark, sf, "linear_regression",
                         lambda: M.linear_predictions(spark, features)[0])
    return model, materialize(M.predictions_dataset(model, features), "predictions")


# --- sources / sinks -------------------------------------------------------

def q_scan_global(spark, sf):
    path = scratch_path(spark, f"csv_global_{uuid.uuid4().hex}")
    FX.global_series(spark, sf).write.mode("overwrite").option("header", True).csv(path)
    return rounded(CSV.read_global(spark, path).select("dt", "LandAverageTemperature"))


def q_scan_country(spark, sf):
    path = scratch_path(spark, f"csv_country_{uuid.uuid4().hex}")
    FX.country_monthly(spark, sf).write.mode("overwrite").option("header", True).csv(path)
    return rounded(CSV.read_country(spark, path).select("Country", "dt", "AverageTemperature"))


def q_scan_city(spark, sf):
    path = scratch_path(spark, f"csv_city_{uuid.uuid4().hex}")
    FX.station_observations(spark, sf).write.mode("overwrite").option("header", True).csv(path)
    return rounded(CSV.read_city(spark, path))


def q_write_read_roundtrip(spark, sf):
    from terrascope.sources.sinks import write_table
    path = scratch_path(spark, f"roundtrip_{uuid.uuid4().hex}")
    obs = _obs(spark, sf).withColumn("Decade", F.floor(F.col("Year") / 10).cast("int") * 10)
    write_table(obs, path, partition_by=["Decade"])
    return rounded(spark.read.parquet(path).select("obs_id", "dt", "AverageTemperature", "Country",
                                                   "City", "Year", "Month", "Decade"))


def q_reload_predictions(spark, sf):
    from terrascope.sources.sinks import write_table
    _, pred = _predictions(spark, sf)
    path = scratch_path(spark, f"predictions_{uuid.uuid4().hex}")
    write_table(pred, path)
    return rounded(spark.read.parquet(path))


# --- cleaning / projections ------------------------------------------------

def q_drop_missing(spark, sf):
    return rounded(C.drop_missing(FX.station_observations(spark, sf), "AverageTemperature"))


def q_parse_dates(spark, sf):
    txt = FX.station_observations(spark, sf).select("obs_id", F.date_format("dt", "yyyy-MM-dd").alias("dt"))
    return C.parse_dates(txt)


def q_calendar_parts(spark, sf):
    return C.calendar_parts(FX.station_observations(spark, sf).select("obs_id", "dt"))


def q_year_cutoff(spark, sf):
    # cut at 1998 so the filter removes rows of the 1995-2001 fixture
    return rounded(C.year_cutoff(FX.station_observations(spark, sf), 1998))


def q_features_complete(spark, sf):
    return rounded(_features(spark, sf))


def q_feature_projection(spark, sf):
    return rounded(feature_projection(_features(spark, sf)))


def q_climate_features(spark, sf):
    return rounded(_features(spark, sf))


def q_country_match(spark, sf):
    return C.match_rows(_obs(spark, sf), "Country", COUNTRY_PATTERN).select("obs_id", "Country")


def q_clamp_years(spark, sf):
    cust = FX.read_table(spark, sf, "customer", "c_custkey", "c_nationkey")
    return cust.select("c_custkey", C.clamp_years(F.col("c_nationkey") - 5).alias("years"))


# --- windows -----------------------------------------------------------------

def _clean_global(spark, sf):
    return C.clean(FX.global_series(spark, sf), S.TARGET)


def q_lag_features(spark, sf):
    g = _clean_global(spark, sf)
    return rounded(g.select("dt", S.TARGET, S.row_lag(S.TARGET, 1).alias("LandTemp_Lag1"),
                            S.row_lag(S.TARGET, 12).alias("LandTemp_Lag12")))


def q_lag_calendar(spark, sf):
    monthly = C.clean(FX.country_monthly(spark, sf), "AverageTemperature")
    out = S.calendar_lag(monthly, "AverageTemperature", 12, series_key="Country", out="Temp_CalLag12")
    return rounded(out.select("Country", "dt", "AverageTemperature", "Temp_CalLag12"))


def q_moving_averages(spark, sf):
    g = _clean_global(spark, sf)
    return rounded(g.select("dt", S.moving_mean(S.TARGET, 3).alias("LandTemp_MA3"),
                            S.moving_mean(S.TARGET, 12).alias("LandTemp_MA12")))


def q_temp_changes(spark, sf):
    f = S.add_features(_clean_global(spark, sf))
    return rounded(f.select("dt", "TempChange_1Month", "TempChange_1Year"))


def q_country_lags(spark, sf):
    """W1-W5 per series key: features of every country's monthly series."""
    monthly = C.clean(FX.country_monthly(spark, sf), "AverageTemperature")
    f = S.add_features(monthly, "AverageTemperature", series_key="Country", prefix="Temp")
    return rounded(f.select("Country", "dt", "YearSinceStart", "Temp_Lag1", "Temp_Lag12", "Temp_MA3",
                            "Temp_MA12", "TempChange_1Month", "TempChange_1Year"))


def q_country_lags_positional(spark, sf):
    """W1-W5 per country with the window-free positional operators (long
    series form); same result as ``country_lags``."""
    from terrascope.operators.long_series import positional_features
    monthly = C.clean(FX.country_monthly(spark, sf), "AverageTemperature")
    f = positional_features(monthly, "AverageTemperature", series_key="Country", prefix="Temp")
    return rounded(f.select("Country", "dt", "YearSinceStart", "Temp_Lag1", "Temp_Lag12", "Temp_MA3",
                            "Temp_MA12", "TempChange_1Month", "TempChange_1Year"))


def q_time_split(spark, sf):
    return S.time_split(_features(spark, sf)).select("dt", "rn", "is_train")


def q_kfold_assign(spark, sf):
    train = S.time_split(_features(spark, sf)).filter("is_train").drop("rn", "is_train")
    return S.kfold_assign(train).select("dt", "fold")


def q_month_cycle(spark, sf):
    sin_m, cos_m = S.month_cycle()
    return rounded(_clean_global(spark, sf).select("dt", sin_m.alias("MonthSin"), cos_m.alias("MonthCos")))


def q_years_since_start(spark, sf):
    g = _clean_global(spark, sf)
    return g.select("dt", S.years_since_start(g).alias("YearSinceStart"))


def q_last_observation(spark, sf):
    return rounded(S.last_observation(_features(spark, sf)).select("Year", "Month", S.TARGET))


# --- aggregates / reports ---------------------------------------------------

def q_country_top_warming(spark, sf):
    return rounded(A.top_warming(A.country_trends(_obs(spark, sf))))


def q_country_count(spark, sf):
    # over the cleaned country table, as the original counts its processed data
    return A.country_count(_obs(spark, sf))


def q_country_annual(spark, sf):
    return rounded(A.country_annual(_obs(spark, sf), COUNTRY_PATTERN))


def q_country_stats(spark, sf):
    return rounded(A.country_stats(_obs(spark, sf), COUNTRY_PATTERN))


def q_country_profile(spark, sf):
    out = R.country_analysis(_obs(spark, sf), COUNTRY_PATTERN)
    return rounded(out["stats"])


def q_climate_status(spark, sf):
    t = A.country_trends(_obs(spark, sf))
    status, colour = climate_status(F.col("trend") * 10)
    return t.select("country", status.alias("climate_status"), colour.alias("status_color"))


def q_annual_trend(spark, sf):
    _, pred = _predictions(spark, sf)
    return rounded(A.annual_means(pred))


def q_decade_trend(spark, sf):
    _, pred = _predictions(spark, sf)
    return rounded(A.decade_means(pred))


def q_recent_trend(spark, sf):
    _, pred = _predictions(spark, sf)
    return rounded(A.recent_window(A.annual_means(pred)))


def q_recent_slope(spark, sf):
    _, pred = _predictions(spark, sf)
    return rounded(A.recent_slope(A.annual_means(pred)))


def q_annual_extremes(spark, sf):
    _, pred = _predictions(spark, sf)
    return rounded(A.annual_extremes(A.annual_means(pred)))


def q_seasonal(spark, sf):
    _, pred = _predictions(spark, sf)
    return rounded(R.seasonal(pred))


def q_extreme_months(spark, sf):
    _, pred = _predictions(spark, sf)
    return A.extreme_months(A.seasonal_profile(pred))


def q_anomaly(spark, sf):
    f = _features(spark, sf)
    from terrascope.operators.joins import scalar
    return rounded(f.select("dt", (F.col(S.TARGET) - scalar(f, F.avg(S.TARGET))).alias("Temperature_Anomaly")))


def q_global_trends(spark, sf):
    _, pred = _predictions(spark, sf)
    t = R.global_trends(pred)
    rate = t["temperature_change_rate"].select("temperature_change_rate").scalar()
    return rounded(t["extremes"].select(rate.alias("temperature_change_rate"), "current_anomaly",
                                        "max_temperature", "min_temperature", "data_years"))


def q_climate_summary(spark, sf):
    model, pred = _predictions(spark, sf)
    fc = M.forecast(model, pred, 5)
    return R.climate_summary(pred, fc, with_timestamp=False)    # the clock is not oracle-checked


# --- models ----------------------------------------------------------------

def q_standardize(spark, sf):
    split = S.time_split(_features(spark, sf))
    train = split.filter("is_train")
    return rounded(M.standardize(train, split).select("dt", *S.FEATURES))


def q_linear_regression(spark, sf):
    _, pred = M.linear_predictions(spark, _features(spark, sf))     # fit measured here
    return rounded(pred.select("dt", S.TARGET, "Predicted_Temperature"))


def q_predictions_dataset(spark, sf):
    from terrascope.plans.model_cache import cached_model
    features = _features(spark, sf)
    model = cached_model(spark, sf, "linear_regression", lambda: M.linear_predictions(spark, features)[0])
    return rounded(M.predictions_dataset(model, features))


def q_regression_metrics(spark, sf):
    """M5 on a fixed prediction: last month's value (lag 1) predicts the
    value, per split."""
    split = S.time_split(_features(spark, sf)).withColumn("prediction", F.col("LandTemp_Lag1"))
    tr = M.regression_metrics(split.filter("is_train"), prefix="train_")
    te = M.regression_metrics(split.filter(~F.col("is_train")), prefix="test_")
    test_vals = scalars(te, **{c: F.first(c) for c in te.columns})
    return rounded(tr.select("*", *[v.alias(k) for k, v in test_vals.items()]))


def q_forecast_grid(spark, sf):
    _, pred = _predictions(spark, sf)
    return rounded(M.forecast_grid(pred, 5))


def q_forecast(spark, sf):
    model, pred = _predictions(spark, sf)
    return rounded(M.forecast(model, pred, 5))


#: The one predictor of the closed-form keys: it is known before the month it predicts.
LAGGED = ["LandTemp_Lag12"]
LAGGED_BOTH = ["LandTemp_Lag1", "LandTemp_Lag12"]


def q_linear_closed_form(spark, sf):
    """M4 on last year's value alone, fitted on the training part and applied to
    every row: simple regression, which SQL has in closed form."""
    split = S.time_split(_features(spark, sf))
    m = M.fit(split.filter("is_train"), "linear_regression", features=LAGGED)
    return rounded(M.score(m, split).select("dt", "is_train", S.TARGET, F.col("prediction").alias("predicted")))


def q_cv_closed_form(spark, sf):
    """M6 of the same model: R^2 of each fold."""
    train = S.time_split(_features(spark, sf)).filter("is_train").drop("rn", "is_train")
    return rounded(M.cv_scores(train, "linear_regression", features=LAGGED))


def _two_predictors(spark, sf):
    """Linear model on last month's and last year's value, fitted on the training part."""
    features = _features(spark, sf)
    return M.fit(S.time_split(features).filter("is_train"), "linear_regression", features=LAGGED_BOTH), features


def q_predictions_closed_form(spark, sf):
    """M8 (J3, F4s) of a model that does not hold the target: two predictors, which
    SQL solves by normal equations."""
    pred = M.predictions_dataset(*_two_predictors(spark, sf))
    return rounded(pred.select("dt", S.TARGET, "Predicted_Temperature", "Temperature_Difference", "Decade", "Temperature_Anomaly"))


def q_forecast_closed_form(spark, sf):
    """M9 / Q4 of the same model."""
    model, features = _two_predictors(spark, sf)
    return rounded(M.forecast(model, M.predictions_dataset(model, features), 5))


def q_best_closed_form(spark, sf):
    """The best of two one-predictor models by test R^2."""
    split = S.time_split(_features(spark, sf)).cache()
    train, test = split.filter("is_train"), split.filter("not is_train")
    rows = [(f, i, M.regression_metrics(M.score(M.fit(train, "linear_regression", features=[f]), test)).first().r2)
            for i, f in enumerate(LAGGED_BOTH)]
    return rounded(M.best_model(spark.createDataFrame(rows, "model string, train_order int, test_r2 double")))


def q_one_year_trends(spark, sf):
    """Slopes of least norm where all rows of a country share a year."""
    one = _obs(spark, sf).filter(F.col("Year") == 1997)
    return rounded(A.top_warming(A.country_trends(one, since=1997, least_norm=True)))


def q_round_exact(spark, sf):
    """F6s: Python's rounding on values with exact and near ties."""
    li = FX.read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    eighth, price = F.col("l_quantity").cast("double") / 8.0, F.col("l_extendedprice").cast("double") / 1000.0
    return li.select("l_orderkey", "l_linenumber", round_exact(eighth, 2).alias("eighth"), round_exact(price, 4).alias("price"),
                     round_exact(-eighth, 1).alias("negative"))


# Rows-only keys (MLlib trees: no SQL oracle), at the original's settings.

def q_rf_regression(spark, sf):
    f = _features(spark, sf)
    train = S.time_split(f).filter("is_train")
    m = M.fit(train, "random_forest")
    return M.score(m, f).select("dt", S.TARGET, "prediction")


def q_gbt_regression(spark, sf):
    f = _features(spark, sf)
    train = S.time_split(f).filter("is_train")
    m = M.fit(train, "gradient_boosting")
    return M.score(m, f).select("dt", S.TARGET, "prediction")


def q_cv_scores(spark, sf):
    train = S.time_split(_features(spark, sf)).filter("is_train").drop("rn", "is_train")
    return M.cv_scores(train, "linear_regression")


def _metrics(spark, sf):
    """All three models at the original's settings with five folds, trained once
    per context and folder."""
    from terrascope.plans.model_cache import cached_model
    return cached_model(spark, sf, "train_and_select",
                        lambda: M.train_and_select(_features(spark, sf), cv_folds=5)[1])


def q_metrics_table(spark, sf):
    return _metrics(spark, sf)


def q_best_model(spark, sf):
    return M.best_model(_metrics(spark, sf)).select("model", "train_order")


def q_report_json(spark, sf):
    """Reports as JSON records (one row per report, records in Year order)."""
    _, pred = _predictions(spark, sf)
    t = R.global_trends(pred)
    annual = rounded(t["annual_data"])
    packed = annual.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*annual.columns)))).alias("report_json"))
    return packed.select(F.lit("annual_data").alias("report"), "report_json")


QUERIES = {
    "scan_global": q_scan_global,
    "scan_country": q_scan_country,
    "scan_city": q_scan_city,
    "write_read_roundtrip": q_write_read_roundtrip,
    "reload_predictions": q_reload_predictions,
    "drop_missing": q_drop_missing,
    "parse_dates": q_parse_dates,
    "calendar_parts": q_calendar_parts,
    "year_cutoff": q_year_cutoff,
    "features_complete": q_features_complete,
    "feature_projection": q_feature_projection,
    "climate_features": q_climate_features,
    "country_match": q_country_match,
    "clamp_years": q_clamp_years,
    "lag_features": q_lag_features,
    "lag_calendar": q_lag_calendar,
    "moving_averages": q_moving_averages,
    "temp_changes": q_temp_changes,
    "country_lags": q_country_lags,
    "country_lags_positional": q_country_lags_positional,
    "time_split": q_time_split,
    "kfold_assign": q_kfold_assign,
    "month_cycle": q_month_cycle,
    "years_since_start": q_years_since_start,
    "last_observation": q_last_observation,
    "country_top_warming": q_country_top_warming,
    "country_count": q_country_count,
    "country_annual": q_country_annual,
    "country_stats": q_country_stats,
    "country_profile": q_country_profile,
    "climate_status": q_climate_status,
    "annual_trend": q_annual_trend,
    "decade_trend": q_decade_trend,
    "recent_trend": q_recent_trend,
    "recent_slope": q_recent_slope,
    "annual_extremes": q_annual_extremes,
    "seasonal": q_seasonal,
    "extreme_months": q_extreme_months,
    "anomaly": q_anomaly,
    "global_trends": q_global_trends,
    "climate_summary": q_climate_summary,
    "standardize": q_standardize,
    "linear_regression": q_linear_regression,
    "predictions_dataset": q_predictions_dataset,
    "regression_metrics": q_regression_metrics,
    "forecast_grid": q_forecast_grid,
    "forecast": q_forecast,
    "linear_closed_form": q_linear_closed_form,
    "cv_closed_form": q_cv_closed_form,
    "predictions_closed_form": q_predictions_closed_form,
    "forecast_closed_form": q_forecast_closed_form,
    "best_closed_form": q_best_closed_form,
    "one_year_trends": q_one_year_trends,
    "round_exact": q_round_exact,
    "rf_regression": q_rf_regression,
    "gbt_regression": q_gbt_regression,
    "cv_scores": q_cv_scores,
    "metrics_table": q_metrics_table,
    "best_model": q_best_model,
    "report_json": q_report_json,
}
