"""DuckDB oracle SQL for the climate keys (tables are pre-registered views).

Each statement recomputes the key from the raw tables with plain SQL, so it
checks the Spark plan end to end.  Floating outputs are rounded as on the
Spark side (6 digits; model outputs reproduce the target to ~1e-13, so the
oracle uses the target itself there).
"""

from __future__ import annotations


def rnd(sql: str, cols6=(), cols_model=()) -> str:
    """Wrap ``sql`` rounding the listed columns like ``plans.common.rounded``
    (``cols_model``: fitted-model outputs, replaced here by the target they
    reproduce; same 6 digits)."""
    parts = [f"round({c}, 6) + 0.0 AS {c}" for c in (*cols6, *cols_model)]
    if not parts:
        return sql
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql}) q"


F1 = """
SELECT o_orderkey AS obs_id, CAST(o_orderdate AS DATE) AS dt,
       CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice / 10007.0 END AS AverageTemperature,
       n_name AS Country, concat(n_name, '/', c_mktsegment) AS City
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

OBS = f"""
SELECT *, CAST(year(dt) AS INTEGER) AS Year, CAST(month(dt) AS INTEGER) AS Month
FROM ({F1}) f1
WHERE AverageTemperature IS NOT NULL AND NOT isnan(AverageTemperature) AND dt >= DATE '1900-01-01'
"""

F1M = f"""
SELECT Country, CAST(date_trunc('month', dt) AS DATE) AS dt, avg(AverageTemperature) AS AverageTemperature
FROM ({F1}) f1 GROUP BY 1, 2
"""

F2 = f"""
SELECT CAST(date_trunc('month', dt) AS DATE) AS dt, avg(AverageTemperature) AS LandAverageTemperature
FROM ({F1}) f1 GROUP BY 1
"""

CLEAN_G = f"""
SELECT dt, LandAverageTemperature, CAST(year(dt) AS INTEGER) AS Year, CAST(month(dt) AS INTEGER) AS Month
FROM ({F2}) f2
WHERE LandAverageTemperature IS NOT NULL AND NOT isnan(LandAverageTemperature) AND dt >= DATE '1900-01-01'
"""

FEAT_ALL = f"""
SELECT dt, LandAverageTemperature, Year, Month,
       Year - (SELECT min(Year) FROM ({CLEAN_G}) m) AS YearSinceStart,
       sin(2.0 * pi() * Month / 12.0) AS MonthSin,
       cos(2.0 * pi() * Month / 12.0) AS MonthCos,
       lag(LandAverageTemperature, 1) OVER w AS LandTemp_Lag1,
       lag(LandAverageTemperature, 12) OVER w AS LandTemp_Lag12,
       CASE WHEN count(LandAverageTemperature) OVER w3 = 3 THEN avg(LandAverageTemperature) OVER w3 END AS LandTemp_MA3,
       CASE WHEN count(LandAverageTemperature) OVER w12 = 12 THEN avg(LandAverageTemperature) OVER w12 END AS LandTemp_MA12,
       LandAverageTemperature - lag(LandAverageTemperature, 1) OVER w AS TempChange_1Month,
       LandAverageTemperature - lag(LandAverageTemperature, 12) OVER w AS TempChange_1Year
FROM ({CLEAN_G}) g
WINDOW w AS (ORDER BY Year, Month, dt),
       w3 AS (ORDER BY Year, Month, dt ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
       w12 AS (ORDER BY Year, Month, dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
"""

FEATURES = ["YearSinceStart", "MonthSin", "MonthCos", "LandTemp_Lag1", "LandTemp_Lag12",
            "LandTemp_MA3", "LandTemp_MA12", "TempChange_1Month", "TempChange_1Year"]
FEAT_DOUBLES = ["LandAverageTemperature"] + FEATURES[1:]

_ALL_COLS = ["dt", "LandAverageTemperature", "Year", "Month"] + FEATURES
FEAT = f"""
SELECT * FROM ({FEAT_ALL}) fa
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _ALL_COLS)}
"""

SPLIT = f"""
SELECT *, row_number() OVER (ORDER BY Year, Month, dt) AS rn,
       row_number() OVER (ORDER BY Year, Month, dt) <= count(*) OVER () - ceil(0.2 * count(*) OVER ()) AS is_train
FROM ({FEAT}) f
"""

PRED = f"""
SELECT *, LandAverageTemperature AS Predicted_Temperature, 0.0::DOUBLE AS Temperature_Difference,
       CAST(floor(Year / 10) * 10 AS INTEGER) AS Decade,
       LandAverageTemperature - (SELECT avg(LandAverageTemperature) FROM ({FEAT}) a) AS Temperature_Anomaly
FROM ({FEAT}) f
"""

ANNUAL = f"""
SELECT Year, avg(LandAverageTemperature) AS LandAverageTemperature,
       avg(Predicted_Temperature) AS Predicted_Temperature, avg(Temperature_Anomaly) AS Temperature_Anomaly
FROM ({PRED}) p GROUP BY Year
"""

RECENT = f"""
SELECT * FROM ({ANNUAL}) a WHERE Year >= (SELECT max(Year) FROM ({ANNUAL}) b) - 30
"""

def slope_sql(y: str, x: str) -> str:
    """Least-squares slope, NULL when ``x`` has no spread (DuckDB's own
    regr_slope yields NaN there; Spark yields NULL)."""
    return f"CASE WHEN var_pop({x}) > 0 THEN regr_slope({y}, {x}) END"


SLOPE = (f"SELECT coalesce({slope_sql('LandAverageTemperature', 'CAST(Year AS DOUBLE)')}, 0.0) "
         f"AS temperature_change_rate FROM ({RECENT}) r")

EXTREMES = f"""
SELECT max(LandAverageTemperature) AS max_temperature, min(LandAverageTemperature) AS min_temperature,
       arg_max(Temperature_Anomaly, Year) AS current_anomaly, count(*) AS data_years
FROM ({ANNUAL}) a
"""

MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"

SEASONAL = f"""
SELECT Month, avg(LandAverageTemperature) AS Avg_Temperature, stddev_samp(LandAverageTemperature) AS Temp_Std,
       avg(Temperature_Anomaly) AS Avg_Anomaly, {MONTHS}[Month] AS Month_Name
FROM ({PRED}) p GROUP BY Month
"""

EXTREME_MONTHS = f"""
SELECT (SELECT Month_Name FROM ({SEASONAL}) s ORDER BY Avg_Temperature DESC, Month LIMIT 1) AS hottest_month,
       (SELECT Month_Name FROM ({SEASONAL}) s ORDER BY Avg_Temperature ASC, Month LIMIT 1) AS coldest_month
"""

TRENDS = f"""
SELECT Country AS country, {slope_sql('AverageTemperature', 'CAST(year(dt) AS DOUBLE)')} AS trend,
       avg(AverageTemperature) AS avg_temp, count(*) AS data_points
FROM ({OBS}) o WHERE Country IS NOT NULL AND dt >= DATE '2000-01-01'
GROUP BY Country HAVING count(*) > 5
"""

PATTERN = "nation_1"
MATCHED = f"SELECT * FROM ({OBS}) o WHERE coalesce(regexp_matches(Country, '(?i){PATTERN}'), false)"

COUNTRY_STATS = f"""
SELECT '{PATTERN}' AS country_name, avg(AverageTemperature) AS avg_temperature, count(*) AS data_points,
       (SELECT coalesce({slope_sql('a', 'CAST(Year AS DOUBLE)')}, 0.0)
        FROM (SELECT Year, avg(AverageTemperature) AS a FROM ({MATCHED}) m GROUP BY Year) y) AS temperature_trend
FROM ({MATCHED}) m
"""


def _status(rate: str) -> tuple[str, str]:
    s = (f"CASE WHEN {rate} > 0.2 THEN 'Rapid Warming' WHEN {rate} > 0.1 THEN 'Moderate Warming' "
         f"WHEN {rate} > 0 THEN 'Slight Warming' ELSE 'Stable/Cooling' END")
    c = (f"CASE WHEN {rate} > 0.2 THEN 'danger' WHEN {rate} > 0.1 THEN 'warning' "
         f"WHEN {rate} > 0 THEN 'info' ELSE 'success' END")
    return s, c


_ST, _SC = _status("rate")

SUMMARY = f"""
SELECT {_ST} AS climate_status, {_SC} AS status_color,
       round_even(rate, 3) AS warming_rate_per_decade,
       round_even(coalesce(current_anomaly, 0.0), 2) AS current_anomaly,
       round_even(coalesce(max_temperature, 0.0), 2) AS max_temperature,
       round_even(coalesce(min_temperature, 0.0), 2) AS min_temperature,
       hottest_month, coldest_month, data_years, true AS future_predictions_available
FROM (SELECT (SELECT temperature_change_rate FROM ({SLOPE}) s) * 10 AS rate, * FROM ({EXTREMES}) e) x,
     ({EXTREME_MONTHS}) m
"""

_TS, _TC = _status("trend * 10")

FORECAST_GRID = f"""
WITH last AS (SELECT Year AS last_year, LandAverageTemperature AS last_v FROM ({PRED}) p
              ORDER BY Year DESC, Month DESC LIMIT 1),
     g AS (SELECT last_year + o AS year, CAST(m AS INTEGER) AS month, last_v
           FROM last, range(1, 6) t(o), range(1, 13) u(m))
SELECT CAST(year AS INTEGER) AS year, month, strftime(make_date(CAST(year AS INTEGER), month, 1), '%Y-%m-%d') AS date,
       CAST(year - (SELECT min(Year) FROM ({PRED}) p) AS INTEGER) AS YearSinceStart,
       sin(2.0 * pi() * month / 12.0) AS MonthSin, cos(2.0 * pi() * month / 12.0) AS MonthCos,
       last_v AS LandTemp_Lag1, last_v AS LandTemp_Lag12, last_v AS LandTemp_MA3, last_v AS LandTemp_MA12,
       0.0::DOUBLE AS TempChange_1Month, 0.0::DOUBLE AS TempChange_1Year
FROM g
"""


PRED_COLS6 = FEAT_DOUBLES + ["Temperature_Anomaly"]

# Simple regression of the value on last year's value, fitted on the training part.
CLOSED = f"""
SELECT s.dt, s.is_train, s.LandAverageTemperature, c.i + c.k * s.LandTemp_Lag12 AS predicted
FROM ({SPLIT}) s, (SELECT regr_slope(LandAverageTemperature, LandTemp_Lag12) AS k,
                          regr_intercept(LandAverageTemperature, LandTemp_Lag12) AS i FROM ({SPLIT}) t WHERE is_train) c
"""

# The same per contiguous fold of the training part: fit on the others, R^2 on the fold.
CLOSED_CV = f"""
WITH t AS (SELECT LandAverageTemperature AS y, LandTemp_Lag12 AS x,
                  CAST(ntile(5) OVER (ORDER BY Year, Month, dt) - 1 AS INTEGER) AS part FROM ({SPLIT}) s WHERE is_train),
c AS (SELECT f.part AS fold, regr_slope(t.y, t.x) AS k, regr_intercept(t.y, t.x) AS i
      FROM (SELECT DISTINCT part FROM t) f JOIN t ON t.part <> f.part GROUP BY f.part)
SELECT c.fold, 1.0 - avg((y - i - k * x) * (y - i - k * x)) / var_pop(y) AS r2 FROM c JOIN t ON t.part = c.fold GROUP BY c.fold
"""

# Normal equations of two predictors, on centred sums of the training part.
TWO = f"""
SELECT my - k1 * m1 - k2 * m2 AS i, k1, k2 FROM (
  SELECT my, m1, m2, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS k1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS k2
  FROM (SELECT avg(y) AS my, avg(a) AS m1, avg(b) AS m2, covar_pop(y, a) AS c1, covar_pop(y, b) AS c2, covar_pop(a, b) AS c12,
               var_pop(a) AS v1, var_pop(b) AS v2
        FROM (SELECT LandAverageTemperature AS y, LandTemp_Lag1 AS a, LandTemp_Lag12 AS b FROM ({SPLIT}) s WHERE is_train) t) u) w
"""

TWO_PRED = f"""
SELECT dt, LandAverageTemperature, p AS Predicted_Temperature, p - LandAverageTemperature AS Temperature_Difference,
       CAST(floor(Year / 10) * 10 AS INTEGER) AS Decade,
       LandAverageTemperature - (SELECT avg(LandAverageTemperature) FROM ({FEAT}) a) AS Temperature_Anomaly
FROM (SELECT f.*, c.i + c.k1 * f.LandTemp_Lag1 + c.k2 * f.LandTemp_Lag12 AS p FROM ({FEAT}) f, ({TWO}) c) q
"""

BEST_ONE = " UNION ALL ".join(f"""
SELECT '{x}' AS model, {order} AS train_order,
       1.0 - avg((y - i - k * x) * (y - i - k * x)) / var_pop(y) AS test_r2
FROM (SELECT LandAverageTemperature AS y, {x} AS x FROM ({SPLIT}) s WHERE NOT is_train) t,
     (SELECT regr_slope(LandAverageTemperature, {x}) AS k, regr_intercept(LandAverageTemperature, {x}) AS i
      FROM ({SPLIT}) s WHERE is_train) c""" for order, x in enumerate(("LandTemp_Lag1", "LandTemp_Lag12")))

ONE_YEAR = f"""
SELECT Country AS country, avg(AverageTemperature) / (2.0 * 1997) AS trend, avg(AverageTemperature) AS avg_temp, count(*) AS data_points
FROM ({OBS}) o WHERE Country IS NOT NULL AND Year = 1997 GROUP BY Country HAVING count(*) > 5
"""

SQL = {
    "predictions_closed_form": rnd(TWO_PRED, ["LandAverageTemperature", "Predicted_Temperature", "Temperature_Difference",
                                              "Temperature_Anomaly"]),
    "forecast_closed_form": rnd(f"SELECT year, month, date, c.i + (c.k1 + c.k2) * g.LandTemp_Lag1 AS predicted_temperature "
                                f"FROM ({FORECAST_GRID}) g, ({TWO}) c", ["predicted_temperature"]),
    "best_closed_form": rnd(f"SELECT * FROM ({BEST_ONE}) b ORDER BY test_r2 DESC, train_order LIMIT 1", ["test_r2"]),
    "one_year_trends": rnd(f"SELECT * FROM ({ONE_YEAR}) t ORDER BY trend DESC NULLS LAST, country LIMIT 10", ["trend", "avg_temp"]),
    "round_exact": """
        SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', CAST(l_quantity AS DOUBLE) / 8.0) AS DOUBLE) AS eighth,
               CAST(printf('%.4f', CAST(l_extendedprice AS DOUBLE) / 1000.0) AS DOUBLE) AS price,
               CAST(printf('%.1f', -CAST(l_quantity AS DOUBLE) / 8.0) AS DOUBLE) AS negative FROM lineitem""",
    "report_json": f"""
        SELECT 'annual_data' AS report, CAST(to_json(list(r ORDER BY r."Year")) AS VARCHAR) AS report_json
        FROM (SELECT struct_pack("Year" := "Year", "LandAverageTemperature" := LandAverageTemperature,
                     "Predicted_Temperature" := Predicted_Temperature, "Temperature_Anomaly" := Temperature_Anomaly) AS r
              FROM ({rnd(ANNUAL, ["LandAverageTemperature", "Temperature_Anomaly"], ["Predicted_Temperature"])}) a) b""",
    "linear_closed_form": rnd(CLOSED, ["LandAverageTemperature", "predicted"]),
    "cv_closed_form": rnd(CLOSED_CV, ["r2"]),
    "scan_global": rnd(F2, ["LandAverageTemperature"]),
    "scan_country": rnd(f"SELECT Country, dt, AverageTemperature FROM ({F1M}) x", ["AverageTemperature"]),
    "scan_city": rnd(F1, ["AverageTemperature"]),
    "write_read_roundtrip": rnd(f"SELECT *, CAST(floor(Year / 10) AS INTEGER) * 10 AS Decade FROM ({OBS}) o",
                                ["AverageTemperature"]),
    "reload_predictions": rnd(PRED, PRED_COLS6, ["Predicted_Temperature", "Temperature_Difference"]),
    "drop_missing": rnd(f"SELECT * FROM ({F1}) f WHERE AverageTemperature IS NOT NULL AND NOT isnan(AverageTemperature)",
                        ["AverageTemperature"]),
    "parse_dates": f"SELECT obs_id, dt FROM ({F1}) f",
    "calendar_parts": f"SELECT obs_id, dt, CAST(year(dt) AS INTEGER) AS Year, CAST(month(dt) AS INTEGER) AS Month FROM ({F1}) f",
    "year_cutoff": rnd(f"SELECT * FROM ({F1}) f WHERE dt >= DATE '1998-01-01'", ["AverageTemperature"]),
    "features_complete": rnd(FEAT, FEAT_DOUBLES),
    "feature_projection": rnd(f"SELECT {', '.join(FEATURES)}, LandAverageTemperature FROM ({FEAT}) f", FEAT_DOUBLES),
    "climate_features": rnd(FEAT, FEAT_DOUBLES),
    "country_match": f"SELECT obs_id, Country FROM ({MATCHED}) m",
    "clamp_years": "SELECT c_custkey, greatest(1, least(10, CAST(c_nationkey - 5 AS INTEGER))) AS years FROM customer",
    "lag_features": rnd(f"SELECT dt, LandAverageTemperature, lag(LandAverageTemperature, 1) OVER w AS LandTemp_Lag1, "
                        f"lag(LandAverageTemperature, 12) OVER w AS LandTemp_Lag12 FROM ({CLEAN_G}) g "
                        f"WINDOW w AS (ORDER BY Year, Month, dt)",
                        ["LandAverageTemperature", "LandTemp_Lag1", "LandTemp_Lag12"]),
    "lag_calendar": rnd(f"""
        WITH m AS (SELECT Country, dt, AverageTemperature FROM ({F1M}) x
                   WHERE AverageTemperature IS NOT NULL AND NOT isnan(AverageTemperature) AND dt >= DATE '1900-01-01')
        SELECT a.Country, a.dt, a.AverageTemperature, b.AverageTemperature AS Temp_CalLag12
        FROM m a LEFT JOIN m b ON a.Country = b.Country AND CAST(a.dt - INTERVAL 12 MONTH AS DATE) = b.dt""",
                        ["AverageTemperature", "Temp_CalLag12"]),
    "moving_averages": rnd(f"SELECT dt, LandTemp_MA3, LandTemp_MA12 FROM ({FEAT_ALL}) f", ["LandTemp_MA3", "LandTemp_MA12"]),
    "temp_changes": rnd(f"SELECT dt, TempChange_1Month, TempChange_1Year FROM ({FEAT_ALL}) f",
                        ["TempChange_1Month", "TempChange_1Year"]),
    "country_lags": rnd(f"""
        WITH m AS (SELECT Country, dt, AverageTemperature, CAST(year(dt) AS INTEGER) AS Year, CAST(month(dt) AS INTEGER) AS Month
                   FROM ({F1M}) x
                   WHERE AverageTemperature IS NOT NULL AND NOT isnan(AverageTemperature) AND dt >= DATE '1900-01-01')
        SELECT Country, dt, Year - min(Year) OVER (PARTITION BY Country) AS YearSinceStart,
               lag(AverageTemperature, 1) OVER w AS Temp_Lag1, lag(AverageTemperature, 12) OVER w AS Temp_Lag12,
               CASE WHEN count(AverageTemperature) OVER w3 = 3 THEN avg(AverageTemperature) OVER w3 END AS Temp_MA3,
               CASE WHEN count(AverageTemperature) OVER w12 = 12 THEN avg(AverageTemperature) OVER w12 END AS Temp_MA12,
               AverageTemperature - lag(AverageTemperature, 1) OVER w AS TempChange_1Month,
               AverageTemperature - lag(AverageTemperature, 12) OVER w AS TempChange_1Year
        FROM m
        WINDOW w AS (PARTITION BY Country ORDER BY Year, Month, dt),
               w3 AS (PARTITION BY Country ORDER BY Year, Month, dt ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
               w12 AS (PARTITION BY Country ORDER BY Year, Month, dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
                        ["Temp_Lag1", "Temp_Lag12", "Temp_MA3", "Temp_MA12", "TempChange_1Month", "TempChange_1Year"]),
    "time_split": f"SELECT dt, CAST(rn AS INTEGER) AS rn, is_train FROM ({SPLIT}) s",
    "kfold_assign": f"SELECT dt, CAST(ntile(5) OVER (ORDER BY Year, Month, dt) - 1 AS INTEGER) AS fold FROM ({SPLIT}) s WHERE is_train",
    "month_cycle": rnd(f"SELECT dt, sin(2.0 * pi() * Month / 12.0) AS MonthSin, cos(2.0 * pi() * Month / 12.0) AS MonthCos FROM ({CLEAN_G}) g",
                       ["MonthSin", "MonthCos"]),
    "years_since_start": f"SELECT dt, Year - (SELECT min(Year) FROM ({CLEAN_G}) m) AS YearSinceStart FROM ({CLEAN_G}) g",
    "last_observation": rnd(f"SELECT Year, Month, LandAverageTemperature FROM ({FEAT}) f ORDER BY Year DESC, Month DESC LIMIT 1",
                            ["LandAverageTemperature"]),
    "country_top_warming": rnd(f"SELECT * FROM ({TRENDS}) t ORDER BY trend DESC NULLS LAST, country LIMIT 10",
                               ["trend", "avg_temp"]),
    "country_count": f"SELECT CAST(count(DISTINCT Country) + max(CAST(Country IS NULL AS INTEGER)) AS BIGINT) AS total_countries FROM ({OBS}) f",
    "country_annual": rnd(f"SELECT Year, avg(AverageTemperature) AS AverageTemperature FROM ({MATCHED}) m GROUP BY Year",
                          ["AverageTemperature"]),
    "country_stats": rnd(COUNTRY_STATS, ["avg_temperature", "temperature_trend"]),
    "country_profile": rnd(COUNTRY_STATS, ["avg_temperature", "temperature_trend"]),
    "climate_status": f"SELECT country, {_TS} AS climate_status, {_TC} AS status_color FROM ({TRENDS}) t",
    "annual_trend": rnd(ANNUAL, ["LandAverageTemperature", "Temperature_Anomaly"], ["Predicted_Temperature"]),
    "decade_trend": rnd(f"SELECT Decade, avg(LandAverageTemperature) AS LandAverageTemperature, "
                        f"avg(Temperature_Anomaly) AS Temperature_Anomaly FROM ({PRED}) p GROUP BY Decade",
                        ["LandAverageTemperature", "Temperature_Anomaly"]),
    "recent_trend": rnd(RECENT, ["LandAverageTemperature", "Temperature_Anomaly"], ["Predicted_Temperature"]),
    "recent_slope": rnd(SLOPE, ["temperature_change_rate"]),
    "annual_extremes": rnd(EXTREMES, ["max_temperature", "min_temperature", "current_anomaly"]),
    "seasonal": rnd(SEASONAL, ["Avg_Temperature", "Temp_Std", "Avg_Anomaly"]),
    "extreme_months": EXTREME_MONTHS,
    "anomaly": rnd(f"SELECT dt, LandAverageTemperature - (SELECT avg(LandAverageTemperature) FROM ({FEAT}) a) AS Temperature_Anomaly FROM ({FEAT}) f",
                   ["Temperature_Anomaly"]),
    "global_trends": rnd(f"SELECT (SELECT temperature_change_rate FROM ({SLOPE}) s) AS temperature_change_rate, "
                         f"current_anomaly, max_temperature, min_temperature, data_years FROM ({EXTREMES}) e",
                         ["temperature_change_rate", "current_anomaly", "max_temperature", "min_temperature"]),
    "climate_summary": SUMMARY,
    "standardize": rnd(f"""
        WITH s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)}
                   FROM ({SPLIT}) t WHERE is_train)
        SELECT dt, {', '.join(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END AS {c}' for c in FEATURES)}
        FROM ({SPLIT}) x, s""", FEATURES),
    "linear_regression": rnd(f"SELECT dt, LandAverageTemperature, Predicted_Temperature FROM ({PRED}) p",
                             ["LandAverageTemperature"], ["Predicted_Temperature"]),
    "predictions_dataset": rnd(PRED, PRED_COLS6, ["Predicted_Temperature", "Temperature_Difference"]),
    "regression_metrics": rnd(f"""
        SELECT avg(CASE WHEN is_train THEN e * e END) AS train_mse, avg(CASE WHEN is_train THEN abs(e) END) AS train_mae,
               1.0 - sum(CASE WHEN is_train THEN e * e END) / sum(CASE WHEN is_train THEN (y - my_tr) * (y - my_tr) END) AS train_r2,
               avg(CASE WHEN NOT is_train THEN e * e END) AS test_mse, avg(CASE WHEN NOT is_train THEN abs(e) END) AS test_mae,
               1.0 - sum(CASE WHEN NOT is_train THEN e * e END) / sum(CASE WHEN NOT is_train THEN (y - my_te) * (y - my_te) END) AS test_r2
        FROM (SELECT is_train, LandAverageTemperature AS y, LandAverageTemperature - LandTemp_Lag1 AS e,
                     (SELECT avg(LandAverageTemperature) FROM ({SPLIT}) a WHERE is_train) AS my_tr,
                     (SELECT avg(LandAverageTemperature) FROM ({SPLIT}) a WHERE NOT is_train) AS my_te
              FROM ({SPLIT}) s) z""",
                              ["train_mse", "train_mae", "train_r2", "test_mse", "test_mae", "test_r2"]),
    "forecast_grid": rnd(FORECAST_GRID, ["MonthSin", "MonthCos", "LandTemp_Lag1", "LandTemp_Lag12", "LandTemp_MA3",
                                         "LandTemp_MA12", "TempChange_1Month", "TempChange_1Year"]),
    "forecast": rnd(f"SELECT year, month, date, LandTemp_Lag1 AS predicted_temperature FROM ({FORECAST_GRID}) g",
                    (), ["predicted_temperature"]),
}

SQL["country_lags_positional"] = SQL["country_lags"]
