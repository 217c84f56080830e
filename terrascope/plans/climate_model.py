"""Climate regression models (M1-M9, Q7).

A model is an MLlib ``PipelineModel``: VectorAssembler -> StandardScaler ->
regressor, so the scaler is saved and loaded with the model and cannot drift
from it.  MLlib's scaler divides by the *sample* std; the original scaler by
the *population* std.  The two differ by a constant factor per feature, which
changes no prediction of a linear model or a tree, so the pipeline keeps the
MLlib stage and ``standardize`` (M1) offers the population-std values as
columns for parity checks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascope.functions.calendar import decade, month_start_text
from terrascope.operators.joins import scalar, scalars
from terrascope.operators.series import FEATURES, TARGET, kfold_assign, last_observation, month_cycle, time_split
from terrascope.plans.forest import pruned

#: Rows that a node of the random forest needs to be split.
MIN_SPLIT = 5
MODEL_ORDER = ("random_forest", "gradient_boosting", "linear_regression")


def standardize(train: DataFrame, df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """M1: scale ``cols`` of ``df`` with the mean and population std of
    ``train``; a zero std divides by 1.  All statistics come from one
    aggregation pass over ``train`` (a single struct-valued scalar subquery)."""
    st = scalars(train, **{f"m_{c}": F.avg(c) for c in cols}, **{f"s_{c}": F.stddev_pop(c) for c in cols})
    out = df
    for c in cols:
        mean, std = st[f"m_{c}"], st[f"s_{c}"]
        out = out.withColumn(c, (F.col(c) - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std))
    return out


def regressor(kind: str, **params):
    """M2-M4 estimators with the original hyper-parameters as defaults."""
    if kind == "random_forest":
        p = dict(numTrees=100, maxDepth=15, minInstancesPerNode=2, featureSubsetStrategy="all", seed=42)
        p.update(params)
        return RandomForestRegressor(**p)
    if kind == "gradient_boosting":
        p = dict(maxIter=100, maxDepth=6, stepSize=0.1, seed=42)
        p.update(params)
        return GBTRegressor(**p)
    if kind == "linear_regression":
        # "auto": normal equations in one distributed pass (a p x p system
        # solved on the driver); MLlib falls back to L-BFGS by itself when the
        # system is singular.  On the leaky feature set it reproduces the
        # target to ~1e-13 (L-BFGS: ~1e-8) in half the time.
        p = dict(solver="auto", maxIter=500, tol=1e-12, regParam=0.0)
        p.update(params)
        return LinearRegression(**p)
    raise ValueError(f"unknown model kind {kind!r}")


def fit(train: DataFrame, kind: str, features: Sequence[str] = FEATURES, label: str = TARGET,
        min_split: int = MIN_SPLIT, **params) -> PipelineModel:
    """Fit VectorAssembler -> StandardScaler -> ``kind`` estimator on ``train``.  No
    split of a random forest has fewer than ``min_split`` rows (``forest.pruned``)."""
    est = regressor(kind, featuresCol="scaled", labelCol=label, predictionCol="prediction", **params)
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features_vec"),
        StandardScaler(inputCol="features_vec", outputCol="scaled", withMean=True, withStd=True),
        est,
    ])
    model = pipe.fit(train)
    if kind == "random_forest" and min_split > 2:
        model = PipelineModel([*model.stages[:-1], pruned(train.sparkSession, model.stages[-1], min_split)])
    return model


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction``; drop the intermediate vector columns."""
    return model.transform(df).drop("features_vec", "scaled")


def regression_metrics(pred: DataFrame, label: str = TARGET, prediction: str = "prediction",
                       prefix: str = "") -> DataFrame:
    """M5: MSE, MAE and R^2 in one aggregation pass (R^2 against the mean of
    the same split)."""
    err = F.col(label) - F.col(prediction)
    return pred.agg(
        F.avg(err * err).alias(f"{prefix}mse"),
        F.avg(F.abs(err)).alias(f"{prefix}mae"),
        (F.lit(1.0) - F.avg(err * err) / F.var_pop(label)).alias(f"{prefix}r2"),
    )


def _metrics_row(model: PipelineModel, train: DataFrame, test: DataFrame, label: str) -> dict:
    tr = regression_metrics(score(model, train), label, prefix="train_").first().asDict()
    te = regression_metrics(score(model, test), label, prefix="test_").first().asDict()
    return {**tr, **te}


def _parallel(fn, items, parallelism: int):
    """Submit independent Spark jobs from a few driver threads (what MLlib's
    ``CrossValidator(parallelism=n)`` does), so small fits share the cores."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(items)))) as pool:
        return list(pool.map(fn, items))


def cv_scores(train: DataFrame, kind: str, k: int = 5, label: str = TARGET, parallelism: int = 5,
              **params) -> DataFrame:
    """M6: k contiguous folds of the training part, R^2 per fold; returns
    ``fold, r2``.  Each fit is a distributed MLlib job (folds fitted
    concurrently); only the k fold scores come back."""
    folded = kfold_assign(train, k).cache()

    def one(f):
        m = fit(folded.filter(F.col("fold") != f), kind, label=label, **params)
        return f, float(regression_metrics(score(m, folded.filter(F.col("fold") == f)), label).first()["r2"])

    scores = _parallel(one, list(range(k)), parallelism)
    folded.unpersist()
    return train.sparkSession.createDataFrame(scores, "fold int, r2 double")


def train_and_select(features: DataFrame, kinds: Sequence[str] = MODEL_ORDER, label: str = TARGET,
                     params: dict | None = None, cv_folds: int = 5):
    """Q7: split in time order, fit every model kind, evaluate, choose the
    best by test R^2 (first in training order on ties).

    Returns ``(models, metrics_df, best_name)``; ``metrics_df`` is K4's
    table: ``model, train_order, train_mse, test_mse, train_r2, test_r2,
    train_mae, test_mae, cv_r2_mean, cv_r2_std``.
    """
    params = params or {}
    split = time_split(features).cache()
    train = split.filter("is_train")
    if train.limit(1).count() == 0:
        split.unpersist()
        raise ValueError("no complete feature rows to train on: every row has a missing value in some "
                         "column (rows with a gap in any column are dropped, like the original)")
    test = split.filter(~F.col("is_train"))
    spark = features.sparkSession

    def one(item):
        order, kind = item
        p = params.get(kind, {})
        m = fit(train, kind, label=label, **p)
        row = _metrics_row(m, train, test, label)
        if cv_folds:
            cv = cv_scores(train, kind, cv_folds, label, **p).agg(
                F.avg("r2").alias("m"), F.stddev_pop("r2").alias("s")).first()
            row.update(cv_r2_mean=float(cv["m"]), cv_r2_std=float(cv["s"]))
        else:
            row.update(cv_r2_mean=None, cv_r2_std=None)
        return kind, m, {"model": kind, "train_order": order, **row}

    results = _parallel(one, list(enumerate(kinds)), len(kinds))
    models = {kind: m for kind, m, _ in results}
    rows = [row for _, _, row in results]
    split.unpersist()
    metrics = spark.createDataFrame(
        rows, "model string, train_order int, train_mse double, train_mae double, train_r2 double, "
              "test_mse double, test_mae double, test_r2 double, cv_r2_mean double, cv_r2_std double")
    best = best_model(metrics).first()["model"]
    return models, metrics, best


def best_model(metrics: DataFrame) -> DataFrame:
    """Highest test R^2, first in training order on ties."""
    return metrics.orderBy(F.col("test_r2").desc(), F.col("train_order")).limit(1)


def predictions_dataset(model: PipelineModel, features: DataFrame, value: str = TARGET) -> DataFrame:
    """M8: score every feature row; add difference, decade and anomaly
    (value minus the mean over all rows, a scalar subquery)."""
    scored = score(model, features).withColumnRenamed("prediction", "Predicted_Temperature")
    return (scored
            .withColumn("Temperature_Difference", F.col("Predicted_Temperature") - F.col(value))
            .withColumn("Decade", decade("Year"))
            .withColumn("Temperature_Anomaly", F.col(value) - scalar(features, F.avg(value))))


def forecast_grid(pred: DataFrame, years: int = 5, value: str = TARGET, base_year=None) -> DataFrame:
    """M9 input: one feature row per month of the ``years`` calendar years
    after the last observed year.  Lags and means are the last value, changes
    are 0.  ``YearSinceStart`` counts from ``base_year`` (default: the first
    year of ``pred``, as in the original).  The grid is exploded from the last
    row itself -- no join."""
    base = F.lit(base_year) if base_year is not None else scalar(pred, F.min("Year"))
    last = last_observation(pred).select(F.col("Year").alias("_last_year"), F.col(value).alias("_last"))
    grid = (last.select("*", F.explode(F.sequence(F.lit(1), F.lit(years))).alias("_off"))
                .select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")))
    grid = grid.withColumn("year", F.col("_last_year") + F.col("_off"))
    sin_m, cos_m = month_cycle("month")
    return grid.select(
        "year", "month",
        month_start_text("year", "month").alias("date"),
        (F.col("year") - base).cast("int").alias("YearSinceStart"),
        sin_m.alias("MonthSin"), cos_m.alias("MonthCos"),
        F.col("_last").alias("LandTemp_Lag1"), F.col("_last").alias("LandTemp_Lag12"),
        F.col("_last").alias("LandTemp_MA3"), F.col("_last").alias("LandTemp_MA12"),
        F.lit(0.0).alias("TempChange_1Month"), F.lit(0.0).alias("TempChange_1Year"),
    )


def forecast(model: PipelineModel, pred: DataFrame, years: int = 5, base_year=None) -> DataFrame:
    """M9/Q4: ``year, month, date, predicted_temperature``."""
    from terrascope.operators.clean import clamp_years
    grid = forecast_grid(pred, clamp_years(years), base_year=base_year)
    return (score(model, grid.withColumn("YearSinceStart", F.col("YearSinceStart").cast("double")))
            .select("year", "month", "date", F.col("prediction").alias("predicted_temperature")))


def save_model(model: PipelineModel, path: str) -> None:
    """K6: persist the whole pipeline (scaler included)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """K6: load a pipeline saved by ``save_model``."""
    return PipelineModel.load(path)


def linear_predictions(spark: SparkSession, features: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """Fit the linear model on the time-ordered training part and score all
    rows (the model the original selects: its features reproduce the target
    exactly, so R^2 = 1).

    The feature and prediction tables hold one row per month of the series
    (bounded by the calendar, not by the raw data), so both are cached: the
    fit makes several passes and the reports read the predictions through
    several scalar subqueries.
    """
    features = features.cache()
    train = time_split(features).filter("is_train").drop("rn", "is_train")
    model = fit(train, "linear_regression")
    return model, predictions_dataset(model, features).cache()
