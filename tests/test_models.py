"""Model properties: exact linear fit, flat forecast, folds, split, best-model
tie rule, save / load."""

import math

from pyspark.sql import functions as F

from terrascope.operators import series as S
from terrascope.plans import climate_model as M
from terrascope.plans.climate_features import global_features
from tests.conftest import SF_SMALL


def _features(spark):
    return global_features(spark, SF_SMALL).cache()


def test_split_and_folds(spark):
    f = _features(spark)
    split = S.time_split(f).collect()
    n = len(split)
    n_test = math.ceil(0.2 * n)
    assert sum(r.is_train for r in split) == n - n_test
    last_train = max(r.rn for r in split if r.is_train)
    assert all(r.rn > last_train for r in split if not r.is_train)
    train = S.time_split(f).filter("is_train")
    folds = S.kfold_assign(train).groupBy("fold").count().orderBy("fold").collect()
    sizes = [r["count"] for r in folds]
    assert sum(sizes) == n - n_test and max(sizes) - min(sizes) <= 1
    assert sizes == sorted(sizes, reverse=True)


def test_linear_model_reproduces_target_and_flat_forecast(spark):
    f = _features(spark)
    model, pred = M.linear_predictions(spark, f)
    err = pred.agg(F.max(F.abs(F.col("Predicted_Temperature") - F.col(S.TARGET)))).first()[0]
    assert err < 1e-5
    last = S.last_observation(pred).first()
    fc = M.forecast(model, pred, 2).collect()
    assert len(fc) == 24 and fc[0].year == last.Year + 1 and fc[0].date.endswith("-01-01")
    assert max(abs(r.predicted_temperature - last[S.TARGET]) for r in fc) < 1e-4


def test_metrics_cv_and_best_model(spark):
    f = _features(spark)
    models, metrics, best = M.train_and_select(
        f, params={"random_forest": {"numTrees": 5, "maxDepth": 4},
                   "gradient_boosting": {"maxIter": 5, "maxDepth": 3}}, cv_folds=3)
    rows = {r.model: r for r in metrics.collect()}
    assert set(rows) == set(M.MODEL_ORDER)
    assert best == "linear_regression"
    assert rows["linear_regression"].test_r2 > 0.999
    assert rows["linear_regression"].cv_r2_std is not None


def test_tree_models_beat_the_mean_on_held_out_rows(spark):
    """The keys' own models (the original's settings): a floor on the held-out
    part, which a model that ignores its features cannot reach."""
    from terrascope.plans.climate_queries import q_gbt_regression, q_rf_regression
    split = S.time_split(_features(spark)).select("dt", "is_train")
    for query in (q_rf_regression, q_gbt_regression):
        pred = query(spark, SF_SMALL).join(split, "dt")
        r2 = {r.is_train: r.r2 for r in pred.groupBy("is_train").agg(
            (1 - F.avg((F.col(S.TARGET) - F.col("prediction")) ** 2) / F.var_pop(S.TARGET)).alias("r2")).collect()}
        assert r2[True] > 0.8 and r2[False] > 0.3, (query.__name__, r2)


def test_best_model_tie_takes_first(spark):
    m = spark.createDataFrame([("a", 0, 0.9), ("b", 1, 0.9), ("c", 2, 0.5)], "model string, train_order int, test_r2 double")
    assert M.best_model(m).first().model == "a"


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "a double")
    out = [r.a for r in M.standardize(df, df, ["a"]).collect()]
    sd = math.sqrt(1.25)
    assert all(math.isclose(o, e) for o, e in zip(out, [(v - 2.5) / sd for v in (1, 2, 3, 4)]))
    const = spark.createDataFrame([(3.0,), (3.0,)], "a double")
    assert [r.a for r in M.standardize(const, const, ["a"]).collect()] == [0.0, 0.0]


def test_save_load_roundtrip(spark, tmpdir_run):
    f = _features(spark)
    model, pred = M.linear_predictions(spark, f)
    M.save_model(model, f"{tmpdir_run}/model")
    again = M.load_model(f"{tmpdir_run}/model")
    a = [r.prediction for r in M.score(model, f).orderBy("dt").collect()]
    b = [r.prediction for r in M.score(again, f).orderBy("dt").collect()]
    assert a == b


def _forest_data(spark, n=900):
    import numpy as np
    rng = np.random.default_rng(12)
    x = rng.random((n, 5))
    y = ((x[:, 0] + x[:, 1] + rng.normal(0, 0.2, n)) > 1).astype(int)
    return spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], "b double, g double, r double, yn double, xn double, label int")


def test_no_small_node_is_split_and_labels_are_those_of_the_model(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from terrascope.plans import forest as FO, segmentation as SEG
    df = _forest_data(spark)
    grown = Pipeline(stages=[VectorAssembler(inputCols=SEG.FEATURE_COLS, outputCol="features"),
                             SEG.classifier(numTrees=8, maxDepth=9, minInstancesPerNode=1)]).fit(df)
    cut = FO.pruned(spark, grown.stages[-1], 40)

    def nodes(model):
        return {(r.tree, r.node): r for r in FO.node_table(spark, FO._saved(spark, model, "test-forest")).collect()}
    before, after = nodes(grown.stages[-1]), nodes(cut)
    assert any(r.left >= 0 and r.rows < 40 for r in before.values())
    assert all(r.rows >= 40 for r in after.values() if r.left >= 0)
    # the kept part of every tree is as it was grown
    todo = [((t, 0), (t, 0)) for t in range(8)]
    seen = 0
    while todo:
        a, b = todo.pop()
        old, new = before[a], after[b]
        seen += 1
        assert (old.rows, old.stats, old.prediction) == (new.rows, new.stats, new.prediction)
        assert (new.left >= 0) == (old.left >= 0 and old.rows >= 40)
        if new.left >= 0:
            assert (old.feature, old.threshold) == (new.feature, new.threshold)
            todo += [((a[0], old.left), (b[0], new.left)), ((a[0], old.right), (b[0], new.right))]
    assert seen == len(after)
    for model in (grown, type(grown)([grown.stages[0], cut])):
        both = model.transform(FO.Forest.of(spark, model).label(df, SEG.FEATURE_COLS, "mine"))
        assert both.where("mine != prediction").count() == 0 and both.count() == 900


def test_regression_forest_is_cut_too(spark):
    from terrascope.plans import forest as FO
    df = _forest_data(spark, 300).withColumn("t", F.col("b") * 3 + F.col("g"))
    model = M.fit(df, "random_forest", ["b", "g", "r"], "t", min_split=30, numTrees=3, maxDepth=6)
    rows = FO.node_table(spark, FO._saved(spark, model.stages[-1], "test-forest")).collect()
    assert any(r.left >= 0 for r in rows) and all(r.rows >= 30 for r in rows if r.left >= 0)
    assert M.score(model, df).where("abs(prediction - t) > 1.5").count() == 0


def test_registered_segmenter_trains_the_operators_own_forest(spark, monkeypatch):
    """The registered query on a few images, unmocked, at the operator's own settings."""
    from terrascope.plans import model_cache, raster_queries as RQ, segmentation as SEG
    px, masks = RQ._px, RQ._masks
    monkeypatch.setattr(RQ, "_px", lambda s, sf: px(s, sf).where("image_id < 6"))
    monkeypatch.setattr(RQ, "_masks", lambda s, sf: masks(s, sf).where("image_id < 6"))
    monkeypatch.setattr(model_cache, "_MODELS", {})
    report = {r["class"]: r for r in RQ.q_pixel_classifier(spark, SF_SMALL).collect()}
    forest = RQ._model(spark, SF_SMALL).stages[-1]
    assert forest.getNumTrees == 100 and forest.getOrDefault("maxDepth") == 20
    assert report["accuracy"].support == round(6 * 256 * 0.2) and report["accuracy"].f1_score > 0.6
    assert RQ.q_segment_images(spark, SF_SMALL).count() == 6
    assert SEG.MAX_ROWS == 25_000 and SEG.MIN_SPLIT == 10


def test_training_rows_are_bounded(spark):
    from terrascope.operators.sampling import sample_per_image, sample_rows
    big = spark.range(12_000).selectExpr("id % 2 as image_id", "cast(id / 200 as int) as y", "cast(id % 200 as int) as x")
    for k in (1500, 5000):
        some = sample_per_image(big, k)
        assert some.groupBy("image_id").count().agg(F.min("count"), F.max("count")).first() == (k, k)
        assert "WindowGroupLimit" not in some._jdf.queryExecution().executedPlan().toString()
    small = sample_per_image(big, 900)
    assert small.exceptAll(sample_per_image(big, 1500)).count() == 0      # the same order whatever the plan
    assert sample_rows(big, 4321).count() == 4321 and sample_rows(big, 99_999).count() == 12_000
