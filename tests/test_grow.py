"""Forests grown on whole tables, and the segmenter that uses all pixels."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from terrascope.plans import forest as FO, grow as GR, segmentation as SEG

X = ["b", "g", "r", "yn", "xn"]


def _rows(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 60, (n, 3))
    y = (2 * x[:, 1] + rng.normal(0, 20, n) > x[:, 0] + x[:, 2]).astype(int)
    return spark.createDataFrame([(i, *map(int, x[i]), float(i % 8) / 8, float(i % 4) / 4, int(y[i])) for i in range(n)],
                                 "id long, b int, g int, r int, yn double, xn double, label int")


def _nodes(spark, model):
    cols = ["tree", "node", "left", "right", "feature", "threshold", "rows", "prediction", "stats"]
    return [tuple(map(str, r)) for r in FO.node_table(spark, model._node_folder).select(*cols).orderBy("tree", "node").collect()]


def test_one_tree_of_all_features_is_that_of_mllib(spark):
    df = _rows(spark, 1500)
    for impurity in ("gini", "entropy"):
        est = SEG.classifier(numTrees=1, maxDepth=7, featureSubsetStrategy="all", bootstrap=False, maxBins=64, impurity=impurity)
        theirs = Pipeline(stages=[VectorAssembler(inputCols=X, outputCol="features"), est]).fit(df)
        mine = GR.fit(est, df, X, ["id"])
        kept = ["node", "left", "right", "feature", "threshold", "rows", "prediction", "stats"]

        def shape(folder):
            by = {r.node: r for r in FO.node_table(spark, folder).select(*kept).collect()}

            def below(r):
                if r.left < 0:
                    return r.prediction, r.rows, tuple(r.stats)
                return r.feature, r.threshold, r.rows, below(by[r.left]), below(by[r.right])
            return below(by[0])
        assert shape(mine._node_folder) == shape(FO.saved(spark, theirs.stages[-1], "test-forest"))


def test_levels_added_up_over_tasks_give_the_tree_of_one_task(spark, monkeypatch):
    df = _rows(spark, 3000).repartition(5)
    est = SEG.classifier(numTrees=6, maxDepth=12)
    whole = GR.fit(est, df, X, ["id"], 10)
    called = []
    split = GR._split_large
    monkeypatch.setattr(GR, "_split_large", lambda *a: called.append(len(a[3])) or split(*a))
    for local, at_once, dealt in ((200, 2048, 1 << 28), (700, 3, 3000 * 2)):
        monkeypatch.setattr(GR, "LOCAL_ROWS", local)
        monkeypatch.setattr(GR, "NODES_AT_ONCE", at_once)
        monkeypatch.setattr(GR, "DEALT_ROWS", dealt)
        called.clear()
        parts = GR.fit(est, df.repartition(3), X, ["id"], 10)
        assert len(called) > 3 and max(called) <= at_once
        assert _nodes(spark, parts) == _nodes(spark, whole)
    # every tree draws as many rows as there are, about, and no two the same
    roots = [r.rows for r in FO.node_table(spark, whole._node_folder).where("node = 0").collect()]
    assert len(roots) == 6 and all(abs(n - 3000) < 300 for n in roots) and len(set(roots)) > 1
    inner = FO.node_table(spark, whole._node_folder).where("left >= 0")
    assert inner.agg(F.min("rows")).first()[0] >= 10


def test_labels_by_groups_of_trees_are_those_of_mllib(spark, monkeypatch, tmpdir_run):
    df = _rows(spark, 1200)
    model = PipelineModel([VectorAssembler(inputCols=X, outputCol="features"), GR.fit(SEG.classifier(numTrees=9, maxDepth=8), df, X, ["id"])])
    one = FO.Forest.of(spark, model)
    model.write().overwrite().save(f"{tmpdir_run}/model")
    loaded = PipelineModel.load(f"{tmpdir_run}/model")
    assert loaded.stages[-1].getNumTrees == model.stages[-1].getNumTrees == 9
    assert loaded.stages[-1].getOrDefault("minInstancesPerNode") == 5
    both = loaded.transform(one.label(df, X, "mine"))
    assert both.where("mine != prediction").count() == 0 and both.count() == 1200
    assert loaded.stages[-1].totalNumNodes == len(one.left)
    monkeypatch.setattr(FO, "NODES_AT_ONCE", len(one.left) // 3)
    many = FO.Forest.of(spark, loaded)
    assert isinstance(many, FO.LargeForest) and len(many.groups) > 2
    out = many.label(df, X, "mine")
    assert out.columns == [*df.columns, "mine"]
    assert sorted(out.collect()) == sorted(one.label(df, X, "mine").collect())


def test_few_rows_and_one_class(spark):
    df = _rows(spark, 300)
    for some, classes in ((df.limit(1), None), (df.where("label = 0"), 1), (df.where("label = 1"), 2)):
        model = GR.fit(SEG.classifier(numTrees=12), some, X, ["id"])
        nodes = FO.node_table(spark, model._node_folder).collect()
        assert sorted(r.tree for r in nodes) == list(range(12)) and all(r.left < 0 for r in nodes)
        assert classes is None or model.numClasses == classes
        said = {r.mine for r in FO.Forest.of(spark, model).label(some, X, "mine").collect()}
        assert said == {r.label for r in some.select("label").distinct().collect()}
    with pytest.raises(ValueError, match="no rows"):
        GR.fit(SEG.classifier(numTrees=2), df.limit(0), X, ["id"])


def _pixels(spark, images, size):
    px = spark.range(images).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("p"))
    px = px.select("image_id", F.expr(f"cast(p div {size} AS int)").alias("y"), F.expr(f"cast(p % {size} AS int)").alias("x"),
                   F.lit(size).alias("height"), F.lit(size).alias("width"),
                   *[F.expr(f"cast(pmod(xxhash64(image_id, p, {j}), 256) AS int)").alias(c) for j, c in enumerate("bgr")])
    return px, px.select("image_id", "y", "x", "height", "width", F.col("g").alias("v"))


def test_the_segmenter_trains_on_every_pixel(spark):
    """More rows than 25,000 in all, and more than 500 pixels an image (finding F1)."""
    images, size = 60, 24
    px, masks = _pixels(spark, images, size)
    model, report, _ = SEG.train_segmenter(px, masks, size=size, numTrees=3, maxDepth=3, bootstrap=False)
    total = images * size * size
    n = {r["class"]: r.support for r in report.collect()}["accuracy"]
    assert total > SEG.MAX_ROWS and abs(n - 0.2 * total) <= 1
    roots = FO.node_table(spark, model.stages[-1]._node_folder).where("node = 0").collect()
    assert [r.rows for r in roots] == [total - n] * 3


def test_a_caller_may_still_want_fewer_pixels(spark):
    px, masks = _pixels(spark, 5, 8)
    report = SEG.train_segmenter(px, masks, size=8, max_samples=20, numTrees=2, maxDepth=2)[1]
    assert {r["class"]: r.support for r in report.collect()}["accuracy"] == 20
    report = SEG.train_segmenter(px, masks, size=8, max_rows=50, numTrees=2, maxDepth=2)[1]
    assert abs({r["class"]: r.support for r in report.collect()}["accuracy"] - 10) <= 1
