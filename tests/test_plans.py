"""Plan hygiene for every registered query: no pair-emitting joins, no
Python in the plan, filters reach the scan, hot-group limits before the
shuffle."""

import pytest

from tests.conftest import SF_SMALL

from terrascope.plans.registry import all_queries

Q = all_queries()
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(k for k in Q if k not in {"metrics_table", "cv_scores", "best_model"}))
def test_no_pair_joins_or_python(spark, key):
    plan = _plan(Q[key](spark, SF_SMALL))
    bad = [f for f in FORBIDDEN if f in plan]
    assert not bad, f"{key}: {bad}"


def test_date_filter_reaches_orders_scan(spark):
    plan = _plan(Q["country_top_warming"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderdate" in plan


def test_group_limit_before_shuffle(spark):
    plan = _plan(Q["sample_per_image"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("key", ["focal_stats", "focal_close", "focal_smooth", "resample_bilinear"])
def test_band_operators_have_one_exchange(spark, key):
    plan = _plan(Q[key](spark, SF_SMALL))
    assert plan.count("Exchange ") == 1 and "Join" not in plan and "Aggregate" not in plan
    assert "FlatMapGroups" not in plan


def test_size_checked_broadcasts(spark, tmpdir_run):
    from terrascope.operators.joins import broadcast_if_small_files
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # only explicit hints broadcast
    try:
        big = spark.range(1000).withColumnRenamed("id", "k")
        small = spark.range(5).withColumnRenamed("id", "k")
        small.write.parquet(f"{tmpdir_run}/small")
        files = spark.read.parquet(f"{tmpdir_run}/small")
        assert "BroadcastHashJoin" in _plan(big.join(broadcast_if_small_files(files, f"{tmpdir_run}/small"), "k"))
        assert "BroadcastHashJoin" not in _plan(
            big.join(broadcast_if_small_files(files, f"{tmpdir_run}/small", max_bytes=10), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
