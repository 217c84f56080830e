"""Every key with oracle SQL must match DuckDB (row count, column names,
order-insensitive values); rows-only keys must run."""

import pytest

from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck

from terrascope.plans.registry import all_oracle_sql, all_queries

Q = all_queries()
SQL = all_oracle_sql()
# Heavy multi-fit keys are covered by test_models.py with fewer fits.
SLOW = {"metrics_table", "cv_scores", "best_model"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(SQL))
def test_oracle_key(spark, con, key):
    ok, detail, n, _ = compare(spark, key, Q[key], SQL[key], SF_SMALL, con)
    assert ok, f"{key}: {detail}"


@pytest.mark.parametrize("key", sorted(k for k in Q if k not in SQL and k not in SLOW))
def test_rows_only_key(spark, key):
    assert Q[key](spark, SF_SMALL).count() >= 1


def test_every_sql_key_is_registered():
    assert set(SQL) <= set(Q)


def test_entry(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["country", "trend", "avg_temp", "data_points"]
    assert 0 < df.count() <= 10
