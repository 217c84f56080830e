"""Registry of every query key and its oracle SQL."""

from __future__ import annotations


def all_queries():
    """Every registered key -> ``(spark, sf_dir) -> DataFrame``."""
    from terrascope.plans import climate_queries, raster_queries
    return {**climate_queries.QUERIES, **raster_queries.QUERIES}


def all_oracle_sql():
    """Every key with DuckDB oracle SQL -> the SQL text."""
    from terrascope.plans import oracle_sql, raster_oracle_sql
    return {**oracle_sql.SQL, **raster_oracle_sql.SQL}
