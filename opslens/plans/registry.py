"""Registry of named queries over the driver tables and their SQL oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame``. The oracle is an SQL string
that DuckDB runs over the same parquet tables (registered as views named like
the tables). Computed doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def derived(fn):
    """Mark a derived input ``fn(spark, sf_dir)``. It is built anew for every query, so that no
    plan outlives a changed file listing."""
    return fn
