"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nosoflow.plans.views import Inputs, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(inputs)`` under its name; ``sql`` may name the derived views."""

    def register(fn: Callable[[Inputs], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            ORACLES[key] = with_clause(sql)
        return fn

    return register
