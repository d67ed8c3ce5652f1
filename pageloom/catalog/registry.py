"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(load, spark)``; ``load(table)`` reads a whole table."""
    def add(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            from .views import Tables
            return function(Tables(spark, folder))
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function
    return add
