"""The query catalogue: name -> (plan over the adapters, oracle SQL or None). Names begin with the inventory's ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.sources.adapters import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Registers plan(view, ...) under `name`."""
    def add(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(*(view(spark, sf_dir, v) for v in views))
        run.__name__ = name
        QUERIES[name] = run
        if sql:
            SQL[name] = oracle(sql)
        return plan
    return add


def stream_query(name: str, sql: str | None = None):
    """Registers run(spark, sf_dir), which runs a streaming job to its end."""
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = oracle(sql)
        return run
    return add
