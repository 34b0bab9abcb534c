"""Collects the queries: a Spark job per key and, where SQL can say it, the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracegraph.session import tune
from tracegraph.sources.starview import StarGraph, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(graph)`` under ``key``."""

    def register(fn):
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return fn(StarGraph(tune(spark), directory))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return fn

    return register


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
