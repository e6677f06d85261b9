"""Queries of this subpackage with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(table) -> DataFrame``; ``table("documents")`` reads one of the given tables."""

    def register(fn):
        QUERIES[name] = lambda spark, path: fn(lambda table: spark.read.parquet(f"{path}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return fn

    return register
