"""Registered queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables, read on first use: ``t.orders``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a key, with the SQL it must agree with."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise KeyError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql:
            ORACLES[name] = sql
        return fn

    return register
