"""The query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kohorta.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.orders`` reads the orders table of the chosen location."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.location, name)


def query(name: str, sql: str | None = None):
    """Register ``build(t)`` under ``name``; ``sql`` is the same result on the same tables."""
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, location: str) -> DataFrame:
            return build(Tables(spark, location))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register
