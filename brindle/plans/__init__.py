"""The query catalogue: each operator as a DataFrame query, with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (t, spark) -> DataFrame, t(name) being a table of the folder, under its own name."""

    def add(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"), spark)

        QUERIES[build.__name__] = run
        if sql:
            SQL[build.__name__] = sql
        return build

    return add


def catalogue() -> tuple[dict, dict]:
    from . import aggregates, events, joins, nested, scalars, scans, sets, texts, warehouse, windows  # noqa: F401

    return QUERIES, SQL
