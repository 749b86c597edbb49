"""The session and the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that the library's results rely on, and those that keep plans adaptive at any size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "brindle", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS and the caller's settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
