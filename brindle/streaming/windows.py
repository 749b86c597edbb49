"""Event-time groupings that work alike on tables and on streams.

Watermarks need TIMESTAMP, so wall-clock columns are cast (the session's time zone is UTC).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F


def timed(df: DataFrame, time: str, late: str | None = None) -> DataFrame:
    """df with its time column as TIMESTAMP and, for a stream, a watermark: rows later than `late` are dropped."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, late) if late else df


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], late: str | None = None) -> GroupedData:
    return timed(df, time, late).groupBy(F.window(time, width), *keys)


def sliding(df: DataFrame, time: str, width: str, slide: str, keys: list[str], late: str | None = None) -> GroupedData:
    return timed(df, time, late).groupBy(F.window(time, width, slide), *keys)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> GroupedData:
    """Sessions end when a key is quiet for `gap`; at least one key is needed on a stream in append mode."""
    return timed(df, time, late).groupBy(F.session_window(time, gap).alias("window"), *keys)


def first_within(df: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Each key's first row; the same key may come again once the watermark has passed it."""
    return timed(df, time, late).dropDuplicatesWithinWatermark(keys)


def joined_streams(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int, late: str) -> DataFrame:
    """Inner join of two streams: right rows up to `seconds` after left ones.  Both watermarks bound the state."""
    a, b = timed(left, left_time, late).alias("a"), timed(right, right_time, late).alias("b")
    within = F.expr(f"b.{right_time} >= a.{left_time} AND b.{right_time} <= a.{left_time} + INTERVAL {int(seconds)} SECONDS")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & within)
