"""Arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_length(a: Column) -> Column:
    return F.array_size(a).cast("bigint")


def array_to_string(a: Column, delimiter: str, null_text: str | None = None) -> Column:
    return F.array_join(a, delimiter) if null_text is None else F.array_join(a, delimiter, null_text)


def generate_array(start, end, step: int = 1) -> Column:
    """GENERATE_ARRAY: empty where the step leads away from the end (Spark raises an error)."""
    start, end = F.lit(start), F.lit(end)
    away = (start > end) if step > 0 else (start < end)
    return F.when(away, F.array().cast("array<bigint>")).otherwise(F.sequence(start.cast("bigint"), end.cast("bigint"), F.lit(step).cast("bigint")))


def offset(a: Column, i: int) -> Column:
    """a[OFFSET(i)]: an error beyond the array's end."""
    return F.element_at(a, i + 1) if i >= 0 else F.raise_error(F.lit("OFFSET is negative"))


def ordinal(a: Column, i: int) -> Column:
    return F.element_at(a, i)


def safe_offset(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def safe_ordinal(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i - 1))
