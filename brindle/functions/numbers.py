"""Numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any_null(columns: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])


def greatest(*columns: Column) -> Column:
    """GREATEST: null if any argument is (Spark skips nulls)."""
    return F.when(~_any_null(columns), F.greatest(*columns))


def least(*columns: Column) -> Column:
    return F.when(~_any_null(columns), F.least(*columns))


def log(x: Column, base: Column) -> Column:
    """LOG(x, base): Spark takes the base first."""
    return F.ln(x.cast("double")) / F.ln(base.cast("double"))


def safe_divide(x: Column, y: Column) -> Column:
    return F.try_divide(x, y)


def ieee_divide(x: Column, y: Column) -> Column:
    """IEEE_DIVIDE: infinities and NaN instead of errors."""
    x, y = x.cast("double"), y.cast("double")
    zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(x.isNull() | y.isNull(), None).when(y == 0, zero).otherwise(F.try_divide(x, y))


def round_half_away(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def cast_float_to_int(x: Column) -> Column:
    """CAST(float AS INT64): half away from zero (Spark truncates)."""
    return F.round(x).cast("bigint")


def equal_nan(x: Column, y: Column) -> Column:
    """Equality in which NaN equals nothing (Spark's NaN equals itself)."""
    return F.when(F.isnan(x) | F.isnan(y), F.lit(False) & (x == y)).otherwise(x == y)


def nan_first(x: Column) -> list[Column]:
    """Sort keys with nulls, then NaN, then the numbers (Spark sorts NaN last)."""
    return [x.isNotNull(), ~F.isnan(x), x.asc_nulls_first()]


def range_bucket(x: Column, bounds: Column) -> Column:
    """RANGE_BUCKET: how many bounds are at most x."""
    return F.when(x.isNotNull() & bounds.isNotNull(), F.size(F.filter(bounds, lambda b: b <= x)).cast("bigint"))


def numeric(x: Column) -> Column:
    """Back to NUMERIC's scale after arithmetic, whose scale Spark changes."""
    return x.cast("decimal(38,9)")


def parse_numeric(text: Column) -> Column:
    """PARSE_NUMERIC: a sign before or after the number, spaces around both and commas among the digits are allowed; an error for all else."""
    plain = F.regexp_replace(text, r"[\s,]", "")
    moved = F.regexp_replace(plain, r"^([^+-]+)([+-])$", "$2$1")
    return moved.cast("decimal(38,9)")


def cast_format(value: Column, pattern: str) -> Column:
    """CAST(number AS STRING FORMAT pattern), for patterns of digits, commas, a point, a sign and a currency sign."""
    return F.to_char(value, F.lit(pattern))
