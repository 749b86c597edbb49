"""Aggregates with GoogleSQL's null and empty rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_agg(value: Column, order: Column | None = None, ignore_nulls: bool = False, distinct: bool = False, limit: int | None = None) -> Column:
    """ARRAY_AGG: keeps nulls unless told otherwise, is null for no rows, and may be ordered, distinct and limited."""
    item = F.struct(*([order.alias("k")] if order is not None else []), value.alias("v"))
    if ignore_nulls:
        item = F.when(value.isNotNull(), item)
    items = F.collect_set(item) if distinct else F.collect_list(item)
    if order is not None or distinct:
        items = F.sort_array(items)
    values = F.transform(items, lambda x: x["v"])
    if limit is not None:
        values = F.slice(values, 1, limit)
    return F.when(F.size(values) > 0, values)


def array_concat_agg(value: Column) -> Column:
    return F.flatten(F.collect_list(value))


def string_agg(value: Column, delimiter: str = ",", order: Column | None = None) -> Column:
    """STRING_AGG: null for no non-null values."""
    return F.array_join(array_agg(value, order, ignore_nulls=True), delimiter)


def countif(condition: Column) -> Column:
    return F.count_if(condition)


def logical_and(condition: Column) -> Column:
    return F.bool_and(condition)


def logical_or(condition: Column) -> Column:
    return F.bool_or(condition)


def approx_quantiles(value: Column, n: int, accuracy: int = 10_000) -> Column:
    """APPROX_QUANTILES: n + 1 bounds, from Spark's mergeable sketch."""
    return F.percentile_approx(value, [i / n for i in range(n + 1)], accuracy)
