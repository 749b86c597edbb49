"""Typed query parameters, as Spark's own parameter markers take them (:name and ?)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import SPARK, kind_of, value_of

#: Types for which an empty text means null.
EMPTY_IS_NULL = {"INT64", "FLOAT64", "BOOL", "NUMERIC", "BIGNUMERIC", "DATE", "DATETIME", "TIMESTAMP", "TIME"}


def spark_type(spec: dict) -> T.DataType:
    """{type}, {type: ARRAY, arrayType} or {type: STRUCT, structTypes: [{name, type}]}."""
    name = spec["type"].upper()
    if name == "ARRAY":
        return T.ArrayType(spark_type(spec["arrayType"]))
    if name in ("STRUCT", "RECORD"):
        return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in spec["structTypes"]])
    return SPARK[kind_of(name)]


def _value(spec: dict, value: dict | None) -> Any:
    name = spec["type"].upper()
    value = value or {}
    if name == "ARRAY":
        return [_value(spec["arrayType"], v) for v in value.get("arrayValues") or []]
    if name in ("STRUCT", "RECORD"):
        given = value.get("structValues") or {}
        return tuple(_value(f["type"], given.get(f["name"])) for f in spec["structTypes"])
    raw = value.get("value")
    if raw is None or (raw == "" and kind_of(name) in EMPTY_IS_NULL):
        return None
    return value_of(raw, SPARK[kind_of(name)])


def _column(value: Any, of: T.DataType) -> Column:
    """A literal of the declared type; Spark takes literals and constructors of literals as arguments, so a null has no type of its own."""
    if value is None:
        return F.lit(None)
    if isinstance(of, T.ArrayType):
        return F.array(*[_column(v, of.elementType) for v in value])
    if isinstance(of, T.StructType):
        return F.named_struct(*[c for v, f in zip(value, of.fields, strict=True) for c in (F.lit(f.name), _column(v, f.dataType))])
    return F.expr(f"{value}L") if isinstance(of, T.LongType) else F.lit(value)


def arguments(parameters: list[dict]) -> dict[str, Column] | list[Column]:
    """For spark.sql(args=...): a dict of named parameters or a list of positional ones, each with its declared type.

    parameters: [{name?, parameterType, parameterValue}] with every scalar as text.  Elements of arrays are coerced, too.
    """
    found = [(p.get("name"), _column(_value(p["parameterType"], p.get("parameterValue")), spark_type(p["parameterType"]))) for p in parameters]
    named = [n for n, _ in found if n]
    if named and len(named) != len(found):
        raise ValueError("named and positional parameters cannot be mixed")
    return dict(found) if named else [c for _, c in found]
