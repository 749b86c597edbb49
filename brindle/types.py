"""Field schemas of the warehouse model and Spark types, and the REST form of values.

Types without a Spark equivalent are kept as text with their name in the field's metadata (sqlType): JSON, GEOGRAPHY, BIGNUMERIC,
INTERVAL.  BIGNUMERIC has 76 digits where Spark's decimals end at 38.
"""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

# fixed values: the dialect's type names, each with its aliases
ALIASES = {
    "INT64": ("INT64", "INT", "SMALLINT", "INTEGER", "BIGINT", "TINYINT", "BYTEINT"), "BOOL": ("BOOL", "BOOLEAN"), "FLOAT64": ("FLOAT64", "FLOAT", "DOUBLE"),
    "NUMERIC": ("NUMERIC", "DECIMAL"), "BIGNUMERIC": ("BIGNUMERIC", "BIGDECIMAL"), "STRING": ("STRING",), "BYTES": ("BYTES",), "DATE": ("DATE",),
    "DATETIME": ("DATETIME",), "TIMESTAMP": ("TIMESTAMP",), "TIME": ("TIME",), "INTERVAL": ("INTERVAL",), "JSON": ("JSON",), "GEOGRAPHY": ("GEOGRAPHY",),
    "STRUCT": ("STRUCT", "RECORD"),
}
KIND = {alias: kind for kind, names in ALIASES.items() for alias in names}
SPARK = {
    "INT64": T.LongType(), "BOOL": T.BooleanType(), "FLOAT64": T.DoubleType(), "NUMERIC": T.DecimalType(38, 9), "BIGNUMERIC": T.StringType(), "STRING": T.StringType(),
    "BYTES": T.BinaryType(), "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampType(), "TIME": T.StringType(), "INTERVAL": T.StringType(),
    "JSON": T.StringType(), "GEOGRAPHY": T.StringType(),
}
AS_TEXT = {"BIGNUMERIC", "TIME", "INTERVAL", "JSON", "GEOGRAPHY"}
#: Names of the REST schema where they differ from the dialect's.
REST = {"INT64": "INTEGER", "FLOAT64": "FLOAT", "BOOL": "BOOLEAN", "STRUCT": "RECORD"}


def kind_of(name: str) -> str:
    kind = KIND.get(name.strip().upper())
    if kind is None:
        raise ValueError(f"unknown type {name!r}")
    return kind


def check_name(name: str) -> str:
    """Names with a backtick or a backslash are refused."""
    if not name or "`" in name or "\\" in name:
        raise ValueError(f"invalid identifier {name!r}")
    return name


def field(spec: dict) -> T.StructField:
    """A Spark field of {name, type, mode, fields}."""
    kind, mode = kind_of(spec["type"]), str(spec.get("mode") or "NULLABLE").upper()
    if mode not in ("NULLABLE", "REQUIRED", "REPEATED"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = T.StructType([field(f) for f in spec.get("fields", [])]) if kind == "STRUCT" else SPARK[kind]
    metadata = {"sqlType": kind} if kind in AS_TEXT else {}
    return T.StructField(check_name(spec["name"]), T.ArrayType(spark) if mode == "REPEATED" else spark, mode != "REQUIRED", metadata)


def schema(specs: list[dict]) -> T.StructType:
    return T.StructType([field(s) for s in specs])


def describe(of: T.StructField) -> dict:
    """The REST field of a Spark field; columns of results are NULLABLE unless the schema says otherwise."""
    spark = of.dataType
    mode = "REPEATED" if isinstance(spark, T.ArrayType) else "NULLABLE" if of.nullable else "REQUIRED"
    item = spark.elementType if isinstance(spark, T.ArrayType) else spark
    out: dict[str, Any] = {"name": of.name, "mode": mode}
    if isinstance(item, T.StructType):
        return out | {"type": "RECORD", "fields": [describe(f) for f in item.fields]}
    for kind, own in SPARK.items():
        if kind not in AS_TEXT and type(own) is type(item):
            return out | {"type": of.metadata.get("sqlType") or REST.get(kind, kind)}
    if isinstance(item, (T.IntegerType, T.ShortType, T.ByteType)):
        return out | {"type": "INTEGER"}
    if isinstance(item, T.FloatType):
        return out | {"type": "FLOAT"}
    return out | {"type": "STRING"}


def _timestamp(value: dt.datetime, micros: bool) -> str:
    value = value if value.tzinfo else value.replace(tzinfo=dt.UTC)
    us = (value - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
    return str(us) if micros else f"{us // 1_000_000}.{us % 1_000_000:06d}"


def cell(value: Any, of: T.DataType, micros: bool = False) -> dict:
    """The REST cell {v: ..}: scalars as text, structs as {f: [..]}, arrays as lists of cells, and a null array as an empty one."""
    if isinstance(of, T.ArrayType):
        return {"v": [cell(x, of.elementType, micros) for x in value or []]}
    if value is None:
        return {"v": None}
    if isinstance(of, T.StructType):
        return {"v": {"f": [cell(x, f.dataType, micros) for x, f in zip(value, of.fields, strict=True)]}}
    if isinstance(value, bool):
        return {"v": "true" if value else "false"}
    if isinstance(of, T.TimestampType):
        return {"v": _timestamp(value, micros)}
    if isinstance(of, T.TimestampNTZType):
        return {"v": value.isoformat(timespec="microseconds" if value.microsecond else "seconds")}
    if isinstance(value, (bytes, bytearray)):
        import base64

        return {"v": base64.b64encode(bytes(value)).decode()}
    if isinstance(value, Decimal):
        text = format(value, "f")
        return {"v": text.rstrip("0").rstrip(".") if "." in text else text}
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return {"v": str(int(value))}
    return {"v": str(value)}


def rest_rows(rows: list, of: T.StructType, micros: bool = False) -> list[dict]:
    return [{"f": [cell(x, f.dataType, micros) for x, f in zip(r, of.fields, strict=True)]} for r in rows]


def normalised(row: dict, of: T.StructType) -> tuple[dict, list[str]]:
    """A JSON row under the schema's spelling (names match in any case; missing ones are null, missing arrays empty), and the names that it does not have."""
    names = {f.name.lower(): f for f in of.fields}
    out = {f.name: [] if isinstance(f.dataType, T.ArrayType) else None for f in of.fields}
    unknown = []
    for k, v in row.items():
        f = names.get(k.lower())
        if f is None:
            unknown.append(k)
        else:
            out[f.name] = value_of(v, f.dataType, f.metadata)
    return out, unknown


def value_of(v: Any, of: T.DataType, metadata: dict | None = None) -> Any:
    """A JSON value as Spark's createDataFrame takes it."""
    if v is None:
        return [] if isinstance(of, T.ArrayType) else None
    if isinstance(of, T.ArrayType):
        return [value_of(x, of.elementType, metadata) for x in v]
    if isinstance(of, T.StructType):
        return normalised(v, of)[0]
    if isinstance(of, T.StringType):
        if isinstance(v, str):
            return v
        return json.dumps(v, separators=(",", ":")) if isinstance(v, (dict, list)) or (metadata or {}).get("sqlType") == "JSON" else "true" if v is True else "false" if v is False else str(v)
    if isinstance(of, T.LongType):
        return int(v)
    if isinstance(of, T.DoubleType):
        return float(v)
    if isinstance(of, T.BooleanType):
        return v if isinstance(v, bool) else {"true": True, "false": False}[str(v).lower()]
    if isinstance(of, T.DecimalType):
        return Decimal(str(v))
    if isinstance(of, T.DateType):
        return v if isinstance(v, dt.date) else dt.date.fromisoformat(v)
    if isinstance(of, T.TimestampType):
        return v if isinstance(v, dt.datetime) else parse_timestamp(v)
    if isinstance(of, T.TimestampNTZType):
        return v if isinstance(v, dt.datetime) else dt.datetime.fromisoformat(v)
    if isinstance(of, T.BinaryType):
        import base64

        return v if isinstance(v, (bytes, bytearray)) else base64.b64decode(v)
    return v


def parse_timestamp(v: str | int | float) -> dt.datetime:
    """ISO text with T or a space, with Z, UTC, an offset or nothing (UTC); or seconds since 1970."""
    try:
        seconds = Decimal(str(v))
        return dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(microseconds=int(seconds * 1_000_000))
    except ArithmeticError:
        pass
    at = dt.datetime.fromisoformat(str(v).strip().replace(" UTC", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=dt.UTC)
