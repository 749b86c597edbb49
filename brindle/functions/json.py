"""JSON kept as text."""

from __future__ import annotations

import json as _json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def json_query(text: Column, path: str = "$") -> Column:
    return F.get_json_object(text, path)


def json_value(text: Column, path: str = "$") -> Column:
    """JSON_VALUE: null for objects and arrays."""
    found = F.get_json_object(text, path)
    first = F.left(F.ltrim(found), F.lit(1))
    return F.when(~first.isin("{", "["), found)


def json_query_array(text: Column, path: str = "$") -> Column:
    return F.from_json(F.get_json_object(text, path), "array<string>")


json_value_array = json_query_array


def json_type(text: Column, path: str = "$") -> Column:
    """JSON_TYPE: object, array, string, number, boolean or null; null for no value."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))
    letters = F.regexp_extract(kind, "^[A-Z]+", 0)
    names = F.when(letters == "OBJECT", "object").when(letters == "ARRAY", "array").when(letters == "STRING", "string").when(letters == "BOOLEAN", "boolean")
    names = names.when(letters.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), "number")
    return names.when(letters == "VOID", "null")


def lax_bool(text: Column) -> Column:
    """LAX_BOOL: booleans, their texts in any case, and numbers (0 is false); null for all else."""
    word = F.lower(F.btrim(text, F.lit('"')))
    return F.when(word == "true", True).when(word == "false", False).otherwise(F.when(~text.startswith('"'), text.try_cast("double") != 0))


def lax_float64(text: Column) -> Column:
    """LAX_FLOAT64: numbers and texts of numbers; null for all else."""
    return F.btrim(text, F.lit('"')).try_cast("double")


def lax_int64(text: Column) -> Column:
    """LAX_INT64: numbers and texts of numbers, rounded half away from zero, and booleans as 1 and 0; null for all else."""
    number = lax_float64(text)
    whole = F.btrim(text, F.lit('"')).try_cast("bigint")
    rounded = F.floor(F.abs(number) + 0.5) * F.sign(number)
    return F.when(text == "true", F.lit(1)).when(text == "false", F.lit(0)).otherwise(F.coalesce(F.when(~text.contains("."), whole), rounded.try_cast("bigint")))


def lax_string(text: Column) -> Column:
    """LAX_STRING: texts without their quotes, numbers and booleans as they are written; null for objects, arrays and null."""
    return F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")).when(~text.rlike(r"^\s*[\[{]") & (text != "null"), text)


def json_keys_sorted(text: Column) -> Column:
    return F.sort_array(F.json_object_keys(text))


def to_json_string(value: Column) -> Column:
    return F.to_json(value)


def _steps(path: str) -> list[str | int]:
    found = re.findall(r"\.([A-Za-z_]\w*)|\[(\d+)\]", path)
    return [name or int(i) for name, i in found]


def _edited(text: Column, edit) -> Column:
    @pandas_udf("string")
    def edited(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _json.dumps(edit(_json.loads(x)), separators=(",", ":"), ensure_ascii=False), na_action="ignore")

    return edited(text)


def json_set(text: Column, path: str, value) -> Column:
    """JSON_SET at a path of names: missing objects are created."""
    steps = _steps(path)

    def edit(doc):
        at = doc
        for s in steps[:-1]:
            at = at.setdefault(s, {}) if isinstance(at, dict) else at[s]
        at[steps[-1]] = value
        return doc

    return _edited(text, edit)


def json_remove(text: Column, path: str) -> Column:
    """JSON_REMOVE: a path that is not there changes nothing."""
    steps = _steps(path)

    def edit(doc):
        at = doc
        for s in steps[:-1]:
            if isinstance(at, dict) and s in at or isinstance(at, list) and isinstance(s, int) and s < len(at):
                at = at[s]
            else:
                return doc
        if isinstance(at, dict):
            at.pop(steps[-1], None)
        elif isinstance(at, list) and isinstance(steps[-1], int) and steps[-1] < len(at):
            at.pop(steps[-1])
        return doc

    return _edited(text, edit)
