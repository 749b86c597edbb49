"""Strings, regular expressions and hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def split(text: Column, delimiter: str = ",") -> Column:
    """SPLIT: the delimiter is plain text (Spark's is a pattern); an empty delimiter gives the characters."""
    if delimiter == "":
        return F.split(text, "")
    return F.split(text, "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def substr(text: Column, position: int, length: int | None = None) -> Column:
    """SUBSTR: position 0 is 1, a negative one counts from the end and stops at the start; a negative length is an error."""
    if length is not None and length < 0:
        raise ValueError("SUBSTR takes no negative length")
    n = F.char_length(text)
    start = F.lit(max(position, 1)) if position >= 0 else F.greatest(n + position + 1, F.lit(1))
    return F.substr(text, start, n if length is None else F.lit(length))


def regexp_extract(text: Column, pattern: str, group: int = 0) -> Column:
    """REGEXP_EXTRACT: null without a match (Spark gives an empty string)."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def regexp_replace(text: Column, pattern: str, replacement: str) -> Column:
    r"""REGEXP_REPLACE: groups are written \1 (Spark's are $1), a dollar sign is plain, a doubled backslash one."""
    out, i = "", 0
    while i < len(replacement):
        c = replacement[i]
        if c == "\\" and i + 1 < len(replacement):
            following = replacement[i + 1]
            out += f"${following}" if following.isdigit() else "\\" + following
            i += 2
            continue
        out += "\\$" if c == "$" else c
        i += 1
    return F.regexp_replace(text, pattern, out)


def contains_substr(text: Column, part: str) -> Column:
    """CONTAINS_SUBSTR: case-insensitive."""
    return F.contains(F.lower(text), F.lower(F.lit(part)))


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def md5_bytes(text: Column) -> Column:
    """MD5 as bytes (Spark gives hex text)."""
    return F.unhex(F.md5(text.cast("binary")))


def to_code_points(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))


def code_points_to_string(points: Column) -> Column:
    """CODE_POINTS_TO_STRING, over UTF-32 bytes: Spark's chr stops at 255."""
    return F.array_join(F.transform(points, lambda p: F.decode(F.unhex(F.lpad(F.hex(p.cast("bigint")), 8, "0")), "UTF-32")), "")


def normalize(text: Column, form: str = "NFC", casefold: bool = False) -> Column:
    """NORMALIZE and NORMALIZE_AND_CASEFOLD: Spark has no built-in, so an Arrow-batched UDF."""

    @pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        one = lambda x: unicodedata.normalize(form, unicodedata.normalize(form, x).casefold() if casefold else x)
        return s.map(one, na_action="ignore")

    return normal(text)


def net_host(url: Column) -> Column:
    """NET.HOST: the host of a URL with a scheme, or with two slashes or nothing before it, in the case it is written; null without one."""
    rest = F.regexp_replace(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    bare = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r"^.*@|:[0-9]*$", "")
    return F.nullif(bare, F.lit(""))


def net_ip_from_string(text: Column) -> Column:
    """NET.IP_FROM_STRING of an IPv4 address: four bytes; null for other texts (SAFE form)."""
    part = lambda i: F.lpad(F.hex(F.split_part(text, F.lit("."), F.lit(i)).cast("int")), 2, "0")
    digits = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(text.rlike(rf"^{digits}(\.{digits}){{3}}$"), F.unhex(F.concat(*[part(i) for i in (1, 2, 3, 4)])))
