"""Dates and times.  DATE and DATETIME differences count boundaries, TIMESTAMP differences whole units; weeks begin on Sunday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strftime elements and Spark's pattern letters.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE",
    "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "z": "xx", "Z": "z", "%": "%",
}


def pattern(strftime: str) -> str:
    """A Spark datetime pattern for a strftime format; letters outside of elements are quoted."""
    out, i = "", 0
    while i < len(strftime):
        c = strftime[i]
        if c == "%" and i + 1 < len(strftime):
            if strftime[i + 1] not in STRFTIME:
                raise ValueError(f"format element %{strftime[i + 1]} is not supported")
            out += STRFTIME[strftime[i + 1]]
            i += 2
            continue
        if c.isalpha():
            j = i
            while j < len(strftime) and strftime[j].isalpha():
                j += 1
            out += f"'{strftime[i:j]}'"
            i = j
            continue
        out += "''" if c == "'" else c
        i += 1
    return out


def format_date(strftime: str, at: Column) -> Column:
    return F.date_format(at, pattern(strftime))


def parse_date(strftime: str, text: Column) -> Column:
    return F.to_date(text, pattern(strftime))


def _week(at: Column) -> Column:
    """Number of the Sunday-based week since 1970-01-04."""
    return F.floor(F.datediff(at, F.lit("1970-01-04").cast("date")) / 7)


def date_diff(end: Column, start: Column, part: str) -> Column:
    """DATE_DIFF: boundaries of the part between the dates."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    found = {
        "DAY": lambda: F.datediff(end, start),
        "WEEK": lambda: _week(end) - _week(start),
        "ISOWEEK": lambda: (F.datediff(F.trunc(end, "week"), F.trunc(start, "week")) / 7),
        "MONTH": lambda: month(end) - month(start),
        "QUARTER": lambda: (F.year(end) * 4 + F.quarter(end)) - (F.year(start) * 4 + F.quarter(start)),
        "YEAR": lambda: F.year(end) - F.year(start),
    }
    return found[part.upper()]().cast("bigint")


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


_UNITS = {"MICROSECOND": 1, "MILLISECOND": 1_000, "SECOND": 1_000_000, "MINUTE": 60_000_000, "HOUR": 3_600_000_000, "DAY": 86_400_000_000}


def datetime_diff(end: Column, start: Column, part: str) -> Column:
    """DATETIME_DIFF: boundaries of the part."""
    if part.upper() in _UNITS:
        unit = _UNITS[part.upper()]
        return (F.floor(_micros(end) / unit) - F.floor(_micros(start) / unit)).cast("bigint")
    return date_diff(end.cast("date"), start.cast("date"), part)


def timestamp_diff(end: Column, start: Column, part: str) -> Column:
    """TIMESTAMP_DIFF: whole units."""
    return F.expr("1").cast("bigint") * ((_micros(end) - _micros(start)) / _UNITS[part.upper()]).cast("bigint")


def date_trunc(at: Column, part: str) -> Column:
    """DATE_TRUNC: WEEK goes to Sunday, ISOWEEK to Monday."""
    if part.upper() == "WEEK":
        return F.date_sub(at, F.dayofweek(at) - 1)
    return F.trunc(at, {"ISOWEEK": "week"}.get(part.upper(), part))


def extract_week(at: Column) -> Column:
    """EXTRACT(WEEK): Sunday-based, days before the first Sunday are week 0."""
    return F.floor((F.dayofyear(at) + 7 - F.dayofweek(at)) / 7).cast("bigint")
