"""Function semantics against known values and plain Python."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brindle.functions as G


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_strings(spark):
    s = F.lit("a.b.c")
    assert one(spark, G.split(s, "."), G.substr(F.lit("abcd"), -2), G.substr(F.lit("abcd"), 0, 2), G.substr(F.lit("abcd"), -9, 2)) == (["a", "b", "c"], "cd", "ab", "ab")
    assert one(spark, G.regexp_extract(F.lit("abc"), "b(.)", 1), G.regexp_extract(F.lit("abc"), "z")) == ("c", None)
    assert one(spark, G.regexp_replace(F.lit("abc"), "(b)", r"[\1$]")) == ("a[b$]c",)
    assert one(spark, G.normalize(F.lit("é")), G.code_points_to_string(G.to_code_points(F.lit("aé漢")))) == ("é", "aé漢")
    assert one(spark, G.contains_substr(F.lit("Hello"), "ELL"), G.to_hex(G.md5_bytes(F.lit("a")))) == (True, "0cc175b9c0f1b6a831c399e269772661")


def test_numbers(spark):
    null = F.lit(None).cast("int")
    assert one(spark, G.greatest(F.lit(1), null), G.least(F.lit(1), F.lit(2)), G.safe_divide(F.lit(1.0), F.lit(0.0)), G.cast_float_to_int(F.lit(2.5))) == (None, 1, None, 3)
    assert one(spark, G.ieee_divide(F.lit(1), F.lit(0)), G.ieee_divide(F.lit(-1), F.lit(0))) == (float("inf"), float("-inf"))
    nan = F.lit(float("nan"))
    assert one(spark, G.equal_nan(nan, nan), G.equal_nan(F.lit(1.0), F.lit(1.0))) == (False, True)
    got = [r[0] for r in spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("-inf"),)], "x double").orderBy(*G.nan_first(F.col("x"))).collect()]
    assert got[0] is None and got[1] != got[1] and got[2:] == [float("-inf"), 1.0]


def test_arrays_and_json(spark):
    a = F.array(F.lit(5), F.lit(6))
    assert one(spark, G.offset(a, 1), G.ordinal(a, 1), G.safe_offset(a, 9), G.safe_ordinal(a, 2)) == (6, 5, None, 6)
    assert one(spark, G.generate_array(1, 10, 3), G.generate_array(5, 1)) == ([1, 4, 7, 10], [])
    j = F.lit('{"a":{"b":1},"c":"x","d":[1,2]}')
    assert one(spark, G.json_value(j, "$.a"), G.json_value(j, "$.c"), G.json_query(j, "$.a"), G.json_query_array(j, "$.d")) == (None, "x", '{"b":1}', ["1", "2"])
    assert one(spark, G.json_set(F.lit('{"a":1}'), "$.b.c", 2), G.json_remove(F.lit('{"a":1,"b":2}'), "$.b")) == ('{"a":1,"b":{"c":2}}', '{"a":1}')


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "k int, v string")
    v = F.col("v")
    assert df.agg(G.array_agg(v, F.col("k")), G.array_agg(v, v, ignore_nulls=True), G.string_agg(v, "-", v)).first()[:] == (["b", None, "a"], ["a", "b"], "a-b")
    assert df.where("false").agg(G.array_agg(v), G.countif(F.col("k") > 0)).first()[:] == (None, 0)


dates = st.dates(dt.date(1900, 1, 1), dt.date(2100, 1, 1))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(dates, dates), min_size=1, max_size=40))
def test_date_diff(spark, pairs):
    df = spark.createDataFrame(pairs, "a date, b date")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", *[G.date_diff(a, b, p).alias(p) for p in ("DAY", "WEEK", "ISOWEEK", "MONTH", "QUARTER", "YEAR")], G.date_trunc(a, "WEEK").alias("s"), G.extract_week(a).alias("w")).collect()
    for r in got:
        sunday = lambda d: (d.toordinal()) // 7  # noqa: E731  ordinal 7 is a Sunday
        monday = lambda d: (d.toordinal() - 1) // 7
        month = lambda d: d.year * 12 + d.month - 1
        assert (r.DAY, r.WEEK, r.ISOWEEK) == ((r.a - r.b).days, sunday(r.a) - sunday(r.b), monday(r.a) - monday(r.b))
        assert (r.MONTH, r.QUARTER, r.YEAR) == (month(r.a) - month(r.b), month(r.a) // 3 - month(r.b) // 3, r.a.year - r.b.year)
        assert r.s.isoweekday() == 7 and 0 <= (r.a - r.s).days < 7 and r.w == int(r.a.strftime("%U"))


def test_datetime_diff(spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    a, b = at("2024-01-01 01:01:00"), at("2024-01-01 00:59:00")
    assert one(spark, G.datetime_diff(a, b, "HOUR"), G.timestamp_diff(a, b, "HOUR"), G.timestamp_diff(b, a, "MINUTE")) == (1, 0, -2)
    assert one(spark, G.format_date("%Y/%m/%d at", F.lit("2024-05-06").cast("date")), G.parse_date("%d/%m/%Y", F.lit("06/05/2024"))) == ("2024/05/06 at", dt.date(2024, 5, 6))
    with pytest.raises(ValueError):
        G.format_date("%Q", F.current_date())
