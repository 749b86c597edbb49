"""Relational operators over DataFrames: QUALIFY, as-of, range and interval joins, wildcard unions, paging."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition over window functions holds.  Spark turns a rank bound into a limit within each group."""
    return df.withColumn("_qualify", condition).where("_qualify").drop("_qualify")


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, take: list[str], prefix: str = "right_", ranges: int | None = None
) -> DataFrame:
    """Each left row with the columns `take` of the latest right row of its key that is not later; nulls if there is none, or if a key is null.

    Both sides are laid one above the other, dealt to ranges of (key, time) and sorted there; a window inside each range carries the last right row
    forward, and a range's first rows take the last right row of the key from the ranges before, of which each keeps one small row.  So a key
    with many rows is spread over tasks, and nothing is multiplied.  Of right rows with equal times any one is taken.
    """
    keys = F.struct(*[F.col(f"`{c}`") for c in on])
    known = functools.reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in on])
    mark = F.struct(*[F.col(f"`{c}`") for c in take])
    below = right.where(F.col(f"`{right_time}`").isNotNull() & known).select(keys.alias("key"), F.col(f"`{right_time}`").alias("time"), F.lit(0).alias("side"), mark.alias("mark"))
    above = left.select(keys.alias("key"), F.col(f"`{left_time}`").alias("time"), F.lit(1).alias("side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"))
    both = below.unionByName(above, allowMissingColumns=True)
    order = ["key", "time", "side"]
    dealt = both.repartitionByRange(ranges, *order) if ranges else both.repartitionByRange(*order)
    part = staged(dealt.withColumn("part", F.spark_partition_id()), "asof")
    inside = Window.partitionBy("part", "key").orderBy("time", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = part.withColumn("found", F.last("mark", ignorenulls=True).over(inside)).where("side = 1")
    # the last right row of each range, where the next range goes on with its key: one row a range
    ends = part.where("side = 0").groupBy("part").agg(F.max_by(F.struct("key", "mark"), F.struct("key", "time")).alias("end"))
    lows = part.groupBy("part").agg(F.min("key").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = lows.join(ends, "part", "left").select("part", "first", F.last("end", ignorenulls=True).over(before).alias("end"))
    last = last.where(F.col("end.key") == F.col("first")).select("part", F.col("end.key").alias("key"), F.col("end.mark").alias("end"))
    out = carried.join(F.broadcast(last), ["part", "key"], "left").withColumn("found", F.coalesce("found", "end"))
    return out.select("row.*", *[F.col("found").getField(c).alias(prefix + c) for c in take])


def range_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with low <= at < high as an equi-join: a span is copied to each bucket of `width` that it touches.

    Choose the width near the usual span: narrower copies spans more, wider compares more pairs.
    The join is a merge, also where the spans could be broadcast, and takes span by span: the pairs of a span are neighbours, and those of the next repeat
    the points of their bucket in the same order, so that the pairs written take a fraction of the space.  A task holds the points of one bucket.
    """
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    last = F.when(F.col(high) > F.col(low), F.ceil(F.col(high) / width) - 1).otherwise(F.floor(F.col(low) / width))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.greatest(last, F.floor(F.col(low) / width)))))
    keys = [*(on or []), "_bucket"]
    joined = s.hint("merge").join(p, keys).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high)))
    return joined.select(*[c for c in keys if c != "_bucket"], *[p[c] for c in points.columns if c not in keys], *[s[c] for c in spans.columns if c not in keys])


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of a key whose right time is within `seconds` after the left time (0 included).

    The left row goes to its bucket of `seconds` and the next, the right row to its own: two copies of a row at most.
    """
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    a = left.withColumn("_second", second(left_time)).withColumn("_bucket", F.explode(F.array(F.floor(F.col("_second") / seconds), F.floor(F.col("_second") / seconds) + 1)))
    b = right.withColumn("_other", second(right_time)).withColumn("_bucket", F.floor(F.col("_other") / seconds))
    joined = a.join(b, [*on, "_bucket"])
    return joined.where((F.col("_other") >= F.col("_second")) & (F.col("_other") <= F.col("_second") + seconds)).drop("_bucket", "_second", "_other")


def salted_join(large: DataFrame, small: DataFrame, on: list[str], salts: int = 16) -> DataFrame:
    """Inner equi-join in which the keys of `large` are spread over `salts` tasks and the rows of `small` copied to each."""
    a = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    b = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "_salt"]).drop("_salt")


def places(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """df with each row's place (from 1) in a global order, by ranges of the order that are staged, numbered apart and moved by the rows before them.

    `order` should end in a unique column: rows that tie in all of it share a range.
    """
    part = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "places")
    counts = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return part.join(F.broadcast(before), "_part").withColumn(name, at + F.col("_before")).drop("_part", "_before")


def ranked(df: DataFrame, *order) -> DataFrame:
    """df with place, rank, dense_rank, and how many rows and ties there are (`_rows`, `_ties`), in a global order without one task for all.

    Values are counted, the distinct ones numbered range by range, and the counts joined back: rows that tie are never brought together.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns({n: o for n, o in zip(names, order, strict=True)})
    counts = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_ties"))
    spread = staged(counts.repartitionByRange(*names).withColumn("_part", F.spark_partition_id()), "ranks")
    sums = spread.groupBy("_part").agg(F.sum("_ties").alias("_n"), F.count(F.lit(1)).alias("_d"))  # one row a range
    upto = Window.orderBy("_part")
    starts = sums.select("_part", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), (F.sum("_d").over(upto) - F.col("_d")).alias("_distinct"), F.sum("_n").over(Window.partitionBy()).alias("_rows"))
    inside = Window.partitionBy("_part").orderBy(*names)
    known = spread.withColumn("_upto", F.sum("_ties").over(inside)).withColumn("_nth", F.row_number().over(inside)).join(F.broadcast(starts), "_part")
    known = known.select(*names, "_ties", "_rows", (F.col("_before") + F.col("_upto") - F.col("_ties") + 1).alias("rank"), (F.col("_distinct") + F.col("_nth")).alias("dense_rank"))
    same = functools.reduce(Column.__and__, [keyed[n].eqNullSafe(known[n]) for n in names])
    return keyed.join(known, same).drop(*names)


def group_percentiles(df: DataFrame, key: str, value: str, at: list[float]) -> DataFrame:
    """(key, cont array, disc array): exact percentiles by key, interpolated and discrete, of non-null values.

    Values are counted and the distinct ones numbered range by range; each percentile needs two of them, so a key with any number of values is
    never in one task, as it is with an aggregate that keeps them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    spread = staged(counts.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()), "percentiles")
    sums = spread.groupBy("k", "part").agg(F.sum("n").alias("m"))  # one row a range and key in it
    by = Window.partitionBy("k")
    starts = sums.select(F.col("k").alias("k2"), F.col("part").alias("p2"), (F.sum("m").over(by.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(by).alias("total"))
    inside = Window.partitionBy("k", "part").orderBy("v")
    placed = spread.withColumn("upto", F.sum("n").over(inside)).join(starts, F.col("k").eqNullSafe(F.col("k2")) & (F.col("part") == F.col("p2")))
    end, first = F.col("before") + F.col("upto"), F.col("before") + F.col("upto") - F.col("n")  # places from 0: first to end - 1
    aggs = []
    for i, q in enumerate(at):
        exact = F.lit(q) * (F.col("total") - 1)
        here = lambda place: F.max(F.when((first <= place) & (end > place), F.col("v")))
        low, high = here(F.floor(exact)), here(F.ceil(exact))
        share = F.max(exact - F.floor(exact))
        aggs.append((low + (high - low) * share).alias(f"cont{i}"))
        aggs.append(F.min(F.when(end >= F.lit(q) * F.col("total"), F.col("v"))).alias(f"disc{i}"))
    done = placed.groupBy("k").agg(*aggs)
    return done.select(F.col("k").alias(key), F.array(*[F.col(f"cont{i}") for i in range(len(at))]).alias("cont"), F.array(*[F.col(f"disc{i}") for i in range(len(at))]).alias("disc"))


def first_of_group(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each group, with their `place`: Spark keeps n rows of a group in each task before it shuffles."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def wildcard_union(tables: dict[str, DataFrame], prefix: str) -> DataFrame:
    """The tables whose names begin with `prefix` as one, with `_table_suffix`; columns that a table lacks are null."""
    parts = [df.withColumn("_table_suffix", F.lit(name[len(prefix) :])) for name, df in sorted(tables.items()) if name.startswith(prefix)]
    if not parts:
        raise ValueError(f"no table matches {prefix}*")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def page(df: DataFrame, order: list[str], start: int, size: int) -> tuple[list, str | None]:
    """Rows start to start + size of a stable order, and the token (the next row's index) of the next page, if there is one."""
    rows = df.orderBy(*order).offset(start).limit(size + 1).collect()
    return rows[:size], str(start + size) if len(rows) > size else None
