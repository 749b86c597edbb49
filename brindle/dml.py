"""UPDATE, DELETE and MERGE on catalogue tables, as new snapshots (Parquet tables cannot change rows in place)."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog


def deleted(rows: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is not true (null keeps the row)."""
    return rows.where(~F.coalesce(where, F.lit(False)))


def updated(rows: DataFrame, assign: dict[str, Column], where: Column) -> DataFrame:
    """All rows, with the assignments where the condition is true; they all see the old values."""
    hit = F.coalesce(where, F.lit(False))
    names = {k.lower(): v for k, v in assign.items()}
    return rows.select(*[F.when(hit, names[f.name.lower()].cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name.lower() in names else F.col(f"`{f.name}`") for f in rows.schema.fields])


class DuplicateMatch(ValueError):
    """A target row is matched by more than one source row."""


def merged(
    target: DataFrame, source: DataFrame, on: list[str], update: dict[str, Column] | None = None, insert: dict[str, Column] | None = None,
    delete_matched: Column | None = None, delete_unmatched: bool = False, check: bool = True,
) -> DataFrame:
    """MERGE as one full outer join on the key columns.  Expressions may name target columns as t.x and source columns as s.x.

    Matched rows are deleted where delete_matched holds, else updated; unmatched source rows are inserted; unmatched target rows stay unless
    delete_unmatched.  Null keys match nothing.
    """
    if check:  # one aggregation by key, which shares the join's partitioning
        many = source.join(target.select(*on), on, "left_semi").groupBy(*on).count().where("count > 1").limit(1).collect()
        if many:
            raise DuplicateMatch(str(many[0].asDict()))
    t = target.withColumn("_t", F.lit(True)).alias("t")
    s = source.withColumn("_s", F.lit(True)).alias("s")
    cond = F.col(f"t.{on[0]}") == F.col(f"s.{on[0]}")
    for c in on[1:]:
        cond = cond & (F.col(f"t.{c}") == F.col(f"s.{c}"))
    joined = t.join(s, cond, "full")
    in_t, in_s = F.col("t._t").isNotNull(), F.col("s._s").isNotNull()
    keep = F.when(in_t & in_s, ~F.coalesce(delete_matched, F.lit(False)) if delete_matched is not None else F.lit(True))
    keep = keep.when(in_t, F.lit(not delete_unmatched)).otherwise(F.lit(insert is not None))
    update, insert = update or {}, insert or {}
    out = []
    for f in target.schema.fields:
        old = F.col(f"t.{f.name}")
        value = F.when(in_t & in_s, update.get(f.name, old).cast(f.dataType)).when(in_t, old).otherwise(insert.get(f.name, F.lit(None)).cast(f.dataType))
        out.append(value.alias(f.name))
    return joined.where(keep).select(*out)


@dataclass(frozen=True)
class When:
    """A clause of MERGE, taken by the first row it fits: MATCHED, NOT_MATCHED (a source row alone) or NOT_MATCHED_BY_SOURCE (a target row alone), where
    `condition` holds; then UPDATE or INSERT with values by column (columns left out are kept, or null in an insert), DELETE, or NOTHING."""

    case: str
    action: str
    values: dict[str, Column] = field(default_factory=dict)
    condition: Column | None = None


def merged_when(target: DataFrame, source: DataFrame, on: Column, clauses: list[When]) -> DataFrame:
    """MERGE with any condition and ordered clauses.  Expressions name target columns as t.x and source columns as s.x.

    One left join finds each target row's matches; a row matched by two source rows for which a clause acts raises DuplicateMatch.  Source rows
    without a match come from an anti join, so a condition without equal keys costs a nested loop only where Spark finds no keys in it.
    """
    t = target.withColumn("_t", F.monotonically_increasing_id()).alias("t")
    s = source.withColumn("_s", F.lit(True)).alias("s")
    own = {f.name.lower(): f for f in target.schema.fields}

    def chosen(case: str) -> tuple[Column, list[When]]:
        some = [w for w in clauses if w.case == case]
        number = F.lit(None).cast("int")
        for i in reversed(range(len(some))):
            hit = F.coalesce(some[i].condition, F.lit(False)) if some[i].condition is not None else F.lit(True)
            number = F.when(hit, F.lit(i)).otherwise(number)
        return number, some

    def columns(number: Column, some: list[When], old) -> list[Column]:
        out = []
        for name, f in own.items():
            value = old(f)
            for i, w in enumerate(some):
                given = {k.lower(): v for k, v in w.values.items()}
                if w.action in ("UPDATE", "INSERT") and (name in given or w.action == "INSERT"):
                    value = F.when(number == i, given.get(name, F.lit(None)).cast(f.dataType)).otherwise(value)
            out.append(value.alias(f.name))
        return out

    stays = lambda number, some: F.coalesce(~functools.reduce(Column.__or__, [number == i for i, w in enumerate(some) if w.action == "DELETE"], F.lit(False)), F.lit(True))
    matched, m = chosen("MATCHED")
    alone, a = chosen("NOT_MATCHED_BY_SOURCE")
    joined = t.join(s, on, "left")
    both = F.col("s._s").isNotNull()
    acts = functools.reduce(Column.__or__, [matched == i for i, w in enumerate(m) if w.action != "NOTHING"], F.lit(False))
    many = joined.where(both & acts).groupBy("t._t").count().where("count > 1").limit(1).collect()
    if many:
        raise DuplicateMatch(f"target row {many[0][0]} is matched more than once")
    old = lambda f: F.col(f"t.`{f.name}`")
    kept = joined.where((both & stays(matched, m)) | (~both & stays(alone, a)))
    pick = [F.when(both, x).otherwise(y).alias(f.name) for x, y, f in zip(columns(matched, m, old), columns(alone, a, old), own.values(), strict=True)]
    # a row that several source rows match, none of which acts, stays once
    kept = kept.select("t._t", F.coalesce(both & acts, F.lit(False)).alias("_acts"), F.struct(*pick).alias("_row"))
    kept = kept.groupBy("_t").agg(F.max_by("_row", "_acts").alias("_row")).select("_row.*")
    number, n = chosen("NOT_MATCHED")
    fresh = s.join(t, on, "left_anti").withColumn("_i", number).where(F.col("_i").isin([i for i, w in enumerate(n) if w.action == "INSERT"]))
    return kept.unionByName(fresh.select(*columns(F.col("_i"), n, lambda f: F.lit(None).cast(f.dataType)))) if n else kept


def delete(catalog: Catalog, table: str, where: Column) -> None:
    catalog.replace_rows(table, deleted(catalog.table(table), where))


def update(catalog: Catalog, table: str, assign: dict[str, Column], where: Column) -> None:
    catalog.replace_rows(table, updated(catalog.table(table), assign, where))


def merge(catalog: Catalog, table: str, source: DataFrame, on: list[str], **clauses) -> None:
    catalog.replace_rows(table, merged(catalog.table(table), source, on, **clauses))


def merge_when(catalog: Catalog, table: str, source: DataFrame, on: Column, clauses: list[When]) -> None:
    catalog.replace_rows(table, merged_when(catalog.table(table), source, on, clauses))


def truncate(catalog: Catalog, table: str) -> None:
    catalog.replace_rows(table, catalog.table(table).limit(0))
