"""Row ingest: streaming inserts with row-by-row errors, and write streams (committed, pending, buffered)."""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import Catalog
from .staging import remove, staged_at
from .types import normalised


def checked(of: T.StructType, rows: list[dict], ignore_unknown: bool = False) -> tuple[list[tuple], list[dict]]:
    """(rows that fit the schema, an error for each of the others: {index, errors})."""
    good, errors = [], []
    for i, row in enumerate(rows):
        try:
            values, unknown = normalised(row, of)
        except (ValueError, KeyError, TypeError, ArithmeticError) as e:
            errors.append({"index": i, "errors": [f"invalid: {e}"]})
            continue
        missing = [f.name for f in of.fields if not f.nullable and values[f.name] is None]
        problems = [f"no such field: {u}" for u in unknown if not ignore_unknown] + [f"missing required field: {m}" for m in missing]
        if problems:
            errors.append({"index": i, "errors": problems})
        else:
            good.append(tuple(values[f.name] for f in of.fields))
    return good, errors


def _frame(catalog: Catalog, of: T.StructType, good: list[tuple]) -> DataFrame:
    return catalog.spark.createDataFrame(good, T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in of.fields]))


def insert_all(catalog: Catalog, table: str, rows: list[dict], ignore_unknown: bool = False) -> list[dict]:
    """Appends the rows of one request that fit the table; returns an error for each of the others ({index, errors})."""
    of = catalog.table(table).schema
    good, errors = checked(of, rows, ignore_unknown)
    if good:
        catalog.write(table, _frame(catalog, of, good), create=False)
    return errors


class StreamError(ValueError):
    pass


@dataclass
class WriteStream:
    """COMMITTED rows show at once; PENDING rows when the streams are committed together; BUFFERED rows up to a flushed offset.

    A request is taken whole or not at all: its rows are checked first, then written in one append, and only then do offsets move.  Rows that do not
    show yet are staged as Parquet in the shared folder, one file a request with each row's offset; the driver holds the current request alone.
    """

    catalog: Catalog
    table: str
    kind: str = "COMMITTED"
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    offset: int = 0
    shown: int = 0
    finalized: bool = False
    committed: bool = False
    held: list[tuple[int, int, str]] = field(default_factory=list)  # (first offset, end offset, path) of each staged request

    def __post_init__(self):
        if self.kind not in ("COMMITTED", "PENDING", "BUFFERED"):
            raise StreamError(f"unknown stream type {self.kind}")

    def append(self, rows: list[dict], offset: int | None = None) -> int:
        """Takes rows and returns the offset of the first."""
        if self.finalized:
            raise StreamError("the stream is finalized")
        if offset is not None and offset != self.offset:
            raise StreamError(f"offset {offset} where {self.offset} is expected")
        of = self.catalog.table(self.table).schema
        good, errors = checked(of, rows)
        if errors:
            raise StreamError(str(errors))
        first = self.offset
        if good and self.kind == "COMMITTED":
            self.catalog.write(self.table, _frame(self.catalog, of, good), create=False)
        elif good:
            placed = T.StructType([T.StructField("offset", T.LongType()), T.StructField("row", T.StructType(_frame(self.catalog, of, []).schema.fields))])
            _, path = staged_at(self.catalog.spark.createDataFrame([(first + i, r) for i, r in enumerate(good)], placed).coalesce(1), "stream")
            self.held.append((first, first + len(good), path))
        self.offset += len(good)
        self.shown = self.offset if self.kind == "COMMITTED" else self.shown
        return first

    def rows(self, start: int, end: int) -> DataFrame | None:
        """The staged rows of offsets start to end - 1."""
        paths = [p for a, b, p in self.held if a < end and b > start]
        if not paths:
            return None
        return self.catalog.spark.read.parquet(*paths).where((F.col("offset") >= start) & (F.col("offset") < end)).select("row.*")

    def release(self, end: int) -> None:
        """Deletes staged requests that show whole."""
        for _, _, path in (h for h in self.held if h[1] <= end):
            remove(self.catalog.spark, path)
        self.held = [h for h in self.held if h[1] > end]

    def flush(self, offset: int) -> int:
        """Shows the rows up to and with `offset` of a BUFFERED stream; those already shown are not written again."""
        if self.kind != "BUFFERED":
            raise StreamError("only buffered streams are flushed")
        if offset >= self.offset:
            raise StreamError(f"offset {offset} is beyond the stream's end")
        if offset + 1 > self.shown:
            self.catalog.write(self.table, self.rows(self.shown, offset + 1), create=False)
            self.shown = offset + 1
            self.release(self.shown)
        return self.shown

    def finalize(self) -> int:
        self.finalized = True
        return self.offset


def batch_commit(streams: list[WriteStream]) -> None:
    """Shows the rows of finalized PENDING streams, those of each table in one append."""
    for s in streams:
        if s.kind != "PENDING" or not s.finalized or s.committed:
            raise StreamError(f"stream {s.name} is not a finalized pending stream, or is committed")
    by_table: dict[tuple, list[WriteStream]] = {}
    for s in streams:
        by_table.setdefault((id(s.catalog), s.catalog.path(s.table)), []).append(s)
    for own in by_table.values():
        rows = [x for s in own if (x := s.rows(0, s.offset)) is not None]
        if rows:
            own[0].catalog.write(own[0].table, functools.reduce(DataFrame.unionByName, rows), create=False)
        for s in own:
            s.committed, s.shown = True, s.offset
            s.release(s.offset)


def read_rows(catalog: Catalog, table: str, columns: list[str] | None = None, restriction: str | None = None) -> DataFrame:
    """A read session: the chosen columns in the chosen order and the rows that a SQL condition holds for; both reach the scan.

    toArrow() of the result is the Arrow form.
    """
    df = catalog.table(table)
    df = df.where(restriction) if restriction else df
    return df.select(*columns) if columns else df
