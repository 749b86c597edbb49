"""Loads: CSV with its own width and header rules and type detection, NDJSON, Parquet, ORC, and seed files."""

from __future__ import annotations

import csv
import functools
import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import schema as schema_of
from ..types import value_of

# fixed values: detected types in their order, the text that counts as null ("null" in any case), one wildcard in a path
#: CSV types from the narrowest on, each with how a text is tested for it.
DETECTED: tuple[tuple[str, T.DataType], ...] = (
    ("BOOLEAN", T.BooleanType()), ("INTEGER", T.LongType()), ("FLOAT", T.DoubleType()), ("DATE", T.DateType()), ("TIMESTAMP", T.TimestampType()),
)


class BadRows(ValueError):
    """Rows of another width than the schema's."""


def _fits(text: Column, kind: str) -> Column:
    if kind == "BOOLEAN":
        return F.lower(text).isin("true", "false")
    if kind == "INTEGER":
        return text.rlike(r"^[+-]?\d+$") & text.try_cast("bigint").isNotNull()
    if kind == "FLOAT":
        return text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    if kind == "DATE":
        return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull()
    return text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}") & text.try_cast("timestamp").isNotNull()


def _first_lines(spark: SparkSession, paths: list[str], encoding: str) -> dict[str, str]:
    """The first line that is not blank of each file: one short text a file."""
    at = [F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("line")]
    lines = spark.read.option("encoding", encoding).text(paths).select(*at, "value").where("trim(value) <> ''")
    rows = lines.groupBy("file").agg(F.min_by("value", "line").alias("value"), F.min("line").alias("line")).orderBy("file").collect()
    return {r["file"]: r["value"].removesuffix("\r").removeprefix("\ufeff") for r in rows}


def _head(spark: SparkSession, file: str, records: int, delimiter: str, quote: str, encoding: str) -> list[list[str]]:
    """The first records of a file."""
    lines = [r.value for r in spark.read.option("encoding", encoding).text(file).limit(100 * records).collect()]
    found = csv.reader([f"{x}\n" for x in lines if x.strip()], delimiter=delimiter, quotechar=quote)
    return list(itertools.islice(found, records))


def load_csv(
    spark: SparkSession, path: str | list[str], specs: list[dict] | None = None, delimiter: str = ",", skip: int = 0, jagged: bool = False, autodetect: bool = False,
    quote: str = '"', null_marker: str = "", encoding: str = "UTF-8", max_bad: int = 0,
) -> DataFrame:
    """CSV files as a typed table, by Spark's CSV reader with all columns as text.

    Empty fields and the null marker are null.  With a schema and no skip, the first record of a file is a header if all its cells name columns; it
    orders the columns of that file.  Rows that are too long, or too short unless `jagged`, and values that do not fit their types are bad: more
    than `max_bad` of them raise BadRows before any row is returned, fewer are left out.  With `autodetect` and no schema, each
    column gets the narrowest of DETECTED that all its values have, else STRING, from one aggregation over all rows.

    Files are split between tasks unless a line has an odd number of quotes: then a record may go over lines, and each file is one task's.
    """
    if len(delimiter) != 1:
        raise ValueError("the delimiter is one character")
    paths = [path] if isinstance(path, str) else list(path)
    first = _first_lines(spark, paths, encoding)
    if specs is None and (not autodetect or not first):
        raise ValueError("a schema or autodetect is needed")
    odd = spark.read.option("encoding", encoding).text(paths).where(F.length(F.regexp_replace("value", f"[^{re.escape(quote)}]", "")) % 2 == 1)
    multi = bool(quote) and not odd.isEmpty()
    names = {s["name"].lower(): i for i, s in enumerate(specs or [])}
    line = lambda f: next(csv.reader([first[f]], delimiter=delimiter, quotechar=quote))
    # files by their header: its cells, or none
    groups: dict[tuple[str, ...] | None, list[str]] = {}
    for f in first:
        head = _head(spark, f, max(1, skip), delimiter, quote, encoding)[-1] if skip > 1 or (multi and first[f].count(quote) % 2) else line(f)
        known = specs is None or all(c.lower() in names for c in head)
        groups.setdefault(tuple(head) if known else None, []).append(f)
    if specs is None:  # one header for all files: the first one's
        head = tuple(_head(spark, next(iter(first)), max(1, skip), delimiter, quote, encoding)[-1])
        groups = {head: list(first)}
    parts = []
    for header, files in groups.items():
        width = len(header) if header else len(specs)
        dropped = skip or (1 if header else 0)
        place = {c.lower(): i for i, c in enumerate(header)} if header else names
        read = spark.read.options(sep=delimiter, quote=quote, escape=quote, encoding=encoding, multiLine=multi, header=dropped == 1, nullValue=null_marker, enforceSchema=True, columnPruning=False)  # else widths are not checked

        def records(w: int, files=files, read=read, dropped=dropped) -> DataFrame:
            fields = [T.StructField(f"c{i}", T.StringType()) for i in range(w)]
            rows = read.option("columnNameOfCorruptRecord", "bad").schema(T.StructType([*fields, T.StructField("bad", T.StringType())])).csv(files)
            if dropped > 1:  # numbered in their file: a load that skips several records sorts each file in one task
                at = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_id", F.monotonically_increasing_id())
                nth = F.row_number().over(Window.partitionBy("_file").orderBy("_block", "_id"))
                rows = at.withColumn("_n", nth).where(F.col("_n") > dropped).drop("_file", "_block", "_id", "_n")
            return rows

        rows = records(width)
        wrong = F.col("bad").isNotNull()
        if jagged:  # a record of too many fields has just one more than expected, or is bad with a value there
            longer = (F.col("bad").isNull() | F.col(f"c{width}").isNotNull())
            if records(width + 1).agg(F.count_if(longer), F.count("c0")).first()[0]:
                raise BadRows(f"a row has more than {width} fields")
            wrong = F.lit(False)
        cells = [F.nullif(F.col(f"c{i}"), F.lit("")) for i in range(width)]
        if specs is None:
            parts.append(rows.select(wrong.alias("_bad"), F.col("c0").alias("_raw"), *[c.alias(f"_{i}") for i, c in enumerate(cells)]))
            title = list(header)
        else:
            out = [(cells[place[s["name"].lower()]] if s["name"].lower() in place else F.lit(None).cast("string")).alias(f"_{i}") for i, s in enumerate(specs)]
            parts.append(rows.select(wrong.alias("_bad"), F.col("c0").alias("_raw"), *out))
    if not parts:  # no file has a line
        return spark.createDataFrame([], schema_of(specs))
    every = functools.reduce(DataFrame.union, parts)
    texts = [F.col(c) for c in every.columns[2:]]
    raw = F.count("_raw").alias("raw")  # Spark wants a column beside that of bad records
    # values are checked before rows are returned, and the casts themselves never fail
    if specs is None:
        empty = lambda c: c.isNull() | (F.lower(c) == "null")
        good = ~F.col("_bad")
        tests = [F.coalesce(F.bool_and(~good | _fits(c, kind) | empty(c)), F.lit(True)).alias(f"{i}_{kind}") for i, c in enumerate(texts) for kind, _ in DETECTED]
        some = [F.count_if(good & ~empty(c)).alias(f"{i}_n") for i, c in enumerate(texts)]
        seen = every.agg(F.count_if("_bad").alias("bad"), raw, *tests, *some).first()
        if seen["bad"] > max_bad:
            raise BadRows(f"{seen['bad']} rows have another number of fields than {len(title)}")
        rows = every.where(good) if seen["bad"] else every
        out = []
        for i, (name, c) in enumerate(zip(title, texts, strict=True)):
            kind = next((k for k, _ in DETECTED if seen[f"{i}_n"] and seen[f"{i}_{k}"]), "STRING")
            value = F.when(~empty(c), c)
            out.append((value if kind == "STRING" else value.try_cast(dict(DETECTED)[kind])).alias(name))
        return rows.select(*out)
    fields = schema_of(specs).fields
    misfits = {f.name: c.isNotNull() & c.try_cast(f.dataType).isNull() for c, f in zip(texts, fields, strict=True) if not isinstance(f.dataType, T.StringType)}
    anything = F.col("_bad") | F.array_contains(F.array(F.lit(False), *misfits.values()), True)
    counts = every.agg(raw, F.count_if(anything).alias("all"), F.count_if("_bad").alias("wide"), *[F.count_if(m).alias(f"m_{n}") for n, m in misfits.items()]).first()
    if counts["all"] > max_bad:
        values = {n: counts[f"m_{n}"] for n in misfits if counts[f"m_{n}"]}
        raise BadRows(f"{counts['wide']} rows have another number of fields than expected; values that do not fit their types: {values}")
    kept = every if not counts["all"] else every.where(~anything)
    return kept.select(*[c.try_cast(f.dataType).alias(f.name, metadata=f.metadata) for c, f in zip(texts, fields, strict=True)])


def load_ndjson(spark: SparkSession, path: str | list[str], specs: list[dict]) -> DataFrame:
    """NDJSON under an existing schema: top-level names match in any case, unknown names are ignored, numbers and texts of numbers are taken alike."""
    values = F.transform_keys(F.from_json("value", "map<string,string>"), lambda k, _: F.lower(k))
    rows = spark.read.text(path).where("trim(value) <> ''").select(values.alias("v"))
    nested = (T.ArrayType, T.StructType)

    def column(f: T.StructField) -> Column:
        text = F.try_element_at("v", F.lit(f.name.lower()))
        return F.from_json(text, f.dataType) if isinstance(f.dataType, nested) else text.cast(f.dataType)

    return rows.select(*[column(f).alias(f.name) for f in schema_of(specs).fields])


def load(spark: SparkSession, path: str | list[str], form: str, specs: list[dict] | None = None, **options) -> DataFrame:
    """A table of files; a path may hold one `*`."""
    for p in [path] if isinstance(path, str) else path:
        if p.count("*") > 1:
            raise ValueError("a path may hold one wildcard")
    kinds = {"CSV": load_csv, "NEWLINE_DELIMITED_JSON": load_ndjson}
    if form in kinds:
        return kinds[form](spark, path, specs, **options)
    if form in ("PARQUET", "ORC"):
        df = spark.read.format(form.lower()).load(path)
        return df if specs is None else df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(specs).fields])
    raise ValueError(f"unsupported source format {form}")


def seed(spark: SparkSession, document: dict) -> dict[str, DataFrame]:
    """Tables of a seed document {projects: [{id, datasets: [{id, tables: [{id, columns, data}]}]}]}, by project.dataset.table."""
    out = {}
    for project in document.get("projects", []):
        for dataset in project.get("datasets", []):
            for t in dataset.get("tables", []):
                of = schema_of(t["columns"])
                rows = [tuple(value_of({k.lower(): v for k, v in r.items()}.get(f.name.lower()), f.dataType, f.metadata) for f in of.fields) for r in t.get("data", [])]
                out[f"{project['id']}.{dataset['id']}.{t['id']}"] = spark.createDataFrame(rows, of)
    return out


def seed_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    import yaml

    with open(path) as f:
        return seed(spark, yaml.safe_load(f))
