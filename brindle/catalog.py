"""Projects, datasets, tables, views and routines over Spark's catalogue.

`project.dataset.table` is the table `table` of a Spark database named after both; a default project and dataset complete shorter names.
Rows of a table live in snapshot folders under the warehouse: a change of rows writes a new snapshot and moves the table to it, so
readers never see half a change and a failed one leaves nothing behind.  The snapshot before stays for readers that still use it; older ones are removed.

What Spark's catalogue does not keep (kinds, labels, options, routines, where snapshots are) is a JSON file in the warehouse, renamed into place at each
change, from which a later session brings its tables and views back.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.relational import wildcard_union
from .staging import read_text, remove, write_text
from .types import check_name, describe
from .types import schema as schema_of


class NotFound(KeyError):
    pass


class AlreadyExists(ValueError):
    pass


class InUse(ValueError):
    pass


@dataclass
class Entry:
    """What the catalogue keeps of a table or view beside Spark's own metadata."""

    kind: str = "TABLE"  # TABLE, VIEW, MATERIALIZED_VIEW, EXTERNAL, SNAPSHOT
    description: str = ""
    labels: dict[str, str] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)
    partition_by: list[str] = field(default_factory=list)
    cluster_by: list[str] = field(default_factory=list)
    places: list[str] = field(default_factory=list)  # snapshot folders, the current one last
    schema: str = ""
    batches: dict[str, int] = field(default_factory=dict)  # of each stream: the last batch that was written


class Catalog:
    def __init__(self, spark: SparkSession, project: str = "main", dataset: str | None = None, persistent: bool = True):
        self.spark, self.project, self.dataset = spark, project, dataset
        self.entries: dict[tuple[str, str, str], Entry] = {}
        self.datasets: dict[tuple[str, str], dict] = {}
        self.routines: dict[tuple[str, str, str], dict] = {}
        self.persistent = persistent
        if persistent:
            self._load()

    # what outlives a session

    def _root(self) -> str:
        return self.spark.conf.get("spark.sql.warehouse.dir").rstrip("/")

    def _file(self) -> str:
        return f"{self._root()}/brindle-catalog.json"

    def save(self) -> None:
        if not self.persistent:
            return
        rows = lambda found, of: [[list(k), of(v)] for k, v in found.items()]
        kept = {"datasets": rows(self.datasets, dict), "entries": rows(self.entries, asdict), "routines": rows(self.routines, dict)}
        write_text(self.spark, self._file(), json.dumps(kept))

    def _load(self) -> None:
        text = read_text(self.spark, self._file())
        if text is None:
            return
        kept = json.loads(text)
        for key, metadata in kept["datasets"]:
            self.datasets[tuple(key)] = metadata
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database(*key)}`")
        self.entries = {tuple(k): Entry(**e) for k, e in kept["entries"]}
        self.routines = {tuple(k): r for k, r in kept["routines"]}
        later = []
        for key, e in self.entries.items():
            if self.spark.catalog.tableExists(f"{self.database(*key[:2])}.{key[2]}"):
                continue
            if e.kind in ("VIEW", "MATERIALIZED_VIEW"):
                later.append((key, e))
            else:
                self._register(key, e)
        while later:  # a view may need another one
            rest = []
            for key, e in later:
                try:
                    self.spark.sql(f"CREATE OR REPLACE VIEW `{self.database(*key[:2])}`.`{key[2]}` AS {e.options['query']}")
                except Exception as error:
                    rest.append((key, e, error))
            if len(rest) == len(later):
                raise rest[0][2]
            later = [x[:2] for x in rest]
        for key, r in self.routines.items():
            self._make_routine(key, r)

    def _register(self, p: tuple[str, str, str], e: Entry) -> None:
        of = T.StructType.fromJson(json.loads(e.schema))
        own = {"recursiveFileLookup": "true"}  # batches of streams are folders inside a snapshot
        options = {k: v for k, v in e.options.items() if k != "form"} if e.kind == "EXTERNAL" else own
        self.spark.catalog.createTable(f"{self.database(*p[:2])}.{p[2]}", path=e.places[-1], source=e.options.get("form", "parquet"), schema=of, **options)

    # names

    def path(self, name: str) -> tuple[str, str, str]:
        """(project, dataset, table) of a 1-, 2- or 3-part name."""
        parts = [check_name(p) for p in name.strip("`").replace("`.`", ".").split(".")]
        if len(parts) > 3:
            raise ValueError(f"{name!r} has more than three parts")
        if len(parts) == 1 and not self.dataset:
            raise ValueError(f"{name!r} needs a dataset")
        return (*(self.project, self.dataset)[: 3 - len(parts)], *parts)

    def database(self, project: str, dataset: str) -> str:
        """One name for each pair: characters but a-z and 0-9 are written as their code between underscores, and 0 parts the two."""
        plain = lambda name: re.sub("[^a-z0-9]", lambda m: f"_{ord(m[0]):x}_", name)
        return f"{plain(project)}_0_{plain(dataset)}"

    def spark_name(self, name: str) -> str:
        p, d, t = self.path(name)
        return f"`{self.database(p, d)}`.`{t}`"

    # datasets

    def create_dataset(self, dataset: str, project: str | None = None, exists_ok: bool = False, **metadata) -> None:
        key = (project or self.project, check_name(dataset))
        if key in self.datasets:
            if exists_ok:
                return
            raise AlreadyExists(f"dataset {dataset}")
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database(*key)}`")
        self.datasets[key] = metadata
        self.save()

    def _dataset(self, dataset: str, project: str | None) -> tuple[str, str]:
        key = (project or self.project, dataset)
        if key not in self.datasets:
            raise NotFound(f"dataset {dataset}")
        return key

    def get_dataset(self, dataset: str, project: str | None = None) -> dict:
        key = self._dataset(dataset, project)
        return {"project": key[0], "dataset": key[1], **self.datasets[key]}

    def list_datasets(self, project: str | None = None) -> list[dict]:
        return [self.get_dataset(d, p) for p, d in sorted(self.datasets) if p == (project or self.project)]

    def patch_dataset(self, dataset: str, project: str | None = None, **metadata) -> None:
        self.datasets[self._dataset(dataset, project)] |= metadata
        self.save()

    def drop_dataset(self, dataset: str, project: str | None = None, delete_contents: bool = False) -> None:
        key = self._dataset(dataset, project)
        own = [k for k in self.entries if k[:2] == key]
        if own and not delete_contents:
            raise InUse(f"dataset {dataset} is not empty")
        for k in own:
            self._forget(k)
        self.spark.sql(f"DROP DATABASE `{self.database(*key)}` CASCADE")
        self.routines = {k: r for k, r in self.routines.items() if k[:2] != key}
        del self.datasets[key]
        self.save()

    # tables

    def _new(self, name: str, replace: bool) -> tuple[str, str, str]:
        p = self.path(name)
        if p[:2] not in self.datasets:
            raise NotFound(f"dataset {p[1]}")
        if p in self.entries and not replace:
            raise AlreadyExists(name)
        if p in self.entries:
            self.drop(name)
        return p

    def _store(self, p: tuple[str, str, str], df: DataFrame, e: Entry) -> None:
        """Writes df as a new snapshot and points the table to it."""
        place = f"{self._root()}/{self.database(*p[:2])}/{p[2]}/{uuid.uuid4().hex}"
        if order := [*e.partition_by, *e.cluster_by]:  # row groups of few values each, which scans skip by their statistics
            df = df.repartitionByRange(*[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
        df.write.parquet(place)
        target = f"`{self.database(*p[:2])}`.`{p[2]}`"
        e.schema = df.schema.json()
        e.places.append(place)
        if self.spark.catalog.tableExists(f"{self.database(*p[:2])}.{p[2]}"):
            self.spark.sql(f"ALTER TABLE {target} SET LOCATION '{place}'")
            self.spark.catalog.refreshTable(target)
        else:
            self._register(p, e)
        self.entries[p] = e
        while len(e.places) > 2:
            remove(self.spark, e.places.pop(0))
        self.save()

    def create_table(self, name: str, specs: list[dict] | T.StructType, replace: bool = False, **metadata) -> None:
        p = self._new(name, replace)
        of = specs if isinstance(specs, T.StructType) else schema_of(specs)
        self._store(p, self.spark.createDataFrame([], of), Entry("TABLE", **metadata))

    def copy(self, name: str, to: str, disposition: str = "EMPTY") -> None:
        """The rows of a table now, under another name; later changes of either do not touch the other."""
        self.write(to, self.table(name), disposition)

    def snapshot(self, name: str, to: str) -> None:
        """A copy that refuses writes."""
        p = self._new(to, False)
        self._store(p, self.table(name), Entry("SNAPSHOT"))

    def create_view(self, name: str, sql: str, replace: bool = False, materialized: bool = False) -> None:
        """A view over Spark SQL; a materialized one is served as a plain view."""
        p = self._new(name, replace)
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.spark_name(name)} AS {sql}")
        self.entries[p] = Entry("MATERIALIZED_VIEW" if materialized else "VIEW", options={"query": sql})
        self.save()

    def create_external(self, name: str, path: str, form: str = "PARQUET", specs: list[dict] | None = None, **options: str) -> None:
        """A table over files where they are: each query reads what they hold then.  Options are those of Spark's reader."""
        p = self._new(name, False)
        kind = {"CSV": "csv", "NEWLINE_DELIMITED_JSON": "json", "PARQUET": "parquet", "ORC": "orc"}[form]
        if specs is None:
            of = self.spark.read.format(kind).options(**({"inferSchema": "true"} if kind == "csv" else {}), **options).load(path).schema
        else:
            of = schema_of(specs)
        e = Entry("EXTERNAL", options={"form": kind, **options}, places=[path], schema=of.json())
        self._register(p, e)
        self.entries[p] = e
        self.save()

    def entry(self, name: str) -> Entry:
        try:
            return self.entries[self.path(name)]
        except KeyError:
            raise NotFound(name) from None

    def table(self, name: str) -> DataFrame:
        """A table or view; a name that ends in * is the union of the tables it matches, with `_table_suffix`."""
        p = self.path(name)
        if p[2].endswith("*"):
            prefix = p[2][:-1]
            own = {k[2]: self.spark.table(f"`{self.database(*k[:2])}`.`{k[2]}`") for k, e in self.entries.items() if k[:2] == p[:2] and k[2].startswith(prefix) and e.kind == "TABLE"}
            return wildcard_union(own, prefix)
        self.entry(name)
        return self.spark.table(self.spark_name(name))

    @staticmethod
    def _fitted(df: DataFrame, of: T.StructType) -> DataFrame:
        """df under the columns of a table: names match in any case, missing columns are null."""
        have = {c.lower() for c in df.columns}
        value = lambda f: F.col(f"`{f.name}`").cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
        return df.select(*[value(f).alias(f.name, metadata=f.metadata) for f in of.fields])

    def write(self, name: str, df: DataFrame, disposition: str = "APPEND", create: bool = True) -> None:
        """APPEND, TRUNCATE or EMPTY (an error if there are rows); a missing table is created unless create is False."""
        p = self.path(name)
        if p not in self.entries:
            if not create:
                raise NotFound(name)
            self.create_table(name, df.schema)
        e, target = self.entries[p], self.table(name)
        if e.kind != "TABLE":
            raise ValueError(f"{name} is a {e.kind} and takes no rows")
        fitted = self._fitted(df, target.schema)
        if disposition == "EMPTY" and not target.isEmpty():
            raise AlreadyExists(f"{name} has rows")
        if disposition == "TRUNCATE":
            self._store(p, fitted, e)
        elif disposition in ("APPEND", "EMPTY"):
            fitted.write.insertInto(self.spark_name(name))
            self.spark.catalog.refreshTable(self.spark_name(name))  # df may belong to another session, as a micro-batch does
        else:
            raise ValueError(f"unknown disposition {disposition}")

    def write_batch(self, name: str, df: DataFrame, stream: str, batch: int) -> None:
        """Appends a stream's micro-batch once: a batch has a folder of its own in the snapshot, which a replay overwrites, and the catalogue
        keeps the last number of each stream, so that a batch from before a change of rows is not written again."""
        p = self.path(name)
        if p not in self.entries:
            self.create_table(name, df.schema)
        e, target = self.entries[p], self.table(name)
        if e.batches.get(stream, -1) >= batch:
            return
        self._fitted(df, target.schema).write.mode("overwrite").parquet(f"{e.places[-1]}/{stream}-{batch}")
        df.sparkSession.catalog.refreshTable(self.spark_name(name))
        self.spark.catalog.refreshTable(self.spark_name(name))
        e.batches[stream] = batch
        self.save()

    def replace_rows(self, name: str, df: DataFrame) -> None:
        """The rows of df, which may read the table itself, in place of the table's."""
        self.write(name, df, "TRUNCATE", create=False)

    def patch(self, name: str, **metadata) -> None:
        """Metadata only; rows and columns stay."""
        e = self.entry(name)
        for k, v in metadata.items():
            if k not in ("description", "labels", "options"):
                raise ValueError(f"{k} cannot be patched")
            setattr(e, k, v)
        self.save()

    def drop(self, name: str, missing_ok: bool = False) -> None:
        p = self.path(name)
        if p not in self.entries:
            if missing_ok:
                return
            raise NotFound(name)
        self._forget(p)
        self.save()

    def _forget(self, p: tuple[str, str, str]) -> None:
        e = self.entries.pop(p)
        view = e.kind in ("VIEW", "MATERIALIZED_VIEW")
        self.spark.sql(f"DROP {'VIEW' if view else 'TABLE'} IF EXISTS `{self.database(*p[:2])}`.`{p[2]}`")
        for place in e.places if e.kind in ("TABLE", "SNAPSHOT") else ():
            remove(self.spark, place)

    def tables(self, dataset: str, project: str | None = None) -> list[dict]:
        key = (project or self.project, dataset)
        return [{"table": k[2], "type": e.kind} for k, e in sorted(self.entries.items()) if k[:2] == key]

    def fields(self, name: str) -> list[dict]:
        return [describe(f) for f in self.table(name).schema.fields]

    # information schema

    def information_schema(self, view: str, dataset: str | None = None, project: str | None = None) -> DataFrame:
        """SCHEMATA, TABLES, TABLE_OPTIONS or COLUMNS, as a table of catalogue metadata."""
        project = project or self.project
        own = [(k, e) for k, e in sorted(self.entries.items()) if k[0] == project and (dataset is None or k[1] == dataset)]
        if view == "SCHEMATA":
            return self.spark.createDataFrame([k for k in sorted(self.datasets) if k[0] == project], "catalog_name string, schema_name string")
        if view == "TABLES":
            names = {"TABLE": "BASE TABLE", "VIEW": "VIEW", "MATERIALIZED_VIEW": "MATERIALIZED VIEW", "EXTERNAL": "EXTERNAL", "SNAPSHOT": "SNAPSHOT"}
            return self.spark.createDataFrame([(*k, names[e.kind]) for k, e in own], "table_catalog string, table_schema string, table_name string, table_type string")
        if view == "TABLE_OPTIONS":
            rows = [(*k, n, v) for k, e in own for n, v in sorted((e.options | e.labels).items())]
            return self.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, option_name string, option_value string")
        if view == "COLUMNS":
            rows = []
            for k, _ in own:
                for i, f in enumerate(self.table(".".join(k)).schema.fields):
                    d = describe(f)
                    kind = f"ARRAY<{d['type']}>" if d["mode"] == "REPEATED" else d["type"]
                    rows.append((*k, f.name, i + 1, "NO" if d["mode"] == "REQUIRED" else "YES", kind))
            of = "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position long, is_nullable string, data_type string"
            return self.spark.createDataFrame(rows, of)
        raise NotFound(view)

    # routines

    def _make_routine(self, key: tuple[str, str, str], r: dict) -> None:
        args = ", ".join(f"`{check_name(a)}` {t}" for a, t in r["arguments"])
        name = f"`{self.database(*key[:2])}`.`{key[2]}`"
        if r["kind"] == "FUNCTION":
            of = f" RETURNS {r['returns']}" if r.get("returns") else ""
            self.spark.sql(f"CREATE OR REPLACE FUNCTION {name}({args}){of} RETURN {r['body']}")
        elif r["kind"] == "TABLE_FUNCTION":
            self.spark.sql(f"CREATE OR REPLACE FUNCTION {name}({args}) RETURNS TABLE({r['returns']}) RETURN {r['body']}")

    def create_function(self, name: str, arguments: list[tuple[str, str]], body: str, returns: str | None = None, temporary: bool = True) -> None:
        """A SQL function: Spark inlines its expression, so plans see through it."""
        if temporary:
            args = ", ".join(f"`{check_name(a)}` {t}" for a, t in arguments)
            of = f" RETURNS {returns}" if returns else ""
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `{check_name(name)}`({args}){of} RETURN {body}")
            return
        self._keep(name, {"kind": "FUNCTION", "arguments": [list(a) for a in arguments], "body": body, "returns": returns})

    def create_table_function(self, name: str, arguments: list[tuple[str, str]], columns: str, query: str, temporary: bool = True) -> None:
        if temporary:
            args = ", ".join(f"`{check_name(a)}` {t}" for a, t in arguments)
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `{check_name(name)}`({args}) RETURNS TABLE({columns}) RETURN {query}")
            return
        self._keep(name, {"kind": "TABLE_FUNCTION", "arguments": [list(a) for a in arguments], "body": query, "returns": columns})

    def create_procedure(self, name: str, arguments: list[tuple[str, str]], statements: str) -> None:
        """A procedure: a BEGIN .. END body of Spark's SQL scripting, whose arguments are variables."""
        self._keep(name, {"kind": "PROCEDURE", "arguments": [list(a) for a in arguments], "body": statements, "returns": None})

    def call(self, name: str, *values) -> DataFrame:
        """Runs a procedure: the result of its last statement."""
        r = self.routine(name)
        if r["kind"] != "PROCEDURE" or len(values) != len(r["arguments"]):
            raise ValueError(f"{name} takes {len(r['arguments'])} arguments")
        given = {f"_{i}": F.lit(v) for i, v in enumerate(values)}
        declared = " ".join(f"DECLARE `{check_name(a)}` {t} DEFAULT :_{i};" for i, (a, t) in enumerate(r["arguments"]))
        body = re.sub(r"^\s*BEGIN\b|\bEND\s*;?\s*$", "", r["body"], flags=re.IGNORECASE)
        return self.spark.sql(f"BEGIN {declared} {body} END", args=given or None)

    def _keep(self, name: str, r: dict) -> None:
        key = self.path(name)
        if key[:2] not in self.datasets:
            raise NotFound(f"dataset {key[1]}")
        self._make_routine(key, r)
        self.routines[key] = r
        self.save()

    def routine(self, name: str) -> dict:
        try:
            return self.routines[self.path(name)]
        except KeyError:
            raise NotFound(name) from None

    def list_routines(self, dataset: str, project: str | None = None) -> list[dict]:
        return [{"routine": k[2], "kind": r["kind"]} for k, r in sorted(self.routines.items()) if k[:2] == (project or self.project, dataset)]

    def drop_routine(self, name: str) -> None:
        key, r = self.path(name), self.routine(name)
        if r["kind"] != "PROCEDURE":
            self.spark.sql(f"DROP FUNCTION IF EXISTS `{self.database(*key[:2])}`.`{key[2]}`")
        del self.routines[key]
        self.save()

    # seeds

    def reconcile(self, tables: dict[str, DataFrame]) -> list[str]:
        """Brings seed tables in: those that are missing are created with their rows, those that are there keep theirs.  Returns the names created."""
        made = []
        for name, df in tables.items():
            p = self.path(name)
            self.create_dataset(p[1], p[0], exists_ok=True)
            if p not in self.entries:
                self._store(p, df, Entry("TABLE"))
                made.append(name)
        return made
