"""Jobs: queries with an id, states, errors at run time, paging, dry run and cancel; names of one to three parts; scripts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from .catalog import Catalog, NotFound
from .operators.relational import page
from .params import arguments
from .staging import staged
from .types import describe, rest_rows

#: Texts, comments, quoted names, words and single characters of a statement.
LEXEME = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/|`[^`]*`|[^\W\d]\w*|\d[\w.]*|\s+|.", re.DOTALL)
VIEWS = ("SCHEMATA", "TABLES", "COLUMNS", "TABLE_OPTIONS")


def statements(text: str) -> Iterator[str]:
    """The statements of a script; what stands between BEGIN and its END is one."""
    held: list[str] = []
    deep: list[str] = []
    before = ""
    for x in LEXEME.findall(text):
        word = x.upper()
        if word in ("BEGIN", "CASE") and before != "END":
            deep.append(word)
        elif word == "END" and deep:
            deep.pop()
        elif word in ("IF", "WHILE", "LOOP", "FOR", "REPEAT") and before == "END" and deep is not None:
            deep.append("BEGIN")  # END IF and the like close no BEGIN
        if x == ";" and not deep:
            if "".join(held).strip():
                yield "".join(held).strip()
            held = []
        else:
            held.append(x)
        before = word if x.strip() else before
    if "".join(held).strip():
        yield "".join(held).strip()


def _reason(e: Exception) -> dict:
    missing = isinstance(e, KeyError) or "NOT_FOUND" in str(e)
    return {"reason": "notFound" if missing else "invalidQuery", "message": str(e)[:2000]}


@dataclass
class Job:
    """PENDING when analysed, RUNNING and DONE with its rows; an error of either time is kept in `error`."""

    catalog: Catalog
    sql: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    state: str = "PENDING"
    error: dict | None = None
    df: DataFrame | None = None

    def schema(self) -> list[dict]:
        return [describe(f) for f in self.df.schema.fields]

    def run(self, action):
        """Runs an action on the result under the job's tag; its failure is the job's error, and is raised."""
        if self.df is None:
            raise ValueError((self.error or {}).get("message", "the job has no result"))
        spark = self.catalog.spark
        self.state = "RUNNING"
        spark.addTag(self.id)
        try:
            out = action(self.df)
            self.error = None
            return out
        except Exception as e:
            self.error = _reason(e)
            raise
        finally:
            spark.removeTag(self.id)
            self.state = "DONE"

    def wait(self) -> Job:
        """Runs the query for its errors alone; they are in `error` afterwards."""
        try:
            self.run(lambda df: df.write.format("noop").mode("overwrite").save())
        except Exception:
            pass  # kept in self.error
        return self

    def page(self, order: list[str], start: int = 0, size: int = 1000, micros: bool = False) -> tuple[list[dict], str | None]:
        """REST rows of one page of a stable order, and the next page's token."""
        rows, token = self.run(lambda df: page(df, order, start, size))
        return rest_rows(rows, self.df.schema, micros), token

    def result(self) -> list:
        """All rows; for small results."""
        return self.run(DataFrame.collect)

    def cancel(self) -> list[str]:
        return self.catalog.spark.interruptTag(self.id)


class Client:
    """Runs Spark SQL over a catalogue: names resolve in its projects and datasets, parameters are typed, results go where they are asked."""

    def __init__(self, catalog: Catalog, keep: int = 1000):
        self.catalog, self.keep = catalog, keep
        self.jobs: dict[str, Job] = {}

    # names

    def _relations(self, sql: str) -> set[tuple[str, ...]]:
        """The names of relations of more than one part, or of one part with dots in it, as Spark's own parser finds them."""
        try:
            tree = self.catalog.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).treeString()
        except Exception:
            return set()  # the statement itself will tell what is wrong
        found = {tuple(n.split(", ")) for n in re.findall(r"Unresolved(?:Relation|Identifier|Table|TableOrView|View)\w* \[([^\]]+)\]", tree)}
        return {n for n in found if len(n) > 1 or "." in n[0]}

    def resolved(self, sql: str) -> tuple[str, list[str]]:
        """The statement with catalogue names in Spark's form, and temporary views made for INFORMATION_SCHEMA and wildcards."""
        into: dict[tuple[str, ...], str] = {}
        views: list[str] = []

        def view_of(df: DataFrame) -> str:
            views.append(f"_view_{uuid.uuid4().hex}")
            df.createOrReplaceTempView(views[-1])
            return f"`{views[-1]}`"

        for name in self._relations(sql):
            parts = name[0].split(".") if len(name) == 1 else list(name)
            upper = [p.upper() for p in parts]
            if len(parts) >= 2 and upper[-2] == "INFORMATION_SCHEMA" and upper[-1] in VIEWS:
                project = parts[-4] if len(parts) > 3 else None
                into[name] = view_of(self.catalog.information_schema(upper[-1], parts[-3] if len(parts) > 2 else None, project))
            elif parts[-1].endswith("*"):
                into[name] = view_of(self.catalog.table(".".join(parts)))
            elif len(parts) <= 3 and (p := self.catalog.path(".".join(parts)))[:2] in self.catalog.datasets:
                into[name] = self.catalog.spark_name(".".join(p))
        if not into:
            return sql, views
        out, run = [], []

        def flush() -> None:
            end = max((i for i, x in enumerate(run) if x.strip()), default=-1) + 1
            key = tuple(x[1:-1] if x[0] == "`" else x for x in run if x.strip() and x != ".")
            out.extend([into[key], *run[end:]] if key in into else run)
            run.clear()

        for x in LEXEME.findall(sql):
            name = x[0] == "`" or (x[0].isalpha() or x[0] == "_")
            last = next((y for y in reversed(run) if y.strip()), "")
            if name and last in ("", ".") and (run or last == ""):
                run.append(x)
            elif run and (x == "." and last != "." or x.isspace()):
                run.append(x)
            else:
                flush()
                (run if name else out).append(x)
        flush()
        return "".join(out), views

    # jobs

    def query(self, sql: str, parameters: list[dict] | None = None, dry_run: bool = False, destination: str | None = None, disposition: str = "APPEND", create: bool = True) -> Job:
        """A query that cannot be analysed, or whose destination cannot be written, yields a job with an error; a dry run is analysed and not executed."""
        job = Job(self.catalog, sql)
        spark = self.catalog.spark
        if self.catalog.dataset and (self.catalog.project, self.catalog.dataset) in self.catalog.datasets:
            spark.catalog.setCurrentDatabase(self.catalog.database(self.catalog.project, self.catalog.dataset))
        views: list[str] = []
        try:
            temp = re.match(r"\s*CREATE\s+(?:OR\s+REPLACE\s+)?TEMP(?:ORARY)?\s+TABLE\s+`?(\w+)`?\s+AS\s+(.*)", sql, re.IGNORECASE | re.DOTALL)
            text, views = self.resolved(temp[2] if temp else sql)
            if temp and not dry_run:
                staged(spark.sql(text, args=arguments(parameters) if parameters else None), "temporary").createOrReplaceTempView(temp[1])
                job.df = spark.createDataFrame([], "done boolean")
            else:
                job.df = spark.sql(text, args=arguments(parameters) if parameters else None)
            if destination and not dry_run:
                job.run(lambda df: self.catalog.write(destination, df, disposition, create))
            elif not job.df.columns or temp or dry_run:
                job.state = "DONE"
        except (PySparkException, ValueError, KeyError) as e:
            job.state, job.error = "DONE", _reason(e)
        finally:
            for v in views:
                spark.catalog.dropTempView(v)
        if not dry_run:
            self.jobs[job.id] = job
            while len(self.jobs) > self.keep:  # the oldest go
                del self.jobs[next(iter(self.jobs))]
        return job

    def get(self, job_id: str) -> Job:
        try:
            return self.jobs[job_id]
        except KeyError:
            raise NotFound(f"job {job_id}") from None

    def list(self, state: str | None = None) -> list[Job]:
        """Newest first."""
        return [j for j in reversed(self.jobs.values()) if state in (None, j.state)]

    def delete(self, job_id: str) -> None:
        self.get(job_id)
        del self.jobs[job_id]

    def script(self, text: str | list[str]) -> Job | None:
        """Statements in order, up to the first that fails; the last job.  BEGIN .. END blocks are one statement: Spark runs them."""
        job = None
        for s in statements(text) if isinstance(text, str) else text:
            job = self.query(s)
            if job.error is None and job.df is not None and job.state == "PENDING":
                job.wait()
            if job.error:
                break
        return job
