"""Every catalogue query against its SQL in DuckDB."""

import duckdb
import pytest

from brindle.plans import catalogue

QUERIES, SQL = catalogue()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    plain = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, folder, name):
    assert rows(QUERIES[name](spark, folder).toArrow()) == rows(duck.sql(SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() >= 1


def test_pushdown(spark, folder, capsys):
    QUERIES["filter_range"](spark, folder).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(l_shipdate" in plan and "ReadSchema" in plan and "l_comment" not in plan
