"""Types, parameters, loads, extracts, catalogue, row changes, ingest, jobs."""

import datetime as dt
import glob
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brindle import dml
from brindle.catalog import AlreadyExists, Catalog, InUse, NotFound
from brindle.ingest import StreamError, WriteStream, batch_commit, insert_all, read_rows
from brindle.jobs import Client
from brindle.sources.extract import export_data, extract
from brindle.sources.load import BadRows, load, load_csv, load_ndjson, seed
from brindle.types import cell, describe, field, kind_of, normalised, parse_timestamp, rest_rows
from brindle.types import schema as schema_of

PEOPLE = [{"name": "id", "type": "INTEGER"}, {"name": "name", "type": "STRING"}]


@pytest.fixture
def catalog(spark, request):
    c = Catalog(spark, "p", "d" + str(abs(hash(request.node.name)) % 10**8))
    c.create_dataset(c.dataset)
    yield c
    c.drop_dataset(c.dataset, delete_contents=True)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_types():
    assert kind_of("integer") == "INT64" and kind_of("Decimal") == "NUMERIC"
    with pytest.raises(ValueError):
        kind_of("nonsense")
    with pytest.raises(ValueError):
        field({"name": "a`b", "type": "STRING"})
    f = field({"name": "r", "type": "RECORD", "mode": "REPEATED", "fields": [{"name": "x", "type": "JSON"}]})
    assert describe(f) == {"name": "r", "mode": "REPEATED", "type": "RECORD", "fields": [{"name": "x", "mode": "NULLABLE", "type": "JSON"}]}
    of = schema_of([{"name": "Id", "type": "INT64"}, {"name": "tags", "type": "STRING", "mode": "REPEATED"}, {"name": "at", "type": "TIMESTAMP"}])
    assert normalised({"ID": "7", "x": 1}, of) == ({"Id": 7, "tags": [], "at": None}, ["x"])
    at = parse_timestamp("1969-12-31 23:59:59.5 UTC")
    assert rest_rows([(1, None, at)], of) == [{"f": [{"v": "1"}, {"v": []}, {"v": "-1.500000"}]}]
    assert cell(Decimal("3.500000000"), schema_of([{"name": "n", "type": "NUMERIC"}])["n"].dataType) == {"v": "3.5"}


def test_csv(spark, tmp_path):
    def file(text):
        p = tmp_path / f"{len(list(tmp_path.iterdir()))}.csv"
        p.write_text(text)
        return str(p)

    found = load_csv(spark, file("id,name,weight\n1,wren,2.25\n2,kite,6\n"), autodetect=True, skip=1)
    assert [t for _, t in found.dtypes] == ["bigint", "string", "double"] and rows(found) == [(1, "wren", 2.25), (2, "kite", 6.0)]
    assert rows(load_csv(spark, file("keeper;years\nMona;51\nTariq;17\n"), autodetect=True, delimiter=";")) == [("Mona", 51), ("Tariq", 17)]
    spec = [{"name": "Keeper", "type": "STRING"}, {"name": "Years", "type": "INT64"}]
    assert rows(load_csv(spark, file("Mona,51\nTariq,17\n"), spec)) == [("Mona", 51), ("Tariq", 17)]
    assert rows(load_csv(spark, file("years,keeper\n51,Mona\n"), spec)) == [("Mona", 51)]
    assert rows(load_csv(spark, file("measured in spring\nMona,51\n"), spec, skip=1)) == [("Mona", 51)]
    assert load_csv(spark, file("Mona,51\nTariq\n"), spec, jagged=True).where("keeper = 'Tariq'").first()[1] is None
    with pytest.raises(BadRows):
        load_csv(spark, file("Mona,51\nLonely\n"), spec)
    with pytest.raises(BadRows):
        load_csv(spark, file("Mona,51,x\n"), spec, jagged=True)
    quoted = load_csv(spark, file('a,b\n"x, ""y""",true\nnull,false\n'), autodetect=True)
    assert quoted.dtypes == [("a", "string"), ("b", "boolean")] and rows(quoted.where("b")) == [('x, "y"', True)]
    with pytest.raises(ValueError):
        load(spark, "/x/*/*.csv", "CSV", spec)
    with pytest.raises(ValueError):
        load(spark, "/x", "AVRO")


def test_ndjson_and_extract(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ID":1,"Name":"Olga","more":1}\n{"id":2,"name":"Pavel"}\n')
    df = load_ndjson(spark, str(tmp_path / "a.json"), PEOPLE)
    assert rows(df) == [(1, "Olga"), (2, "Pavel")]
    extract(df, str(tmp_path / "csv"), header=True)
    text = "".join(open(f).read() for f in glob.glob(f"{tmp_path}/csv/*.csv"))
    assert text.startswith("id,name\n") and "2,Pavel" in text
    extract(df, str(tmp_path / "js"), "NEWLINE_DELIMITED_JSON")
    assert '{"id":"1","name":"Olga"}' in "".join(open(f).read() for f in glob.glob(f"{tmp_path}/js/*.json"))
    out = export_data(df.coalesce(1), f"{tmp_path}/x-*.json", "JSON")
    assert len(out) == 1 and out[0].endswith("x-000000000000.json") and '{"id":1,"name":"Olga"}' in open(f"{tmp_path}/x-000000000000.json").read()
    with pytest.raises(ValueError):
        export_data(df, f"{tmp_path}/none.json")
    assert rows(load(spark, str(tmp_path / "js"), "NEWLINE_DELIMITED_JSON", PEOPLE))[0] == (1, "Olga")


def test_seed(spark):
    document = {"projects": [{"id": "p", "datasets": [{"id": "d", "tables": [{"id": "t", "columns": [
        {"name": "id", "type": "INTEGER", "mode": "REQUIRED"}, {"name": "a", "type": "STRUCT", "mode": "REPEATED", "fields": [{"name": "k", "type": "STRING"}, {"name": "v", "type": "JSON"}]},
        {"name": "n", "type": "NUMERIC"}, {"name": "born", "type": "DATE"}], "data": [{"ID": 1, "a": [{"k": "x", "v": {"depth": 4}}], "n": 3, "born": "1987-09-30"}]}]}]}]}
    r = seed(spark, document)["p.d.t"].first()
    assert (r.id, r.a[0].v, r.n, r.born) == (1, '{"depth":4}', Decimal(3), dt.date(1987, 9, 30))


def test_catalog(spark, catalog):
    catalog.create_table("people", PEOPLE)
    with pytest.raises(AlreadyExists):
        catalog.create_table("people", PEOPLE)
    with pytest.raises(NotFound):
        catalog.table("nobody")
    catalog.write("people", spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"))
    catalog.create_view("v", f"SELECT id FROM {catalog.spark_name('people')} WHERE id > 1")
    assert rows(catalog.table(f"p.{catalog.dataset}.v")) == [(2,)]
    with pytest.raises(AlreadyExists):
        catalog.write("people", catalog.table("people"), "EMPTY")
    catalog.write("people", spark.createDataFrame([("c", 3)], "NAME string, ID long"), "TRUNCATE")
    assert rows(catalog.table("people")) == [(3, "c")]
    with pytest.raises(NotFound):
        catalog.write("other", catalog.table("people"), create=False)
    assert rows(catalog.information_schema("COLUMNS").where("table_name = 'people'").select("column_name", "ordinal_position", "data_type")) == [("id", 1, "INTEGER"), ("name", 2, "STRING")]
    assert rows(catalog.information_schema("TABLES").select("table_name", "table_type")) == [("people", "BASE TABLE"), ("v", "VIEW")]
    with pytest.raises(InUse):
        catalog.drop_dataset(catalog.dataset)
    catalog.create_table("log_1", PEOPLE)
    catalog.create_table("log_2", [*PEOPLE, {"name": "x", "type": "BOOL"}])
    catalog.write("log_1", spark.createDataFrame([(1, "a")], "id long, name string"))
    catalog.write("log_2", spark.createDataFrame([(2, "b", True)], "id long, name string, x boolean"))
    assert rows(catalog.table("log_*").select("id", "x", "_table_suffix").fillna(False)) == [(1, False, "1"), (2, True, "2")]
    catalog.drop("v")
    catalog.create_function("plus", [("a", "BIGINT"), ("b", "BIGINT")], "a + b")
    assert spark.sql("SELECT plus(1, 2)").first()[0] == 3


def test_rows_change(spark, catalog):
    catalog.create_table("t", PEOPLE)
    catalog.write("t", spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, name string"))
    dml.delete(catalog, "t", F.col("name") == "a")
    dml.update(catalog, "t", {"name": F.lit("z")}, F.col("id") == 2)
    assert rows(catalog.table("t")) == [(2, "z"), (3, "c")]
    source = spark.createDataFrame([(3, "new"), (4, "d")], "id long, name string")
    dml.merge(catalog, "t", source, ["id"], update={"name": F.col("s.name")}, insert={"id": F.col("s.id"), "name": F.col("s.name")}, delete_unmatched=True)
    assert rows(catalog.table("t")) == [(3, "new"), (4, "d")]
    with pytest.raises(dml.DuplicateMatch):
        dml.merge(catalog, "t", source.union(source), ["id"])
    dml.truncate(catalog, "t")
    assert catalog.table("t").count() == 0


def test_ingest(spark, catalog):
    catalog.create_table("t", [{"name": "id", "type": "INT64"}, {"name": "data", "type": "JSON"}, {"name": "tags", "type": "INT64", "mode": "REPEATED"}])
    errors = insert_all(catalog, "t", [{"ID": "1", "data": {"name": "Bob"}}, {"id": 2, "none": 1}, {"id": "x"}])
    assert [e["index"] for e in errors] == [1, 2] and [tuple(r) for r in catalog.table("t").collect()] == [(1, '{"name":"Bob"}', [])]
    p = WriteStream(catalog, "t", "PENDING")
    counts = []
    for n in (1, 3, 2):
        p.append([{"id": 1}] * n)
        counts.append(catalog.table("t").count())
    p.finalize()
    batch_commit([p])
    assert counts == [1, 1, 1] and catalog.table("t").count() == 7
    with pytest.raises(StreamError):
        batch_commit([p])
    with pytest.raises(StreamError):
        p.append([{"id": 1}])
    b = WriteStream(catalog, "t", "BUFFERED")
    b.append([{"id": i} for i in range(5)], offset=0)
    assert (b.flush(1), b.flush(1), b.flush(4)) == (2, 2, 5) and catalog.table("t").count() == 12
    with pytest.raises(StreamError):
        b.append([{"id": 1}], offset=2)
    WriteStream(catalog, "t").append([{"id": 9}])
    assert read_rows(catalog, "t", ["tags", "id"], "id = 9").toArrow().to_pylist() == [{"tags": [], "id": 9}]


def test_jobs(spark, catalog):
    catalog.create_table("t", PEOPLE)
    catalog.write("t", spark.createDataFrame([(i, str(i)) for i in range(5)], "id long, name string"))
    client = Client(catalog)
    job = client.query("SELECT * FROM t WHERE id >= :low", [{"name": "low", "parameterType": {"type": "INT64"}, "parameterValue": {"value": "1"}}])
    first, token = job.page(["id"], 0, 3)
    assert [r["f"][0]["v"] for r in first] == ["1", "2", "3"] and token == "3" and job.page(["id"], int(token), 3)[1] is None
    assert client.query("SELECT * FROM nothing").error["reason"] == "notFound"
    dry = client.query("SELECT id FROM t", dry_run=True, destination="out")
    assert dry.schema() == [{"name": "id", "mode": "NULLABLE", "type": "INTEGER"}] and dry.id not in client.jobs
    client.query("SELECT id, name FROM t", destination="out")
    client.query("SELECT id, name FROM t WHERE id = 0", destination="out", disposition="TRUNCATE")
    assert rows(catalog.table("out")) == [(0, "0")]
    assert client.script(["CREATE OR REPLACE TEMPORARY FUNCTION inc(x BIGINT) RETURN x + 1", "SELECT inc(41)"]).result()[0][0] == 42
    assert client.query("SELECT CAST(NULL AS ARRAY<STRING>) AS a").page(["a"])[0] == [{"f": [{"v": []}]}]
    empty = [{"name": "x", "parameterType": {"type": "INT64"}, "parameterValue": {"value": ""}}]
    assert client.query("SELECT :x IS NULL", empty).result()[0][0] is True
