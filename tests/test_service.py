"""What a client of the warehouse relies on: names, sessions, streams that fail and come again, jobs, loads and exports."""

import pytest
from pyspark.sql import functions as F

from brindle import dml
from brindle.catalog import AlreadyExists, Catalog, InUse, NotFound
from brindle.ingest import StreamError, WriteStream, batch_commit
from brindle.jobs import Client, statements
from brindle.operators.relational import asof_join, group_percentiles, places, ranked
from brindle.sources.extract import export_data
from brindle.sources.load import BadRows, load_csv, seed
from brindle.streaming.sinks import into_table

PAIR = [{"name": "id", "type": "INT64"}, {"name": "word", "type": "STRING"}]


@pytest.fixture
def catalog(spark, request):
    c = Catalog(spark, "shop-eu", "d" + str(abs(hash(request.node.name)) % 10**8))
    c.create_dataset(c.dataset)
    yield c
    for project, dataset in list(c.datasets):
        c.drop_dataset(dataset, project, delete_contents=True)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def pairs(spark, *values):
    return spark.createDataFrame(list(values), "id long, word string")


# names


def test_databases_do_not_meet(spark, catalog):
    names = [("a-b", "c"), ("a_b", "c"), ("a", "b_c"), ("a_b", "C"), ("a_0_b", "c"), ("a", "0_b_0_c"), ("a_", "c"), ("a", "_c")]
    assert len({catalog.database(*n) for n in names}) == len(names)
    for i, (project, dataset) in enumerate(names[:2]):
        catalog.create_dataset(dataset, project)
        catalog.create_table(f"{project}.{dataset}.t", PAIR if i else PAIR[:1])
        catalog.write(f"{project}.{dataset}.t", pairs(spark, (i, "x")))
    assert [catalog.table(f"{p}.{d}.t").columns for p, d in names[:2]] == [["id"], ["id", "word"]]
    assert [rows(catalog.table(f"{p}.{d}.t").select("id")) for p, d in names[:2]] == [[(0,)], [(1,)]]


def test_names_of_one_to_three_parts(spark, catalog):
    d = catalog.dataset
    catalog.create_dataset("other", "shop_eu")
    catalog.create_table("t", PAIR)
    catalog.write("t", pairs(spark, (1, "here")))
    catalog.create_table("shop_eu.other.t", PAIR)
    catalog.write("shop_eu.other.t", pairs(spark, (2, "there")))
    for i in (1, 2):
        catalog.create_table(f"log_{i}", PAIR)
        catalog.write(f"log_{i}", pairs(spark, (i, "log")))
    run = lambda sql: rows(spark.createDataFrame(Client(catalog).query(sql).result() or [(None,)]))
    assert run("SELECT word FROM t") == run(f"SELECT word FROM {d}.t") == run(f"SELECT word FROM `shop-eu`.{d}.t") == run(f"SELECT word FROM `shop-eu.{d}.t`") == [("here",)]
    assert run(f"WITH t AS (SELECT 'x' AS word) SELECT a.word, b.word AS w FROM t a, shop_eu.other.t b, (SELECT * FROM {d} . t) c WHERE b.word <> 'shop_eu.other.t' -- {d}.t") == [("x", "there")]
    assert run(f"SELECT count(*) AS n FROM `{d}.log_*` WHERE _table_suffix = '2'") == [(1,)]
    assert run(f"SELECT table_name FROM {d}.INFORMATION_SCHEMA.TABLES WHERE table_name = 't'") == [("t",)]
    assert run(f"SELECT (SELECT max(id) FROM shop_eu.other.t) AS m FROM {d}.t WHERE id IN (SELECT id FROM {d}.log_1)") == [(2,)]
    assert Client(catalog).query(f"SELECT * FROM {d}.none").error["reason"] == "notFound"
    assert Client(catalog).query(f"INSERT INTO {d}.t VALUES (3, 'new')").error is None and catalog.table("t").count() == 2


# what outlives a session


def test_catalogue_comes_back(spark, catalog):
    catalog.create_table("t", [*PAIR, {"name": "data", "type": "JSON"}], labels={"team": "x"}, cluster_by=["id"])
    catalog.write("t", spark.createDataFrame([(i, "w", None) for i in range(20)], "id long, word string, data string"))
    catalog.create_view("v", f"SELECT id FROM {catalog.spark_name('t')} WHERE id < 5")
    catalog.create_view("vv", f"SELECT id + 1 AS id FROM {catalog.spark_name('v')}")
    catalog.create_function("twice", [("x", "BIGINT")], "x * 2", temporary=False)
    catalog.create_procedure("add", [("x", "INT"), ("y", "INT")], "BEGIN DECLARE z INT; SET z = x + y; SELECT z AS total; END")
    for name in ("vv", "v", "t"):
        spark.sql(f"DROP {'TABLE' if name == 't' else 'VIEW'} {catalog.spark_name(name)}")
    again = Catalog(spark, catalog.project, catalog.dataset)
    assert again.table("t").count() == 20 and rows(again.table("vv")) == [(i,) for i in range(1, 6)]
    assert again.entry("t").labels == {"team": "x"} and [f["type"] for f in again.fields("t")] == ["INTEGER", "STRING", "JSON"]
    assert again.call("add", 2, 3).first().total == 5 and {r["routine"] for r in again.list_routines(again.dataset)} == {"twice", "add"}
    document = {"projects": [{"id": catalog.project, "datasets": [{"id": catalog.dataset, "tables": [{"id": n, "columns": PAIR, "data": [{"id": 7, "word": "seed"}]} for n in ("t", "fresh")]}]}]}
    assert again.reconcile(seed(spark, document)) == [f"{catalog.project}.{catalog.dataset}.fresh"]
    assert again.table("t").count() == 20 and rows(again.table("fresh")) == [(7, "seed")]
    with pytest.raises(NotFound):
        again.routine("none")
    again.drop_routine("add")
    catalog.entries, catalog.datasets, catalog.routines = again.entries, again.datasets, again.routines


def test_tables_as_resources(spark, catalog, tmp_path):
    catalog.create_table("t", PAIR)
    catalog.write("t", pairs(spark, (1, "a"), (2, "b")))
    catalog.copy("t", "c")
    catalog.snapshot("t", "s")
    dml.delete(catalog, "t", F.col("id") == 1)
    assert [rows(catalog.table(n).select("id")) for n in "tcs"] == [[(2,)], [(1,), (2,)], [(1,), (2,)]]
    with pytest.raises(ValueError):
        catalog.write("s", pairs(spark, (3, "c")))
    with pytest.raises(AlreadyExists):
        catalog.copy("t", "c")
    for i in range(4):
        catalog.replace_rows("t", pairs(spark, (i, "n")))
    assert len(catalog.entry("t").places) == 2 and rows(catalog.table("t")) == [(3, "n")]
    pairs(spark, (1, "x")).write.parquet(f"{tmp_path}/x")
    catalog.create_external("e", f"{tmp_path}/x")
    pairs(spark, (2, "y")).write.mode("append").parquet(f"{tmp_path}/x")
    spark.catalog.refreshTable(catalog.spark_name("e"))
    assert rows(catalog.table("e")) == [(1, "x"), (2, "y")]
    catalog.patch_dataset(catalog.dataset, labels={"a": "b"})
    assert catalog.get_dataset(catalog.dataset)["labels"] == {"a": "b"} and [d["dataset"] for d in catalog.list_datasets()] == [catalog.dataset]
    with pytest.raises(InUse):
        catalog.drop_dataset(catalog.dataset)


# streams


@pytest.mark.parametrize("kind", ["COMMITTED", "PENDING", "BUFFERED"])
def test_a_bad_row_takes_its_request_along(spark, catalog, kind):
    catalog.create_table("t", PAIR)
    s = WriteStream(catalog, "t", kind)
    s.append([{"id": 1}])
    with pytest.raises(StreamError):
        s.append([{"id": 2}, {"id": "zz"}])
    assert s.offset == 1 and s.append([{"id": 2}, {"id": 3}], offset=1) == 1
    if kind == "BUFFERED":
        s.flush(1)
        assert rows(catalog.table("t").select("id")) == [(1,), (2,)] and s.shown == 2
        s.flush(2)
    if kind == "PENDING":
        assert catalog.table("t").count() == 0
        s.finalize()
        batch_commit([s])
    assert rows(catalog.table("t").select("id")) == [(1,), (2,), (3,)] and s.held == []


def test_flush_that_fails_may_come_again(spark, catalog, monkeypatch):
    catalog.create_table("t", PAIR)
    s = WriteStream(catalog, "t", "BUFFERED")
    s.append([{"id": i} for i in range(4)])
    with monkeypatch.context() as m:
        m.setattr(catalog, "write", lambda *a, **k: (_ for _ in ()).throw(OSError("full")))
        with pytest.raises(OSError):
            s.flush(3)
    assert s.shown == 0 and s.flush(3) == 4 and catalog.table("t").count() == 4


def test_commit_of_two_tables(spark, catalog):
    streams = []
    for name in ("a", "b"):
        catalog.create_table(name, PAIR)
        s = WriteStream(catalog, name, "PENDING")
        s.append([{"id": 1, "word": name}])
        s.finalize()
        streams.append(s)
    batch_commit(streams)
    assert [rows(catalog.table(n)) for n in ("a", "b")] == [[(1, "a")], [(1, "b")]]


def test_a_batch_that_comes_twice_is_written_once(spark, catalog, tmp_path):
    pairs(spark, (1, "a"), (2, "b")).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, word string").json(f"{tmp_path}/in")
    into_table(stream, catalog, "t", f"{tmp_path}/check").awaitTermination()
    assert rows(catalog.table("t")) == [(1, "a"), (2, "b")]
    catalog.write_batch("t", pairs(spark, (3, "c")), "s", 0)
    catalog.write_batch("t", pairs(spark, (3, "c")), "s", 0)
    catalog.entry("t").batches["s"] = -1  # a crash between the rows and the number
    catalog.write_batch("t", pairs(spark, (3, "c")), "s", 0)
    assert rows(catalog.table("t")) == [(1, "a"), (2, "b"), (3, "c")]
    dml.update(catalog, "t", {"word": F.lit("z")}, F.col("id") == 3)
    catalog.write_batch("t", pairs(spark, (3, "c")), "s", 0)
    assert rows(catalog.table("t")) == [(1, "a"), (2, "b"), (3, "z")]


# jobs


def test_jobs_tell_what_happened(spark, catalog):
    client = Client(catalog, keep=5)
    job = client.query("SELECT 1 / id AS x FROM VALUES (0) AS v(id)")
    assert job.state == "PENDING" and job.error is None
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        job.result()
    assert job.state == "DONE" and "DIVIDE_BY_ZERO" in job.error["message"] and client.get(job.id) is job
    assert client.query("SELECT 1 / id AS x FROM VALUES (0) AS v(id)", destination="out").error is not None and client.query("SELEC 1").error["reason"] == "invalidQuery"
    ok = client.query("SELECT 1 AS x").wait()
    assert (ok.state, ok.error) == ("DONE", None) and client.list("DONE")[0] is ok
    client.delete(ok.id)
    with pytest.raises(NotFound):
        client.get(ok.id)
    for _ in range(9):
        client.query("SELECT 1 AS x")
    assert len(client.jobs) == 5


def test_scripts(spark, catalog):
    text = """CREATE TEMP TABLE pick AS SELECT id, 'a;b' AS t FROM VALUES (1), (2) AS v(id); -- one; comment
    CREATE OR REPLACE TEMPORARY FUNCTION plus1(x INT) RETURN x + 1;
    BEGIN DECLARE n INT DEFAULT 0; WHILE n < 3 DO SET n = n + 1; END WHILE; IF n = 3 THEN SELECT CASE WHEN n > 1 THEN plus1(n) END AS m; END IF; END;
    SELECT sum(id) AS s, max(t) AS t FROM pick"""
    assert len(list(statements(text))) == 4
    job = Client(catalog).script(text)
    assert job.error is None and tuple(job.result()[0]) == (3, "a;b")
    failed = Client(catalog).script("SELECT 1 AS x; SELECT * FROM nowhere; SELECT 2 AS x")
    assert failed.error["reason"] == "notFound"


# loads and exports


def file(path, name, text):
    (path / name).write_text(text)
    return str(path / name)


def test_csv_records(spark, tmp_path):
    broken = file(tmp_path, "a.csv", 'id,word\n1,"two\nlines, and ""quotes"""\n2,plain\n')
    assert rows(load_csv(spark, broken, PAIR)) == [(1, 'two\nlines, and "quotes"'), (2, "plain")]
    wide = [{"name": f"c{i}", "type": "STRING"} for i in range(10_000)]
    line = ",".join(f'"v{i},"' for i in range(10_000))
    assert load_csv(spark, file(tmp_path, "w.csv", f"{line}\n{line}\n"), wide).select("c0", "c9999").collect()[1][1] == "v9999,"
    with pytest.raises(BadRows):
        load_csv(spark, file(tmp_path, "b.csv", "1,x\nno,y\n"), PAIR)
    assert rows(load_csv(spark, file(tmp_path, "b2.csv", "1,x\nno,y\n2\n3,z\n"), PAIR, max_bad=2)) == [(1, "x"), (3, "z")]
    assert rows(load_csv(spark, file(tmp_path, "n.csv", "1,NA\n2,'a,b'\n"), PAIR, null_marker="NA", quote="'").fillna("-")) == [(1, "-"), (2, "a,b")]
    assert rows(load_csv(spark, file(tmp_path, "s.csv", "title\nunits,words,more\n1,x\n"), PAIR, skip=2)) == [(1, "x")]


def test_csv_header_of_each_file(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    file(folder, "1.csv", "word,id\nx,1\n")
    file(folder, "2.csv", "2,y\n3,z\n")
    file(folder, "3.csv", "id,word\n4,w\n")
    assert rows(load_csv(spark, f"{folder}/*.csv", PAIR)) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]


def test_export_comes_back(spark, tmp_path):
    given = pairs(spark, (1, 'a"b,c'), (2, "x;y\nz"), (3, None), (4, "plain")).coalesce(2)
    out = export_data(given, f"{tmp_path}/x-*.csv")
    assert rows(load_csv(spark, out, PAIR).fillna("-")) == rows(given.fillna("-"))
    with pytest.raises(FileExistsError):
        export_data(given.coalesce(1), f"{tmp_path}/x-*.csv")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == [f"x-{i:012d}.csv" for i in range(len(out))]
    export_data(given.limit(1).coalesce(1), f"{tmp_path}/x-*.csv", overwrite=True, delimiter=";")
    assert load_csv(spark, f"{tmp_path}/x-000000000000.csv", PAIR, delimiter=";").count() == 1


# operators against brute force


def test_operators_by_hand(spark):
    import random

    rnd = random.Random(3)
    data = [(i, rnd.choice([1, 1, 1, 2, None]), rnd.randrange(200), rnd.random()) for i in range(400)]
    df = spark.createDataFrame(data, "id int, `a key` int, t int, v double")
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    got = {r.id: r.right_id for r in asof_join(left, right, ["a key"], "t", "t", ["id"], ranges=7).collect()}
    for i, k, t, _ in data[::2]:
        best = max(((u, j) for j, l, u, _ in data[1::2] if k is not None and l == k and u <= t), default=None)
        assert (got[i] is None) == (best is None) and (best is None or data[got[i]][1:3] == (k, best[0]))
    order = sorted(data, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert [r.id for r in places(df, F.asc_nulls_last("a key"), F.asc("id")).orderBy("place").collect()] == [r[0] for r in order]
    ranks = {r.id: (r.rank, r.dense_rank) for r in ranked(df, F.col("t")).collect()}
    times = [r[2] for r in data]
    assert all(ranks[i] == (1 + sum(x < t for x in times), 1 + len({x for x in times if x < t})) for i, _, t, _ in data)
    for r in group_percentiles(df, "a key", "v", [0.0, 0.3, 1.0]).collect():
        own = sorted(x[3] for x in data if x[1] == r["a key"])
        for q, c in zip((0.0, 0.3, 1.0), r.cont, strict=True):
            p = q * (len(own) - 1)
            low = own[int(p)]
            assert abs(c - (low + (own[min(int(p) + 1, len(own) - 1)] - low) * (p - int(p)))) < 1e-12


def test_merge_when(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c")], "id int, x string")
    source = spark.createDataFrame([(2, "new"), (4, "in"), (5, "out"), (3, "p"), (3, "q")], "k int, y string")
    on = F.col("t.id") == F.col("s.k")
    clauses = [dml.When("MATCHED", "UPDATE", {"x": F.col("s.y")}, F.col("s.k") == 2), dml.When("NOT_MATCHED", "INSERT", {"id": F.col("s.k")}, F.col("s.y") == "in")]
    assert rows(dml.merged_when(target, source, on, clauses).fillna("-")) == [(1, "a"), (2, "new"), (3, "c"), (3, "c"), (4, "-")]
    with pytest.raises(dml.DuplicateMatch):
        dml.merged_when(target, source, on, [dml.When("MATCHED", "DELETE")])
    near = F.abs(F.col("t.id") - F.col("s.k")) == 0
    assert rows(dml.merged_when(target, source.where("k = 2"), near, [dml.When("MATCHED", "DELETE"), dml.When("NOT_MATCHED_BY_SOURCE", "UPDATE", {"x": F.lit("z")}, F.col("t.id") == 1)])) == [(1, "z"), (3, "c"), (3, "c")]
