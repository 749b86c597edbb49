"""Queries that must take whole tables, not subsets by id."""

from brindle.operators.relational import range_join
from brindle.plans import catalogue

QUERIES, SQL = catalogue()


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_range_price_all(spark, folder):
    """Parts and orders by brute force on sf0.01, whose parts go beyond 500."""
    folder = folder.replace("0.001", "0.01")
    orders = sorted((r.o_totalprice, r.o_orderkey) for r in table(spark, folder, "orders").collect())
    want = set()
    for r in table(spark, folder, "part").collect():
        low, high = r.p_retailprice * 200, r.p_retailprice * 200 + 5
        want |= {(k, r.p_partkey) for price, k in orders if low <= price < high}
    assert {tuple(r) for r in QUERIES["range_price_all"](spark, folder).collect()} == want and max(p for _, p in want) > 500


def test_nulls_order_all_and_except_all_orders(spark, folder):
    """Every order has its place, nulls last, and no window takes all orders through one task; priorities of all orders are compared."""
    rows = [(r.o_orderkey, r.o_orderstatus, r.o_orderpriority) for r in table(spark, folder, "orders").collect()]
    found = QUERIES["nulls_order_all"](spark, folder)
    order = sorted(rows, key=lambda r: (r[1] == "F", r[1], r[0]))
    assert [tuple(r) for r in found.collect()] == [(r[0], i + 1) for i, r in enumerate(order)] and len(rows) > 201
    left = sorted(r.p for r in QUERIES["except_all_orders"](spark, folder).collect())
    kinds = {r[2] for r in rows}
    n = {k: sum(r[2] == k for r in rows) - sum(r[2] == k and r[1] == "F" for r in rows) for k in kinds}
    assert left == sorted(k for k in kinds for _ in range(n[k]))


def test_full_outer_all(spark, folder):
    """Every customer and supplier is counted, with rows of either side alone."""
    rows = QUERIES["full_outer_all"](spark, folder).collect()
    assert sum(r.customers or 0 for r in rows) == table(spark, folder, "customer").count()
    assert sum(r.suppliers or 0 for r in rows) == table(spark, folder, "supplier").count()
    assert any(r.customers is None for r in rows) and any(r.suppliers is None for r in rows)


def test_udtf_batches(spark, tmp_path):
    """The table function takes whole batches where the rows are read, not a row a call; null names have no words and empty ones one."""
    names = [None, "", "a", "a  b", "large ring of steel", *[f"part {i}" for i in range(25_000)]]
    df = spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string")
    df.repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["udtf"](spark, str(tmp_path))
    want = [(k, i + 1, w) for k, name in enumerate(names) if name is not None for i, w in enumerate(name.split(" "))]
    assert sorted(tuple(r) for r in found.collect()) == want and found.columns == ["p_partkey", "place", "word"]
    spark.createDataFrame([], df.schema).write.parquet(f"{tmp_path}/none/part.parquet")
    assert QUERIES["udtf"](spark, f"{tmp_path}/none").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and "Exchange" not in plan


def test_range_join_by_span(spark):
    """All pairs, also with keys; a span's pairs in a bucket are neighbours, so that a result of many times the tables' size is written small."""
    points = [(i % 3, i, float(i * 37 % 50)) for i in range(300)]
    spans = [(i % 3, i, i * 13 % 45 + 0.5, i * 13 % 45 + 10.5) for i in range(60)]
    p, s = spark.createDataFrame(points, "g int, k int, at double"), spark.createDataFrame(spans, "g int, n int, lo double, hi double")
    assert range_join(p, s, "at", "lo", "hi", 10.0, ["g"]).columns == ["g", "k", "at", "n", "lo", "hi"]
    rows = [(r.k, r.n) for r in range_join(p.drop("g"), s.drop("g"), "at", "lo", "hi", 10.0).collect()]
    assert sorted(rows) == sorted((k, n) for _, k, at in points for _, n, lo, hi in spans if lo <= at < hi)
    assert sum(a[1] != b[1] for a, b in zip(rows, rows[1:])) < 2 * len(spans)
    keyed = sorted((r.k, r.n) for r in range_join(p, s, "at", "lo", "hi", 10.0, ["g"]).collect())
    assert keyed == sorted((k, n) for g, k, at in points for h, n, lo, hi in spans if g == h and lo <= at < hi)
