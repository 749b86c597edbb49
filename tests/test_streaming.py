"""Streams give what the same groupings give on tables."""

from pyspark.sql import functions as F

from brindle.catalog import Catalog
from brindle.operators.relational import asof_join, interval_join, range_join, salted_join
from brindle.streaming.sinks import into_table
from brindle.streaming.state import visits
from brindle.streaming.windows import first_within, joined_streams, sessions, tumbling


def stream(spark, folder, name="events"):
    return spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema).parquet(f"{folder}/{name}.parquet*")


def run(spark, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows_agree(spark, folder):
    table = spark.read.parquet(f"{folder}/events.parquet")
    build = lambda d: tumbling(d, "ts", "1 day", ["event_type"], "1 hour").agg(F.count("*").alias("n"))
    got = run(spark, build(stream(spark, folder)), "complete", "s_tumbling")
    assert sorted(map(str, got.collect())) == sorted(map(str, build(table).collect()))


def test_sessions_append(spark, folder):
    table = spark.read.parquet(f"{folder}/events.parquet")
    build = lambda d: sessions(d, "ts", "1 hour", ["user_id"], "10 minutes").agg(F.count("*").alias("n"))
    got = run(spark, build(stream(spark, folder)), "append", "s_sessions")
    every = {str(r) for r in build(table).collect()}
    assert {str(r) for r in got.collect()} <= every and got.count() > 0.9 * len(every)


def test_dedup_and_sink(spark, folder, tmp_path):
    c = Catalog(spark, "s", "streams")
    c.create_dataset("streams", exists_ok=True)
    first = first_within(stream(spark, folder), "ts", ["event_id"], "1 hour").select("event_id", "user_id")
    into_table(first, c, "firsts", str(tmp_path / "c")).awaitTermination(120)
    assert c.table("firsts").count() == spark.read.parquet(f"{folder}/events.parquet").select("event_id").distinct().count()
    c.drop_dataset("streams", delete_contents=True)


def test_state_of_keys(spark, folder):
    """Open visits hold all rows of a user; a late row's watermark closes those that are over."""
    table = spark.read.parquet(f"{folder}/events.parquet")
    got = run(spark, visits(stream(spark, folder), "user_id", "ts", "value", "1 day", "1 hour"), "update", "s_visits")
    last = {}
    for r in got.collect():
        last.setdefault(r.user_id, []).append(r)
    want = {r.user_id: (r.n, r.total) for r in table.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    assert {u: max(r.n for r in rows) for u, rows in last.items()} == {u: n for u, (n, _) in want.items()}
    assert all(abs(max(rows, key=lambda r: r.n).total - want[u][1]) < 1e-6 for u, rows in last.items())


def test_streams_join(spark, folder):
    table = spark.read.parquet(f"{folder}/events.parquet")
    of = lambda d, kind, name: d.where(F.col("event_type") == kind).select("user_id", F.col("ts").alias(f"{name}_ts"), F.col("event_id").alias(name))
    both = joined_streams(of(stream(spark, folder), "click", "a"), of(stream(spark, folder), "purchase", "b"), "user_id", "a_ts", "b_ts", 7200, "1 hour")
    got = {(r.a, r.b) for r in run(spark, both.select("a", "b"), "append", "s_join").collect()}
    want = interval_join(of(table, "click", "a"), of(table, "purchase", "b"), ["user_id"], "a_ts", "b_ts", 7200)
    assert got == {(r.a, r.b) for r in want.collect()} and got


def test_joins(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (2, 1, "c"), (None, 3, "d")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 4, "p"), (1, 10, "q"), (2, 2, "r")], "k int, t int, y string")
    assert sorted((r.x, r.right_y) for r in asof_join(left, right, ["k"], "t", "t", ["y"]).collect()) == [("a", "q"), ("b", "p"), ("c", None), ("d", None)]
    points = spark.createDataFrame([(float(i),) for i in range(50)], "p double")
    spans = spark.createDataFrame([(0, 3.5, 17.0), (1, 16.0, 16.5), (2, 9.0, 9.0)], "s int, lo double, hi double")
    got = range_join(points, spans, "p", "lo", "hi", 4.0)
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((float(p), s) for p in range(50) for s, lo, hi in [(0, 3.5, 17.0), (1, 16.0, 16.5), (2, 9.0, 9.0)] if lo <= p < hi)
    assert salted_join(left.where("k is not null"), right.select("k", "y"), ["k"], 3).count() == 5
    times = spark.sql("SELECT 1 AS k, timestamp'2024-01-01 00:00:00' AS a")
    later = spark.sql("SELECT 1 AS k, explode(sequence(timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:10:00', interval 1 minute)) AS b")
    assert interval_join(times, later, ["k"], "a", "b", 300).count() == 6
