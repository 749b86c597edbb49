"""Window functions and frames."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.relational import places, qualify, ranked
from . import query


def by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@query("""SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def row_number_top_n(t, spark):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("rn")).where("rn <= 3")


@query("""SELECT s_suppkey, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c
FROM supplier WINDOW w AS (ORDER BY s_nationkey)""")
def rank_dense(t, spark):
    """Ranks over a whole table: distinct values are numbered range by range and joined back."""
    rows, rank = ranked(t("supplier").select("s_suppkey", "s_nationkey"), F.col("s_nationkey")), F.col("rank")
    p = F.when(F.col("_rows") > 1, (rank - 1) / (F.col("_rows") - 1)).otherwise(F.lit(0.0))
    return rows.select("s_suppkey", rank.alias("r"), F.col("dense_rank").alias("d"), F.round(p, 9).alias("p"), F.round((rank - 1 + F.col("_ties")) / F.col("_rows"), 9).alias("c"))


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS after2 FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def lag_lead(t, spark):
    return t("orders").select("o_orderkey", F.lag("o_orderkey").over(by_customer()).alias("before"), F.lead("o_orderkey", 2, -1).over(by_customer()).alias("after2"))


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS spent FROM orders""")
def running_sum_rows(t, spark):
    w = by_customer().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t("orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("spent"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n,
    round(avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 6) AS mean FROM events""")
def moving_avg_range_interval(t, spark):
    over = "OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)"
    return t("events").select("event_id", F.expr(f"count(*) {over}").alias("n"), F.round(F.expr(f"avg(value) {over}"), 6).alias("mean"))


@query("SELECT c_custkey, ntile(7) OVER (ORDER BY c_acctbal, c_custkey) AS tile FROM customer")
def ntile(t, spark):
    """Tiles from places in the whole order: the first tiles take one row more where the rows do not divide."""
    rows = places(t("customer").select("c_custkey", "c_acctbal"), F.asc("c_acctbal"), F.asc("c_custkey"))
    many = t("customer").agg(F.count(F.lit(1)).alias("n"))  # one row
    tile = F.expr("CASE WHEN place <= (n % 7) * (n div 7 + 1) THEN (place - 1) div (n div 7 + 1) + 1 ELSE n % 7 + (place - 1 - (n % 7) * (n div 7 + 1)) div greatest(n div 7, 1) + 1 END")
    return rows.join(F.broadcast(many)).select("c_custkey", tile.alias("tile"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_buy,
    first_value(event_type) OVER w AS first_type, nth_value(event_id, 2) OVER w AS second FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def first_last_ignore_nulls(t, spark):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buy = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return t("events").select(
        "event_id", F.last(buy, ignorenulls=True).over(w).alias("last_buy"), F.first("event_type").over(w).alias("first_type"), F.nth_value("event_id", 2).over(w).alias("second")
    )


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def qualify_latest(t, spark):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return qualify(t("orders"), F.row_number().over(w) == 1).select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share,
    count(*) OVER (PARTITION BY o_orderstatus) AS same FROM orders""")
def share_of_total(t, spark):
    total = F.sum("o_totalprice").over(Window.partitionBy("o_custkey"))
    return t("orders").select("o_orderkey", F.round(F.col("o_totalprice") / total, 9).alias("share"), F.count("*").over(Window.partitionBy("o_orderstatus")).alias("same"))
