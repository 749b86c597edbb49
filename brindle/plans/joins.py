"""Joins of every kind."""

from pyspark.sql import functions as F

from ..operators.relational import asof_join, interval_join, range_join, salted_join
from . import query


@query("""SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def inner_3way(t, spark):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_missing(t, spark):
    joined = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT o_orderkey, c_name FROM (SELECT * FROM customer WHERE c_acctbal > 5000) RIGHT JOIN orders ON o_custkey = c_custkey")
def right_join(t, spark):
    return t("customer").where("c_acctbal > 5000").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "right").select("o_orderkey", "c_name")


@query("""SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) ON c_custkey = o_custkey""")
def full_outer(t, spark):
    """Customers in credit and large orders: either side has rows alone."""
    return t("customer").where("c_acctbal > 0").join(t("orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_orderkey")


@query("""SELECT nation, balance, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS nation, c_acctbal AS balance, count(*) AS n FROM customer GROUP BY 1, 2) c
FULL JOIN (SELECT s_nationkey AS nation, s_acctbal AS balance, count(*) AS n FROM supplier GROUP BY 1, 2) s USING (nation, balance)""")
def full_outer_all(t, spark):
    """All customers and suppliers by nation and balance; both sides have balances that the other lacks."""
    of = lambda name, n: t(name).groupBy(F.col(f"{name[0]}_nationkey").alias("nation"), F.col(f"{name[0]}_acctbal").alias("balance")).agg(F.count("*").alias(n))
    return of("customer", "customers").join(of("supplier", "suppliers"), ["nation", "balance"], "full")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross(t, spark):
    """Two tables of fixed size; nothing else in the library takes a product."""
    return t("region").crossJoin(t("nation")).select("r_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_exists(t, spark):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_not_exists(t, spark):
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT count(*) AS n FROM supplier WHERE s_nationkey NOT IN (SELECT nullif(c_nationkey, 3) FROM customer WHERE c_acctbal > 9900)")
def not_in_null(t, spark):
    """Null-aware anti join: one null in the list and nothing qualifies."""
    text = "SELECT count(*) AS n FROM {supplier} WHERE s_nationkey NOT IN (SELECT nullif(c_nationkey, 3) FROM {customer} WHERE c_acctbal > 9900)"
    return spark.sql(text, supplier=t("supplier"), customer=t("customer"))


@query("""SELECT p_partkey, b.name FROM part JOIN (VALUES ('low', 0, 10), ('mid', 10, 30), ('high', 30, 100)) b(name, lo, hi) ON p_size >= lo AND p_size < hi""")
def theta_band(t, spark):
    bands = spark.createDataFrame([("low", 0, 10), ("mid", 10, 30), ("high", 30, 100)], "name string, lo int, hi int")
    return t("part").join(F.broadcast(bands), (F.col("p_size") >= F.col("lo")) & (F.col("p_size") < F.col("hi"))).select("p_partkey", "name")


@query("SELECT l_orderkey AS k, round(sum(l_quantity), 2) AS q, any_value(o_orderstatus) AS s FROM lineitem JOIN (SELECT *, o_orderkey AS l_orderkey FROM orders) USING (l_orderkey) GROUP BY 1")
def using_join(t, spark):
    joined = t("lineitem").join(t("orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    return joined.groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.any_value("o_orderstatus").alias("s"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join(t, spark):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("""SELECT p.event_id, c.event_id AS right_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def asof_events(t, spark):
    of = lambda kind: t("events").where(F.col("event_type") == kind).select("event_id", "ts", "user_id")
    return asof_join(of("purchase"), of("click"), ["user_id"], "ts", "ts", ["event_id"]).select("event_id", "right_event_id")


@query("""SELECT a.event_id AS click, b.event_id AS buy FROM events a JOIN events b ON a.user_id = b.user_id
AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def interval_events(t, spark):
    a = t("events").where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("click"))
    b = t("events").where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("buy"))
    return interval_join(a, b, ["user_id"], "at", "ts", 7200).select("click", "buy")


@query("""SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice >= p_retailprice * 200 AND o_totalprice < p_retailprice * 200 + 25""")
def range_price(t, spark):
    spans = t("part").select("p_partkey", (F.col("p_retailprice") * 200).alias("lo"), (F.col("p_retailprice") * 200 + 25).alias("hi"))
    return range_join(t("orders").select("o_orderkey", "o_totalprice"), spans, "o_totalprice", "lo", "hi", 25.0).select("o_orderkey", "p_partkey")


@query("""SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice >= p_retailprice * 200 AND o_totalprice < p_retailprice * 200 + 5""")
def range_price_all(t, spark):
    """All parts and orders; the narrow span keeps the output small."""
    spans = t("part").select("p_partkey", (F.col("p_retailprice") * 200).alias("lo"), (F.col("p_retailprice") * 200 + 5).alias("hi"))
    return range_join(t("orders").select("o_orderkey", "o_totalprice"), spans, "o_totalprice", "lo", "hi", 5.0).select("o_orderkey", "p_partkey")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def salted(t, spark):
    small = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return salted_join(t("lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber"), small, ["l_suppkey"], 4).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, (SELECT max(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey) AS top FROM orders
WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)""")
def scalar_correlated(t, spark):
    """A correlated scalar subquery as the aggregate-then-join that Catalyst makes of it."""
    top = t("lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("top"))
    mean = t("orders").agg(F.avg("o_totalprice").alias("mean"))
    rich = t("orders").join(F.broadcast(mean), F.col("o_totalprice") > F.col("mean"))  # one row
    return rich.join(top, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "top")


@query("""SELECT c_custkey, o.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) o""")
def lateral_top1(t, spark):
    best = t("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), "o_orderkey")).alias("o_orderkey"))
    return t("customer").join(best, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


@query("""SELECT e.event_id, c.event_id AS right_event_id FROM (SELECT event_id, ts, nullif(user_id, 3) AS user_id FROM events) e
ASOF LEFT JOIN (SELECT event_id, ts, nullif(user_id, 3) AS user_id FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def asof_null_keys(t, spark):
    """A null key has no latest row."""
    rows = t("events").select("event_id", "ts", F.nullif(F.col("user_id"), F.lit(3)).alias("user_id"), "event_type")
    clicks = rows.where("event_type = 'click'").drop("event_type")
    return asof_join(rows.drop("event_type"), clicks, ["user_id"], "ts", "ts", ["event_id"]).select("event_id", "right_event_id")


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)""")
def subqueries(t, spark):
    """Scalar and correlated subqueries as written: Catalyst makes an aggregate and a semi join of them."""
    text = """SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})
        AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_quantity >= 49)"""
    return spark.sql(text, orders=t("orders"), lineitem=t("lineitem"))


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
def scalar_subquery(t, spark):
    return spark.sql("SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS top FROM {customer}", orders=t("orders"), customer=t("customer"))


@query("SELECT n_name, s.n, s.best FROM nation, LATERAL (SELECT count(*) AS n, max(s_acctbal) AS best FROM supplier WHERE s_nationkey = n_nationkey) s")
def lateral(t, spark):
    text = "SELECT n_name, s.n, s.best FROM {nation}, LATERAL (SELECT count(*) AS n, max(s_acctbal) AS best FROM {supplier} WHERE s_nationkey = n_nationkey) s"
    return spark.sql(text, nation=t("nation"), supplier=t("supplier"))
