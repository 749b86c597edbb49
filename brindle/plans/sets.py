"""Sorts, limits and set operations."""

from pyspark.sql import functions as F

from ..operators.relational import places
from . import query


def by_status(orders):
    rows = orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status"))
    return places(rows, F.asc_nulls_last("status"), F.asc("o_orderkey")).select("o_orderkey", "place").orderBy("place")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(t, spark):
    """TakeOrderedAndProject: each task keeps 20 rows, and only those meet."""
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15 OFFSET 30")
def limit_offset(t, spark):
    return t("customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").offset(30).limit(15)


@query("SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t, spark):
    return t("customer").select(F.col("c_nationkey").alias("nation")).union(t("supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t, spark):
    return t("customer").select(F.col("c_nationkey").alias("nation")).union(t("supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t, spark):
    return t("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).intersect(t("supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_distinct(t, spark):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").select("o_custkey"))


@query("SELECT c_nationkey AS n FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t, spark):
    return t("customer").select(F.col("c_nationkey").alias("n")).exceptAll(t("supplier").select("s_nationkey"))


@query("SELECT o_orderpriority AS p FROM orders EXCEPT ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def except_all_orders(t, spark):
    """The priorities of all orders except all those of one status."""
    p = F.col("o_orderpriority").alias("p")
    return t("orders").select(p).exceptAll(t("orders").where("o_orderstatus = 'F'").select(p))


@query("SELECT s_nationkey AS n FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer")
def intersect_all(t, spark):
    return t("supplier").select(F.col("s_nationkey").alias("n")).intersectAll(t("customer").select("c_nationkey"))


@query("SELECT c_custkey AS id, c_name AS name, NULL::BIGINT AS nation FROM customer UNION ALL BY NAME SELECT s_suppkey AS id, s_nationkey::BIGINT AS nation, s_name AS name FROM supplier")
def union_by_name(t, spark):
    a = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("bigint").alias("nation"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT c_custkey, row_number() OVER (ORDER BY nullif(c_mktsegment, 'BUILDING') DESC NULLS FIRST, c_custkey) AS place FROM customer ORDER BY place""")
def nulls_order(t, spark):
    rows = t("customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    return places(rows, F.desc_nulls_first("segment"), F.asc("c_custkey")).select("c_custkey", "place").orderBy("place")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') ASC NULLS LAST, o_orderkey) AS place FROM orders ORDER BY place")
def nulls_order_all(t, spark):
    """All orders, numbered range by range."""
    return by_status(t("orders"))
