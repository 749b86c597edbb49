"""Scans, projections and predicates."""

from pyspark.sql import functions as F

from . import query


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-02-01' AND l_discount BETWEEN 0.05 AND 0.07""")
def filter_range(t, spark):
    """Both predicates and the three columns reach the Parquet scan."""
    d = F.col("l_shipdate")
    rows = t("lineitem").where((d >= F.lit("1996-01-01").cast("timestamp_ntz")) & (d < F.lit("1996-02-01").cast("timestamp_ntz")))
    return rows.where(F.col("l_discount").between(0.05, 0.07)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def in_list(t, spark):
    return t("customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND NOT p_type LIKE 'S%'")
def like(t, spark):
    return t("part").where(F.col("p_name").like("%a%") & ~F.col("p_type").like("S%")).select("p_partkey", "p_name")


@query("""SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n,
    round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1""")
def case_bucket(t, spark):
    bucket = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return t("part").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("SELECT * EXCLUDE (s_name, s_acctbal) FROM supplier")
def select_except(t, spark):
    return t("supplier").drop("s_name", "s_acctbal")


@query("SELECT s_suppkey, upper(s_name) AS s_name, s_nationkey, s_acctbal FROM supplier")
def select_replace(t, spark):
    return t("supplier").withColumn("s_name", F.upper("s_name"))


@query("""WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders)
SELECT o_orderkey, p IS NULL AS missing, p IS DISTINCT FROM '2-HIGH' AS other, coalesce(p, 'none') AS filled FROM o WHERE p IS NULL OR p <> '5-LOW'""")
def null_logic(t, spark):
    p = F.col("p")
    rows = t("orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("p"))
    return rows.where(p.isNull() | (p != "5-LOW")).select(
        "o_orderkey", p.isNull().alias("missing"), (~p.eqNullSafe("2-HIGH")).alias("other"), F.coalesce(p, F.lit("none")).alias("filled")
    )


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(t, spark):
    return t("orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND (r_name LIKE 'A%' OR n_name LIKE '%1')")
def compound_predicate(t, spark):
    joined = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.where(F.col("r_name").like("A%") | F.col("n_name").like("%1")).select("n_name", "r_name")


@query("SELECT count(*) AS n, true AS near, 0::BIGINT AS strange FROM orders")
def table_sample(t, spark):
    """Sampling: a Bernoulli sample by row, within five standard deviations of a tenth, all of whose rows are the table's."""
    rows = t("orders").select("o_orderkey")
    drawn = rows.sample(fraction=0.1, seed=42)
    strange = drawn.join(rows, "o_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("strange"))
    counts = rows.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(drawn.agg(F.count(F.lit(1)).alias("m")))).join(F.broadcast(strange))  # one row each
    return counts.select("n", (F.abs(F.col("m") - 0.1 * F.col("n")) <= 5 * F.sqrt(0.09 * F.col("n"))).alias("near"), "strange")


@query("SELECT p_partkey FROM part WHERE (p_type LIKE 'S%' OR p_type LIKE '%a%') AND p_name LIKE '%a%' AND p_name LIKE '%e%'")
def like_any_all(t, spark):
    return spark.sql("SELECT p_partkey FROM {part} WHERE p_type LIKE ANY ('S%', '%a%') AND p_name LIKE ALL ('%a%', '%e%')", part=t("part"))


@query("SELECT s_suppkey AS k, s_acctbal * 2 AS twice FROM supplier WHERE s_acctbal > 0")
def select_as_struct(t, spark):
    """SELECT AS STRUCT makes one column of a row, SELECT AS VALUE takes its fields apart again."""
    one = t("supplier").where("s_acctbal > 0").select(F.struct(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") * 2).alias("twice")).alias("value"))
    return one.select("value.*")


@query("SELECT c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 0 GROUP BY 1 HAVING count(*) > 2")
def pipe_syntax(t, spark):
    text = """FROM {customer} |> WHERE c_acctbal > 0 |> AGGREGATE count(*) AS n, round(sum(c_acctbal), 2) AS total GROUP BY c_nationkey AS nation |> WHERE n > 2"""
    return spark.sql(text, customer=t("customer"))
