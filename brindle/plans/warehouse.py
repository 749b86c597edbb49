"""Row changes and catalogue features as queries on tables."""

import uuid

from pyspark.sql import functions as F

from .. import dml
from ..operators.relational import wildcard_union
from . import query


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal + 100 AS s_acctbal, s_name FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL
    SELECT s_suppkey + 1000000, s_nationkey, 0.0, 'new' FROM supplier WHERE s_suppkey % 10 = 0)
SELECT t.s_suppkey, CASE WHEN s.s_suppkey IS NULL THEN t.s_acctbal ELSE s.s_acctbal END AS s_acctbal FROM supplier t LEFT JOIN s USING (s_suppkey)
WHERE NOT (s.s_suppkey IS NOT NULL AND t.s_nationkey = 7)
UNION ALL SELECT s_suppkey, s_acctbal FROM s WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)""")
def merge_upsert(t, spark):
    target = t("supplier")
    changes = target.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 100)
    new = target.where("s_suppkey % 10 = 0").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), F.lit("new").alias("s_name"), "s_nationkey", F.lit(0.0).alias("s_acctbal"))
    values = {c: F.col(f"s.{c}") for c in target.columns}
    done = dml.merged(target, changes.union(new), ["s_suppkey"], update={"s_acctbal": F.col("s.s_acctbal")}, insert=values, delete_matched=F.col("t.s_nationkey") == 7)
    return done.select("s_suppkey", "s_acctbal")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT coalesce(c_acctbal < 0, false)""")
def update_delete(t, spark):
    rows = dml.updated(t("customer"), {"c_acctbal": F.col("c_acctbal") * 2}, F.col("c_mktsegment") == "BUILDING")
    return dml.deleted(rows, (F.col("c_acctbal") < 0)).select("c_custkey", "c_acctbal")


@query("""SELECT '2023' AS suffix, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 UNION ALL SELECT '2024', count(*) FROM orders WHERE year(o_orderdate) = 1997""")
def wildcard_tables(t, spark):
    year = lambda y: t("orders").where(F.year("o_orderdate") == y)
    both = wildcard_union({"orders_2023": year(1996), "orders_2024": year(1997), "parts": t("part")}, "orders_")
    return both.groupBy(F.col("_table_suffix").alias("suffix")).agg(F.count("*").alias("n"))


@query("SELECT column_name, ordinal_position::BIGINT AS ordinal_position FROM (SELECT unnest(['s_suppkey', 's_name', 's_nationkey', 's_acctbal']) AS column_name, unnest([1, 2, 3, 4]) AS ordinal_position)")
def information_schema_columns(t, spark):
    from ..catalog import Catalog

    c = Catalog(spark, f"q{uuid.uuid4().hex}", "d", persistent=False)
    c.create_dataset("d")
    c.create_table("supplier", t("supplier").schema)
    rows = c.information_schema("COLUMNS").select("column_name", "ordinal_position")
    c.drop_dataset("d", delete_contents=True)
    return rows


@query("SELECT c_custkey, c_acctbal * 2 + 1 AS v FROM customer")
def sql_function(t, spark):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION brindle_twice(x DOUBLE) RETURNS DOUBLE RETURN x * 2 + 1")
    return t("customer").select("c_custkey", F.expr("brindle_twice(c_acctbal)").alias("v"))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 5000 AND s_nationkey IN (1, 2, 3, 4, 5)")
def typed_parameters(t, spark):
    from ..params import arguments

    ints = {"arrayValues": [{"value": str(i)} for i in range(1, 6)]}
    given = [
        {"name": "least", "parameterType": {"type": "FLOAT64"}, "parameterValue": {"value": "5000"}},
        {"name": "nations", "parameterType": {"type": "ARRAY", "arrayType": {"type": "INT64"}}, "parameterValue": ints},
    ]
    text = "SELECT s_suppkey, s_acctbal FROM {supplier} WHERE s_acctbal > :least AND array_contains(:nations, CAST(s_nationkey AS BIGINT))"
    return spark.sql(text, args=arguments(given), supplier=t("supplier"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_acctbal AS b FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey + 1000000, s_acctbal FROM supplier WHERE s_suppkey % 7 = 0)
SELECT s_suppkey, CASE WHEN s.k IS NULL THEN CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END WHEN s_nationkey < 5 THEN s_acctbal + 1000 ELSE s_acctbal END AS s_acctbal
FROM supplier LEFT JOIN s ON k = s_suppkey WHERE NOT (s.k IS NOT NULL AND s_nationkey >= 20)
UNION ALL SELECT k, b FROM s WHERE k NOT IN (SELECT s_suppkey FROM supplier) AND b > 0""")
def merge_conditions(t, spark):
    """MERGE with ordered clauses and conditions: the first that fits a row is taken."""
    target = t("supplier")
    source = target.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("b"))
    source = source.union(target.where("s_suppkey % 7 = 0").select(F.col("s_suppkey") + 1000000, "s_acctbal"))
    nation, balance = F.col("t.s_nationkey"), F.col("t.s_acctbal")
    clauses = [
        dml.When("MATCHED", "DELETE", condition=nation >= 20), dml.When("MATCHED", "UPDATE", {"s_acctbal": balance + 1000}, nation < 5), dml.When("MATCHED", "NOTHING"),
        dml.When("NOT_MATCHED", "INSERT", {"s_suppkey": F.col("s.k"), "s_acctbal": F.col("s.b")}, F.col("s.b") > 0),
        dml.When("NOT_MATCHED_BY_SOURCE", "UPDATE", {"s_acctbal": F.lit(0.0)}, balance < 0),
    ]
    return dml.merged_when(target, source, F.col("t.s_suppkey") == F.col("s.k"), clauses).select("s_suppkey", "s_acctbal")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = 3 OR s_nationkey = 4")
def table_function(t, spark):
    """A function of rows: parameters go in, Spark inlines the query that comes out."""
    of_nation = lambda n: t("supplier").where(F.col("s_nationkey") == n).select("s_suppkey", "s_acctbal")
    return of_nation(3).union(of_nation(4))


@query("SELECT p_partkey, i::INT AS place, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def udtf(t, spark):
    """A user's table function of a table, a whole Arrow batch a call; what Spark's own generators can say needs none."""

    @F.arrow_udtf(returnType="p_partkey bigint, place int, word string")
    class Words:
        def eval(self, batch):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            found = pc.split_pattern(batch.column("p_name"), " ")  # a null name has no words
            of, n = pc.list_parent_indices(found), pc.list_value_length(found).fill_null(0).to_numpy(zero_copy_only=False)
            place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + 1
            yield pa.table({"p_partkey": batch.column("p_partkey").take(of), "place": place.astype(np.int32), "word": pc.list_flatten(found)})

    return Words(t("part").select("p_partkey", "p_name").asTable())


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def parquet_round_trip(t, spark):
    """An extract and the load of it."""
    return _round_trip(t("supplier"), "PARQUET")


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def orc_round_trip(t, spark):
    return _round_trip(t("part").select("p_partkey", "p_name", "p_size", "p_retailprice"), "ORC")


@query("SELECT s_suppkey, 'a \"quoted\", line' || chr(10) || s_name AS text, s_acctbal FROM supplier")
def csv_round_trip(t, spark):
    """Quotes, delimiters and line breaks go out and come back."""
    rows = t("supplier").select("s_suppkey", F.concat(F.lit('a "quoted", line\n'), "s_name").alias("text"), "s_acctbal")
    return _round_trip(rows, "CSV")


def _round_trip(rows, form):
    from ..sources.extract import extract
    from ..sources.load import load
    from ..staging import shared_folder
    from ..types import describe

    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/trip-{uuid.uuid4().hex}"
    if form == "ORC":
        rows.write.orc(path)
    else:
        extract(rows, path, form)
    specs = [{k: v for k, v in describe(f).items() if k != "mode"} for f in rows.schema.fields]
    return load(spark, path, form, specs if form == "CSV" else None)
