"""Arrays, structs and recursion."""

from pyspark.sql import functions as F

from .. import functions as G
from . import query



@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def unnest(t, spark):
    return t("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("SELECT p_partkey, (unnest(range(len(string_split(p_name, ' ')))))::BIGINT AS place, unnest(string_split(p_name, ' ')) AS word FROM part")
def unnest_offset(t, spark):
    return t("part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "word")).withColumn("place", F.col("place").cast("bigint"))


@query("SELECT s_suppkey, {'name': s_name, 'at': {'nation': s_nationkey}}.at.nation AS nation FROM supplier")
def struct_access(t, spark):
    s = F.struct(F.col("s_name").alias("name"), F.struct(F.col("s_nationkey").alias("nation")).alias("at"))
    return t("supplier").select("s_suppkey", s["at"]["nation"].alias("nation"))


@query("""SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.1))::BIGINT AS high, round(list_sum(list_transform(embedding[1:4], lambda x: x::DOUBLE * 2)), 5) AS s FROM embeddings""")
def array_filter_transform(t, spark):
    e = F.col("embedding")
    total = F.aggregate(F.transform(F.slice(e, 1, 4), lambda x: x.cast("double") * 2), F.lit(0.0), lambda a, x: a + x)
    return t("embeddings").select("vec_id", F.size(F.filter(e, lambda x: x > 0.1)).cast("bigint").alias("high"), F.round(total, 5).alias("s"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE)), 4) AS dot
FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)""")
def embedding_dot(t, spark):
    q = t("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    both = t("embeddings").join(F.broadcast(q))  # one row
    product = F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double"))
    return both.select("vec_id", F.round(F.aggregate(product, F.lit(0.0), lambda a, x: a + x), 4).alias("dot"))


@query("SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat([c_nationkey, 3], [c_nationkey]))), '-') AS a, list_contains([1, 2, 3], c_nationkey) AS b FROM customer")
def array_set_ops(t, spark):
    n = F.col("c_nationkey")
    merged = F.array_sort(F.array_distinct(F.concat(F.array(n, F.lit(3)), F.array(n))))
    return t("customer").select("c_custkey", F.array_join(F.transform(merged, lambda x: x.cast("string")), "-").alias("a"), F.array_contains(F.array(F.lit(1), F.lit(2), F.lit(3)), n).alias("b"))


@query("WITH RECURSIVE r(n, f) AS (SELECT 1, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
def recursive_cte(t, spark):
    return spark.sql("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), owned AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1) SELECT n, count(*) AS customers FROM owned GROUP BY n")
def cte(t, spark):
    by = t("orders").where("o_totalprice > 200000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return by.groupBy("n").agg(F.count("*").alias("customers"))


@query("SELECT x AS n FROM unnest(range(0, 100, 7)) u(x)")
def generate_array(t, spark):
    return spark.range(1).select(F.explode(G.generate_array(0, 99, 7)).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 3 THEN NULL ELSE ([10, 20, 30, 40])[c_nationkey % 6 + 1] END AS v FROM customer")
def safe_offset(t, spark):
    a = F.array(*[F.lit(x) for x in (10, 20, 30, 40)])
    return t("customer").select("c_custkey", F.when(F.col("c_nationkey") >= 3, F.get(a, F.col("c_nationkey") % 6)).alias("v"))
