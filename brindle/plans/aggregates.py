"""Aggregation."""

from pyspark.sql import functions as F

from .. import functions as G
from ..operators.relational import first_of_group, group_percentiles
from . import query


def _r(c, n, name):
    return F.round(c, n).alias(name)


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
    round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2""")
def pricing_summary(t, spark):
    """The flagship: one scan of seven columns, partial aggregation, one small shuffle."""
    rows = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        _r(F.sum("l_quantity"), 2, "sum_qty"), _r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2, "sum_disc"),
        _r(F.avg("l_discount"), 6, "avg_disc"), F.count("*").alias("n"),
    ).orderBy("l_returnflag", "l_linestatus")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1")
def count_distinct(t, spark):
    return t("lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.sum_distinct("l_linenumber").alias("lines"))


@query("""SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::BIGINT * 2 + grouping(l_linestatus)::BIGINT AS g, count(*) AS n
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup(t, spark):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("bigint").alias("g"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t, spark):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders
GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def grouping_sets(t, spark):
    a, b = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t("orders").groupingSets([[a], [b], []], a, b).agg(_r(F.avg("o_totalprice"), 4, "mean"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count_if(value > 50)::BIGINT AS high,
    round(sum(value) FILTER (event_type = 'purchase'), 4) AS spent FROM events GROUP BY user_id""")
def filter_clause(t, spark):
    kind = F.col("event_type")
    return t("events").groupBy("user_id").agg(
        G.countif(kind == "click").alias("clicks"), G.countif(F.col("value") > 50).alias("high"), _r(F.sum(F.when(kind == "purchase", F.col("value"))), 4, "spent")
    )


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_discount), 9) AS v,
    round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_discount, l_tax), 9) AS cov FROM lineitem GROUP BY 1""")
def stats(t, spark):
    return t("lineitem").groupBy("l_returnflag").agg(
        _r(F.stddev_samp("l_quantity"), 6, "sd"), _r(F.var_pop("l_discount"), 9, "v"), _r(F.corr("l_quantity", "l_extendedprice"), 6, "c"), _r(F.covar_samp("l_discount", "l_tax"), 9, "cov")
    )


@query("""SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS median, quantile_disc(o_totalprice, 0.9) AS p90 FROM orders GROUP BY 1""")
def percentile(t, spark):
    """Exact at any number of values in a group: counts of distinct values, numbered range by range."""
    found = group_percentiles(t("orders"), "o_orderstatus", "o_totalprice", [0.5, 0.9])
    return found.select("o_orderstatus", _r(F.get("cont", F.lit(0)), 4, "median"), F.get("disc", F.lit(1)).alias("p90"))


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY 1")
def string_agg_ordered(t, spark):
    return t("nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name DESC)").alias("names"))


@query("""SELECT o_custkey, array_to_string(list_slice(list(o_orderkey ORDER BY o_orderdate, o_orderkey), 1, 3), ',') AS first3 FROM orders GROUP BY 1""")
def array_agg_ordered(t, spark):
    """The limit goes first: each task keeps three rows of a group, and only those are gathered."""
    first = first_of_group(t("orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], 3, "o_orderdate", "o_orderkey")
    keys = G.array_agg(F.col("o_orderkey"), F.col("place"))
    return first.groupBy("o_custkey").agg(F.array_join(F.transform(keys, lambda x: x.cast("string")), ",").alias("first3"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS least FROM orders GROUP BY 1")
def max_by(t, spark):
    by = F.struct("o_totalprice", "o_orderkey")
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", by).alias("top"), F.min_by("o_orderkey", by).alias("least"))


@query("SELECT bool_and(s_acctbal > -1000) AS every, bool_or(s_acctbal > 9000) AS some, bit_or(s_nationkey)::BIGINT AS b, bit_xor(s_suppkey)::BIGINT AS x, bit_and(s_nationkey)::BIGINT AS a FROM supplier")
def logical_bits(t, spark):
    bal = F.col("s_acctbal")
    return t("supplier").agg(
        G.logical_and(bal > -1000).alias("every"), G.logical_or(bal > 9000).alias("some"), F.bit_or("s_nationkey").cast("bigint").alias("b"), F.bit_xor("s_suppkey").alias("x"),
        F.bit_and("s_nationkey").cast("bigint").alias("a"),
    )


@query("SELECT count(*) AS n, count(o_custkey) AS c, sum(o_totalprice) AS s, count(*) FILTER (o_custkey > 0) AS ci, max(o_orderkey) AS m FROM orders WHERE false")
def empty_input(t, spark):
    """Counts of nothing are 0, sums are null."""
    none = t("orders").where(F.lit(False))
    return none.agg(F.count("*").alias("n"), F.count("o_custkey").alias("c"), F.sum("o_totalprice").alias("s"), G.countif(F.col("o_custkey") > 0).alias("ci"), F.max("o_orderkey").alias("m"))


@query("""SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (round(sum(l_quantity), 2) FOR l_linestatus IN ('F', 'O') GROUP BY l_returnflag)""")
def pivot(t, spark):
    return t("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 2))


@query("UNPIVOT (SELECT s_suppkey, s_nationkey::DOUBLE AS nation, s_acctbal AS balance FROM supplier) ON nation, balance INTO NAME what VALUE v")
def unpivot(t, spark):
    return t("supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance")).unpivot("s_suppkey", ["nation", "balance"], "what", "v")


@query("SELECT count(DISTINCT l_partkey) AS parts, true AS hll_near, true AS sketch_near FROM lineitem")
def approx_distinct(t, spark):
    """Two sketches beside the exact count, each within four standard errors of it."""
    found = t("lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.05).alias("hll"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 12)).alias("sketch"))
    near = lambda c, error: F.abs(F.col(c) - F.col("parts")) <= 4 * error * F.col("parts")
    return found.select("parts", near("hll", 0.05).alias("hll_near"), near("sketch", 0.0163).alias("sketch_near"))


@query("SELECT l_returnflag, bound, true AS near FROM (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT unnest([0, 1, 2, 3, 4]) AS bound)")
def approx_quantiles(t, spark):
    """Each bound of the sketch has about its share of rows below it: within twice the sketch's 1/accuracy, but for ties."""
    rows = t("lineitem").select("l_returnflag", "l_extendedprice")
    sketch = rows.groupBy("l_returnflag").agg(G.approx_quantiles(F.col("l_extendedprice"), 4, 1000).alias("q"))
    both = rows.join(sketch, "l_returnflag")
    below = [F.sum((F.col("l_extendedprice") < F.get("q", F.lit(i))).cast("long")).alias(f"b{i}") for i in range(5)]
    upto = [F.sum((F.col("l_extendedprice") <= F.get("q", F.lit(i))).cast("long")).alias(f"u{i}") for i in range(5)]
    counts = both.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), *below, *upto)
    near = lambda i: (F.col(f"b{i}") <= F.col("n") * (i / 4 + 0.002) + 1) & (F.col(f"u{i}") >= F.col("n") * (i / 4 - 0.002) - 1)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("bound"), near(i).alias("near")) for i in range(5)])).alias("x")
    return counts.select("l_returnflag", each).select("l_returnflag", "x.bound", "x.near")


@query("SELECT l_returnflag AS item, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, item LIMIT 2")
def approx_top(t, spark):
    """APPROX_TOP_COUNT: exact while the distinct items fit the sketch."""
    top = t("lineitem").agg(F.explode(F.expr("approx_top_k(l_returnflag, 2)")).alias("x"))
    return top.select("x.item", F.col("x.count").alias("n"))


@query("SELECT l_suppkey AS item, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, item LIMIT 3")
def approx_top_sum(t, spark):
    """APPROX_TOP_SUM, exactly: sums by item, of which each task keeps three."""
    sums = t("lineitem").groupBy(F.col("l_suppkey").alias("item")).agg(F.sum("l_quantity").alias("s"))
    return sums.orderBy(F.desc("s"), "item").limit(3).select("item", _r(F.col("s"), 2, "total"))


@query("SELECT count(DISTINCT user_id) AS users, true AS near FROM events")
def hll_merge(t, spark):
    """Sketches by day, merged, as a rollup table would hold them, beside the exact count."""
    day = t("events").groupBy(F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id").alias("sketch"))
    sketch = day.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
    exact = t("events").agg(F.countDistinct("user_id").alias("users"))
    return exact.join(F.broadcast(sketch)).select("users", (F.abs(F.col("about") - F.col("users")) <= 0.07 * F.col("users")).alias("near"))  # one row each


@query("SELECT o_custkey, round(exp(avg(ln(o_totalprice))), 4) AS mean FROM orders GROUP BY 1")
def udaf(t, spark):
    """A user's aggregate as a function of columns: mergeable parts, combined before the shuffle."""
    geometric = lambda c: F.exp(F.avg(F.ln(c)))
    return t("orders").groupBy("o_custkey").agg(_r(geometric(F.col("o_totalprice")), 4, "mean"))
