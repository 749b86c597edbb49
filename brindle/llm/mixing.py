"""Operator 6: mixing sources to target weights by hash-threshold histograms.

Every row has a fixed hash of its id and all its other columns.  A source takes its rows in hash order up to its budget; the threshold is found
without sorting: tokens are summed by source and leading hash digit, the digit in which the running sum crosses the budget is refined by
the next digit, and so on until a single hash value is left.  Rows of that value are equal in all columns, so it does not matter which
of them are taken: they are counted, and as many are taken as bring the source nearest its target.  Budgets nest: a larger target keeps
what a smaller one took.  A target beyond the source's size takes every row once and applies the budget to second copies.

Defined results: a null text has size 0 and is taken as its hash says; null sources form one source, the last; rows with equal
ids are taken apart if they differ in another column; with no words at all every target is 0; an empty table gives an empty table;
columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

#: Hash digits: levels of refinement times bits of each.
LEVELS, BITS = 5, 12
#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def row_hash(docs: DataFrame, key: str) -> Column:
    """60 bits of the MD5 of the id and the other columns, in order of their names, as a long.  Nulls count as a control character."""
    scalar = lambda f: f.dataType.typeName() not in ("array", "struct", "map", "variant")
    value = lambda f: docs[f.name].cast("string") if scalar(f) else F.to_json(F.struct(docs[f.name]))
    fields = sorted(docs.schema.fields, key=lambda f: (f.name != key, f.name))
    whole = F.concat_ws("\x1f", *[F.coalesce(value(f), F.lit("\x1e")) for f in fields])
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, total_share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size).

    Sharing by weight, stopping at `most` times the size and resharing the excess ends where every target is the lesser of
    that stop and one common rate times the weight; with the sources by stop over weight, the rate is that of the first
    source that the rest can serve in full.  One row a source: windows over this table are small.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("_n", F.row_number().over(order)).withColumn("_w", w).withColumn("_stop", most * F.col("source_size"))
    every = Window.partitionBy()
    by = Window.orderBy(F.col("_stop") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("_all", total_share * F.sum("source_size").over(every))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_stop").over(by), F.lit(0.0)))
        .withColumn("_weight_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(by), F.lit(0.0)))
    )
    rate = F.col("_left") / F.col("_weight_left")
    fits = F.when(rate * F.col("_w") <= F.col("_stop"), rate)
    rows = rows.withColumn("_rate", F.max(fits).over(every))
    return rows.select("source", "source_size", F.least(F.col("_stop"), F.coalesce(F.col("_rate") * F.col("_w"), F.col("_stop"))).alias("target"))


def thresholds(hashed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, budget, edge, take): a source takes the hashes below edge, and `take` of the rows whose hash is edge.

    hashed: (source, h, size); budgets: (source, budget).  Each level aggregates before its shuffle, to 2**BITS rows a source at most, and
    only reads on the boundary digit.
    """
    here = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * BITS
        digit = F.shiftright("h", shift)
        edge = here.withColumnRenamed("source", "_s")  # staged, one row a source: Spark broadcasts it if its files are small
        bins = (
            hashed.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
            .groupBy("source", "budget", "below", digit.alias("digit"))
            .agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
        )
        upto = Window.partitionBy("source").orderBy("digit")
        run = bins.withColumn("upto", F.col("below") + F.sum("n").over(upto)).withColumn("before", F.col("upto") - F.col("n"))
        # the boundary: the first digit whose end reaches the budget, else the last digit that has documents
        short = F.col("upto") < F.col("budget")
        first = Window.partitionBy("source").orderBy(short, F.when(short, -F.col("digit")).otherwise(F.col("digit")))
        run = run.withColumn("_k", F.row_number().over(first)).where("_k = 1")
        here = staged(run if level == LEVELS else run.select("source", "budget", F.col("digit").alias("prefix"), F.col("before").alias("below")), "mix")
    share = F.when(F.col("n") > 0, (F.col("budget") - F.col("before")) * F.col("rows") / F.col("n")).otherwise(0.0)
    take = F.least(F.col("rows"), F.greatest(F.lit(0), F.floor(share + 0.5))).cast("long")
    return here.select("source", "budget", F.col("digit").alias("edge"), take.alias("take"))


def _rows(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(row, id, source, size, h) of docs: their columns are inside `row`, so that none clashes."""
    return docs.select(F.struct(*docs.columns).alias("row"), docs[key].alias("id"), docs[source].alias("source"), word_count(docs[text]).alias("size"), row_hash(docs, key).alias("h"))


def rules(rows: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(hashed rows (id, source, size, h), one staged rule a source (_source, source_size, target, edge, take))."""
    hashed = staged(rows.select("id", "source", "size", "h"), "mix")
    sizes = hashed.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = staged(targets(sizes, **how), "mix")
    budget = F.when(F.col("target") > F.col("source_size"), F.col("target") - F.col("source_size")).otherwise(F.col("target"))
    edges = thresholds(hashed, goal.select("source", budget.alias("budget")))
    same = goal["source"].eqNullSafe(edges["source"])
    rule = goal.join(edges, same, "left").select(goal["source"].alias("_source"), "source_size", "target", "edge", "take")
    return hashed, staged(rule, "mix")


#: Equal rows that one task makes of a count.
TOGETHER = 10_000


def _repeated(counted: DataFrame, n: str) -> DataFrame:
    """Each row `n` times: large counts are cut into parts that go to several tasks."""
    parts = F.sequence(F.lit(0), F.floor((F.col(n) - 1) / TOGETHER).cast("int"))
    cut = counted.where(F.col(n) > 0).withColumn("_part", F.explode(parts))
    cut = cut.withColumn("_times", F.least(F.lit(TOGETHER), F.col(n) - F.col("_part") * TOGETHER).cast("int")).repartition(F.xxhash64("h", "_part"))
    return cut.withColumn("_time", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).drop("_part", "_times", "_time")


def _taken(rows: DataFrame, rule: DataFrame, what: list[str]) -> DataFrame:
    """(what, source_size, target, copies) of each row: how often the mix takes it."""
    joined = rows.join(rule, F.col("source").eqNullSafe(F.col("_source")))
    every = F.when(F.col("target") > F.col("source_size"), 1).otherwise(0)
    here = F.col("h") == F.col("edge")
    out = [*what, "source_size", "target"]
    plain = joined.where(~here).select(*out, (every + F.when(F.col("h") < F.col("edge"), 1).otherwise(0)).cast("long").alias("copies"))
    # of each source the rows of one hash value, all equal: counted before they are shuffled
    equal = staged(joined.where(here).groupBy("_source", "h").agg(*[F.any_value(c).alias(c) for c in (*out, "take")], F.count(F.lit(1)).alias("rows")), "mix")
    more = _repeated(equal.withColumn("n", F.col("take")), "n").select(*out, (every + 1).cast("long").alias("copies"))
    rest = _repeated(equal.withColumn("n", F.col("rows") - F.col("take")), "n").select(*out, every.cast("long").alias("copies"))
    return plain.union(more).union(rest)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """(key, size, source_size, target, copies): how often the mix takes each document."""
    hashed, rule = rules(_rows(docs, key, source, text), **how)
    return _taken(hashed, rule, ["id", "size"]).select(F.col("id").alias(key), "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with the columns of docs."""
    rows = _rows(docs, key, source, text)
    _, rule = rules(rows, **how)
    taken = _taken(rows.select("row", "source", "h"), rule, ["row"])
    return taken.withColumn("_time", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
        ('0x' || substr(md5(concat_ws(chr(31), {', '.join(f"coalesce({c}::VARCHAR, chr(30))" for c in ('doc_id', 'lang', 'n_chars', 'source', 'text'))})), 1, 15))::BIGINT AS h
        FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n, 2.0::DOUBLE * source_size AS stop FROM s),
w AS (SELECT *, ([3, 1, 2])[(n - 1) % 3 + 1]::DOUBLE AS w FROM n),
l AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)
        - coalesce(sum(stop) OVER (ORDER BY stop / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY stop / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w FROM w),
r AS (SELECT *, max(rest / rest_w) FILTER (rest / rest_w * w <= stop) OVER () AS rate FROM l),
t AS (SELECT source, source_size, least(stop, coalesce(rate * w, stop)) AS target FROM r),
b AS (SELECT *, CASE WHEN target > source_size THEN target - source_size ELSE target END AS budget FROM t),
c AS (SELECT d.*, b.source_size, b.target, b.budget, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
        sum(size) OVER (PARTITION BY d.source, h) AS own, count(*) OVER (PARTITION BY d.source, h) AS rows, row_number() OVER (PARTITION BY d.source, h) AS nth
        FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
e AS (SELECT source AS e_source, coalesce(min(h) FILTER (upto >= budget), max(h)) AS edge FROM c GROUP BY source)
SELECT doc_id, size, source_size, target, (size * ((target > source_size)::INT + CASE WHEN h < edge THEN 1 WHEN h > edge THEN 0
    WHEN own > 0 AND nth <= least(rows, greatest(0, floor((budget - (upto - own)) * rows / own + 0.5))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN e ON source IS NOT DISTINCT FROM e_source
"""
