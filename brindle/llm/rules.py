"""Operator 8: quality rules with adaptive thresholds, DataFrame functions only.

Counts come from each whole text.  Of the texts that pass the base rules, four integer measures (per thousand words) go into
mergeable quantile sketches for each language and source: integer histograms whose bins keep seven leading bits, so a
sketch holds under 64 bins for each doubling, is wrong by under 1/64 of a value, and merges by adding counts.  A group's
cutoffs are its quartiles widened by a multiple of their distance and a slack; its quartiles are drawn towards those of the merged sketch
of all as if PRIOR texts of that sketch were among its own, so that a small group leans on all and a large one on itself, without a step between.

Defined results: a null text has no words and is not kept; null languages and sources are groups of their own; with no text
that passes the base rules nothing is kept; repeated rows are counted and judged each; an empty table gives an empty table;
columns of the input other than id, text, language and source are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Texts that the merged sketch weighs beside a group's own.
PRIOR = 50
#: Quartile distances by which a cutoff lies beyond a quartile.
WIDEN = 4
#: measure -> slack added beyond that, per thousand words (the length measure is in thousandths of a character).
SLACK = {"symbols": 150, "length": 400, "dup_lines": 30, "repeats": 350}


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long), over whole texts.

    Stage the result before filtering on it: Spark would push such a filter into the array functions and repeat them there.

    Repeated windows are found within the row: windows are hashed, sorted, and equal neighbours marked, so that nothing is
    shuffled and a text of n words costs n log n.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    hashes = F.transform(
        F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    pairs = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return (
        docs.withColumn("_words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("_hashes", hashes)
        .withColumn("_windows", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(pairs)).otherwise(none))
        .withColumn(
            "_found",
            F.filter(
                "_windows",
                lambda x, k: (F.coalesce(F.get("_windows", k - 1)["h"] == x["h"], F.lit(False)))
                | (F.coalesce(F.get("_windows", k + 1)["h"] == x["h"], F.lit(False))),
            ),
        )
        .withColumn("_at", F.sort_array(F.transform("_found", lambda x: x["i"])))
        .withColumn("_covers", F.transform("_at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - x, F.lit(3)))))
        .withColumn("n_repeat_words", F.aggregate("_covers", F.lit(0).cast("long"), lambda a, x: a + x))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .drop("_words", "_lines", "_hashes", "_windows", "_found", "_at", "_covers")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _measures() -> dict[str, Column]:
    rate = lambda c: F.expr(f"{c} * 1000 div greatest(n_words, 1)")
    return {"symbols": rate("n_symbols"), "length": rate("word_chars"), "dup_lines": rate("n_dup_lines"), "repeats": rate("n_repeat_words")}


def sketch(rows: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """A sketch for each key and measure: (keys, measure, bin, n).  Adding n by bin merges sketches."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in measures.items()]))
    low = F.expr("shiftleft(shiftright(x.v, greatest(0, length(bin(x.v)) - 7)), greatest(0, length(bin(x.v)) - 7))")
    return rows.select(*keys, each.alias("x")).groupBy(*keys, F.col("x.measure").alias("measure"), low.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, total, q1, q3) of sketches; a group has a few hundred bins at most, however many rows it counts."""
    over = Window.partitionBy(*keys, "measure")
    ranked = sketches.withColumn("total", F.sum("n").over(over)).withColumn("upto", F.sum("n").over(over.orderBy("bin")))
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bin")))
    return ranked.groupBy(*keys, "measure").agg(F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))


def _cutoffs(found: DataFrame, keys: list[str]) -> DataFrame:
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])[F.col("measure")]
    reach = WIDEN * (F.col("q3") - F.col("q1")) + slack
    out = []
    for m in SLACK:
        out.append(F.max(F.when(F.col("measure") == m, F.col("q3") + reach)).alias(f"{m}_most"))
    out.append(F.max(F.when(F.col("measure") == "length", F.col("q1") - reach)).alias("length_least"))
    return found.groupBy(*keys).agg(*out)


def judge(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """counted (text_counts and the group columns, without the texts) with base_failed and kept; columns of these names are replaced.

    The counts are staged first: they are read twice, and Spark would push the filters on them into the array functions.

    The cutoffs join on language and source; their table has a row for each group, and Spark broadcasts it only if its measured
    size is under the session's threshold, else both sides are shuffled and a hot group is split by AQE.
    """
    own = counted.drop("base_failed", "kept")
    of = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = staged(own.select(F.struct(*own.columns).alias("row"), *[own[c].alias(c) for c in of], own[lang].alias("lang"), own[source].alias("source")), "rules")
    rows = rows.withColumn("base_failed", base_failed())
    m = _measures()
    keys = ["lang", "source"]
    groups = sketch(rows.where(~F.col("base_failed")).select(*keys, *[v.alias(k) for k, v in m.items()]), keys, {k: F.col(k) for k in m})
    every = quartiles(groups.groupBy("measure", "bin").agg(F.sum("n").alias("n")), [])
    every = every.select(F.col("measure").alias("of"), F.col("q1").alias("all1"), F.col("q3").alias("all3"))  # a row a measure
    drawn = lambda q, a: F.expr(f"(total * {q} + {PRIOR} * {a}) div (total + {PRIOR})")
    near = quartiles(groups, keys).join(every, F.col("measure") == F.col("of")).select(*keys, "measure", drawn("q1", "all1").alias("q1"), drawn("q3", "all3").alias("q3"))
    cut = _cutoffs(near, keys).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = rows.join(cut, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    kept = ~F.col("base_failed") & (m["length"] >= F.col("length_least"))
    for k in m:
        kept = kept & (m[k] <= F.col(f"{k}_most"))
    return joined.select("row.*", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = text_counts(docs.select("doc_id", "lang", "source", "text")).drop("text")
    return judge(counted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS three FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
p AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, three) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + o AS at FROM p, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[{SYMBOLS}]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols * 1000 // greatest(n_words, 1) AS symbols,
        word_chars * 1000 // greatest(n_words, 1) AS length, n_dup_lines * 1000 // greatest(n_words, 1) AS dup_lines,
        n_repeat_words * 1000 // greatest(n_words, 1) AS repeats FROM c),
x AS (SELECT lang, source, measure, v, greatest(0, length(bin(v)) - 7)::INT AS k FROM (
        SELECT lang, source, 'symbols' AS measure, symbols AS v FROM m WHERE NOT base_failed UNION ALL
        SELECT lang, source, 'length', length FROM m WHERE NOT base_failed UNION ALL
        SELECT lang, source, 'dup_lines', dup_lines FROM m WHERE NOT base_failed UNION ALL
        SELECT lang, source, 'repeats', repeats FROM m WHERE NOT base_failed)),
b AS (SELECT false AS every, lang, source, measure, (v >> k) << k AS bin, count(*) AS n FROM x GROUP BY ALL UNION ALL
      SELECT true, NULL, NULL, measure, (v >> k) << k, count(*) FROM x GROUP BY ALL),
q AS (SELECT every, lang, source, measure, max(total) AS total, min(bin) FILTER (4 * upto >= total) AS q1, min(bin) FILTER (4 * upto >= 3 * total) AS q3
      FROM (SELECT *, sum(n) OVER (PARTITION BY every, lang, source, measure) AS total,
                sum(n) OVER (PARTITION BY every, lang, source, measure ORDER BY bin) AS upto FROM b) GROUP BY ALL),
z AS (SELECT o.lang, o.source, o.measure, (o.total::BIGINT * o.q1 + {PRIOR} * e.q1) // (o.total::BIGINT + {PRIOR}) AS q1,
        (o.total::BIGINT * o.q3 + {PRIOR} * e.q3) // (o.total::BIGINT + {PRIOR}) AS q3
      FROM (SELECT * FROM q WHERE NOT every) o JOIN (SELECT * FROM q WHERE every) e ON o.measure = e.measure),
s AS (SELECT *, {WIDEN} * (q3 - q1) + CASE measure {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SLACK.items())} END AS reach FROM z),
t AS (SELECT lang, source, max(q3 + reach) FILTER (measure = 'symbols') AS t_symbols, max(q3 + reach) FILTER (measure = 'length') AS t_length,
        max(q3 + reach) FILTER (measure = 'dup_lines') AS t_dup, max(q3 + reach) FILTER (measure = 'repeats') AS t_rep,
        max(q1 - reach) FILTER (measure = 'length') AS t_least FROM s GROUP BY ALL)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    coalesce(NOT base_failed AND symbols <= t_symbols AND length <= t_length AND dup_lines <= t_dup AND repeats <= t_rep AND length >= t_least, false) AS kept
FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""
