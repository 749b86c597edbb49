"""The text tables, by plain relational operators."""

from pyspark.sql import functions as F

from . import query


@query("SELECT lang, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 4) AS mean FROM documents GROUP BY 1")
def doc_len_stats(t, spark):
    n = F.length("text").cast("bigint")
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def exact_dup_docs(t, spark):
    """Only the digest is shuffled, not the text."""
    by = t("documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest")).groupBy("digest")
    return by.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").select("doc_id", "n")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def lang_counts(t, spark):
    return t("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT lang, quality, count(*) AS n, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def label_join(t, spark):
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.sum("toxic").cast("bigint").alias("toxic"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def conv_turns(t, spark):
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.sum(F.length("text")).alias("chars"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, count(*) AS n, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1")
def page_hosts(t, spark):
    host = F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1)
    return t("pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def top_words(t, spark):
    words = t("documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)
