"""A training-data pipeline over `documents`: stages that each apply one operator to all that their predecessor kept.

Every stage takes an empty table (and gives one), columns of any name, and rows whose id is null or repeated: a row is judged by its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import language, mixing, pieces, quality, simhash
from brindle.llm.common import remainder, staged

#: Least quality score, and least share of letters in the main language, of a document that stays.
QUALITY, ONE_LANGUAGE = 0.5, 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below QUALITY.

    Null and empty texts have the score of a text that neither dictionary knows (the calibration's value at 0), so either all of them stay or none;
    equal rows have equal scores; without labels of both kinds every score is 0.5 and all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 4) != 2)
    return quality.score(docs, quality.fit(docs, labels)).where(F.col("score") >= QUALITY).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (so null and empty texts), or of no language that has ONE_LANGUAGE of their letters; equal texts fare alike.

    Without any training text (a null lang teaches nothing) no language is known and no row stays.
    """
    found = language.identify(docs, language.fit(docs.where(remainder("doc_id", 3) != 1)))
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= ONE_LANGUAGE)).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the first by id, nulls last, then by the hashes of all columns.

    Texts without a word form one group; of rows equal in all columns one stays, and unlike texts under one id are documents each.
    """
    return simhash.keep_one(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target weight says: not, once or twice.

    A null source is one of its own, the last; null and empty texts have size 0 and are taken as their hash says; of equal rows as many are taken
    as bring the source nearest its target.
    """
    return mixing.mixed(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds `pieces`, the ids of each whole text: none for a null or empty one."""
    return pieces.encode(docs, str(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing", mixing_sources),
    ("sentencepiece", sentencepiece_ids),
]

#: Stages 1, 2 and 5 are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
