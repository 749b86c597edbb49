"""Operator 1: quality classifier from two zstandard dictionaries.

One dictionary is trained on good labelled text and one on bad.  A text is cut into blocks; each block is compressed with
either dictionary, and the difference of the two total sizes over the text's own size is turned into a probability by a logistic
calibration that was fitted on whole labelled texts kept apart from the dictionaries.

Training takes a bounded number of labelled rows and all of each one's text: tasks count, in mergeable tables, in how many texts of a label
each hashed byte string occurs, score every block of every text by the strings that it shares with others (over the text's number of blocks, so
that a long text has no more voice than a short one), and the best block of each of EPOCHS hash groups reaches the trainer.

Defined results: null and empty texts have difference 0 and so get the calibration's value there; a document labelled both
ways is not learned from; of unlike texts under one labelled id the one of lowest hash is learned from; with no label of a kind
the score is 0.5 throughout; repeated rows each get a score; other columns pass through, a column that is already called `score` is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_sample, remainder, small_batches, staged

#: Bytes of a counted string, counters of a label, and groups of blocks whose best one is trained on.
STRING, SLOTS, EPOCHS = 8, 1 << 16, 4096


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    bias: float
    block: int = 256
    level: int = 3


def _blocks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


class Scorer:
    """Compressed-size differences of whole texts under a model's two dictionaries."""

    def __init__(self, model: QualityModel):
        import zstandard

        def compressor(raw: bytes):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=model.level)
            return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)

        self.model = model
        self.sides = [compressor(model.good), compressor(model.bad)] if model.good and model.bad else []

    def difference(self, text: str | None) -> float:
        if not text or not self.sides:
            return 0.0
        blocks = _blocks(text.encode("utf-8", "replace"), self.model.block)
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.sides)
        return (bad - good) / sum(map(len, blocks))

    def score(self, text: str | None) -> float:
        z = self.model.slope * self.difference(text) + self.model.bias
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted; slope and bias by damped Newton steps with a small ridge; a one-sided y gives slope 0."""
    if len(x) == 0 or y.min() == y.max():
        return 0.0, 0.0
    scale = float(np.abs(x).max()) or 1.0
    a = np.column_stack([x / scale, np.ones_like(x)])
    w = np.zeros(2)
    ridge = np.diag([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (p - y)) + ridge @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _train_dictionary(samples: list[bytes], size: int) -> bytes:
    import zstandard

    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer: their raw bytes serve as the dictionary
        return b"".join(samples)[-size:]


def string_slots(data: bytes) -> np.ndarray:
    """The counter of the string of STRING bytes at each place of data."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(raw) - STRING + 1
    if n < 1:
        return np.zeros(0, np.int64)
    word = np.zeros(n, np.uint64)
    for i in range(STRING):
        word |= raw[i : i + n] << np.uint64(8 * i)
    return ((word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)


def text_slots(data: bytes, part: int = 1 << 20) -> np.ndarray:
    """Which counters a text's strings have, in parts so that a giant text takes little memory."""
    seen = np.zeros(SLOTS, bool)
    for i in range(0, len(data), part):
        seen[string_slots(data[i : i + part + STRING - 1])] = True
    return seen


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(q, slot, n): in how many of a task's texts of label q the slot occurs; 2 * SLOTS rows at most."""
    total = np.zeros((2, SLOTS), np.int64)
    for part in batches:
        for q, t in zip(part["q"], part["text"], strict=True):
            total[q] += text_slots(t.encode("utf-8", "replace"))
    for q in (0, 1):
        at = np.flatnonzero(total[q])
        yield pd.DataFrame({"q": q, "slot": at, "n": total[q][at]})


def best_blocks(rows: DataFrame, counts: np.ndarray, block: int) -> DataFrame:
    """(q, epoch, best): of each label and hash group of blocks of rows (q, key, text), the block (score, bytes) that shares most with other texts.

    `counts` is (2, SLOTS); a string of one text alone counts nothing.
    """
    sent = rows.sparkSession.sparkContext.broadcast(np.maximum(counts - 1, 0).astype(np.uint32))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for part in batches:
            for q, key, t in zip(part["q"], part["key"], part["text"], strict=True):
                data = t.encode("utf-8", "replace")
                for a in range(0, len(data), block << 12):
                    own = _blocks(data[a : a + (block << 12)], block)
                    worth = [int(sent.value[q][string_slots(b)].sum()) / -(-len(data) // block) for b in own]
                    epoch = [xxhash.xxh32_intdigest(f"{key} {a + i}") % EPOCHS for i in range(0, len(own) * block, block)]
                    found = pd.DataFrame({"q": q, "epoch": epoch, "worth": worth, "bytes": own})
                    yield found.sort_values(["worth", "bytes"]).drop_duplicates("epoch", keep="last")

    found = rows.mapInPandas(scored, "q int, epoch int, worth double, bytes binary")
    return found.groupBy("q", "epoch").agg(F.max(F.struct("worth", "bytes")).alias("best"))


def fit(docs: DataFrame, labels: DataFrame, docs_per_label: int = 2000, dictionary_bytes: int = 112_640, block: int = 256) -> QualityModel:
    """Learns from the whole texts of at most `docs_per_label` documents of each label, whose labels rows the caller has chosen.

    Dictionaries of either half of them measure the whole texts of the other half, in tasks, for the calibration; the final ones are of all.  The
    driver gathers 2 * SLOTS counts, at most 2 * EPOCHS blocks (2 MB) and a number for each text.
    """
    kinds = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
        .where("q = q2")
        .select("doc_id", "q")
    )
    small_batches(docs.sparkSession)
    share = {r["q"]: r["count"] for r in kinds.groupBy("q").count().collect()}  # two rows at most
    chosen = bounded_sample(kinds, "q", docs_per_label)
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    found = docs.where("text is not null and text <> ''").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * docs_per_label rows
    rows = staged(found.groupBy("doc_id").agg(F.any_value("q").cast("int").alias("q"), one).select("q", F.col("doc_id").cast("string").alias("key"), "text"), "quality")
    half = F.pmod(F.xxhash64("key"), F.lit(2))
    size = {(r["q"], r["half"]): r["count"] for r in rows.groupBy("q", half.alias("half")).count().collect()}  # four rows at most
    if len({q for q, _ in size}) < 2:
        return QualityModel(b"", b"", 0.0, 0.0, block)

    def dictionaries(some: DataFrame) -> tuple[bytes, bytes]:
        sums = some.mapInPandas(_counted, "q int, slot int, n long").groupBy("q", "slot").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((2, SLOTS), np.int64)
        counts[sums["q"], sums["slot"]] = sums["n"]
        blocks = sorted((r["q"], r["epoch"], bytes(r["best"]["bytes"])) for r in best_blocks(some, counts, block).collect())
        return tuple(_train_dictionary([b for q, _, b in blocks if q == side], dictionary_bytes) for side in (1, 0))

    def differences(some: DataFrame, good: bytes, bad: bytes) -> pd.DataFrame:
        rough = QualityModel(good, bad, 1.0, 0.0, block)

        @pandas_udf("double")
        def difference(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            scorer = Scorer(rough)
            for texts in batches:
                yield pd.Series([scorer.difference(t) for t in texts], dtype="float64")

        return some.select("q", "key", difference("text").alias("x")).toPandas()

    good, bad = dictionaries(rows)
    if len(size) < 4:  # a few texts: they serve for both
        seen = differences(rows, good, bad)
    else:
        seen = pd.concat([differences(rows.where(half == k), *dictionaries(rows.where(half != k))) for k in (0, 1)])
    seen = seen.sort_values(["q", "key"])
    x, y = seen["x"].to_numpy(), seen["q"].to_numpy().astype(float)
    weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())  # the labels' own shares, not those of the sample
    slope, bias = _logistic(x, y, weight / weight.mean())
    return QualityModel(good, bad, slope, bias, block)


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """docs with a column `score` in 0 to 1, higher where label 1 is likelier.  The model is under 0.2 MB."""

    small_batches(docs.sparkSession)

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", scored.asNondeterministic()(F.col(text)))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(remainder("doc_id", 4) != 2))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
