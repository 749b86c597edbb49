"""Operator 10: LM scoring with an interpolated modified Kneser-Ney bigram model.

Tokens of a text: its words with A-Z lower-cased, then one end.  All counts cover every training text:

1. words are counted into 2**16 hash buckets, which gives the number of tokens and the buckets whose words are frequent;
2. tasks count bigrams and send them, as compressed blobs, to shards by context (those of frequent contexts by the whole bigram, so
   that no context makes a shard large);
3. each shard merges its blobs into sorted hash arrays of bigrams and of context statistics, and sends on, by word, what the
   unigram level needs: distinct left neighbours, counts, and its part of frequent contexts' statistics;
4. word shards merge those.

The arrays are .npy files in the shared folder; scoring workers memory-map them and look up each batch's distinct bigrams.  Words
and bigrams are known by 64-bit hashes; counts have 64 bits, those of bigrams under 255 one byte.  Files are written under a temporary name and
renamed, so a task may run again.

Defined results: a null text is the end token alone; with nothing to learn from, the base score is that of N = V = 0 and the model's
probability of every token is 1; repeated rows count as often as they occur and are scored each; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, shared_folder, small_batches, staged

BUCKETS = 1 << 16
#: Tokens of a shard, and tokens that a counting task holds before it sends them on.
SHARD_TOKENS, HELD = 4_000_000, 2_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STATS = np.dtype([("sum", "<u8"), ("n", "<u8", 3)])


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _hash(context * np.uint64(0x9E3779B97F4A7C15) + word)


def shard_of(x: np.ndarray, shards: int) -> np.ndarray:
    return ((_hash(x) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def bucket_of(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(48)).astype(np.int64)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, tokens of each text)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = [(t or "").encode("utf-8", "replace").translate(_LOWER).split() for t in texts]  # bytes.split: space and controls 9 to 13
    for w in words:
        w.append(b"")  # the end: no word is empty
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((digest(x) for w in words for x in w), np.uint64, int(size.sum()))
    return flat, size


def contexts(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    import xxhash

    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[np.cumsum(size) - size] = xxhash.xxh64_intdigest(b" ")  # the start: no word is a space
    return before


def _pack(*columns: np.ndarray) -> bytes:
    """A blob: each column as its distinct values and the places of the rows among them."""
    import zstandard

    parts = [np.array([len(columns), len(columns[0])], "<i8").tobytes()]
    for c in columns:
        values, place = np.unique(c, return_inverse=True)
        kind = "<u2" if len(values) <= 1 << 16 else "<u4"
        parts += [np.array([len(values), int(kind[-1])], "<i8").tobytes(), values.astype("<u8").tobytes()]
        bytes_of = place.astype(kind).view(np.uint8).reshape(len(place), -1)
        parts.append(np.ascontiguousarray(bytes_of.T).tobytes())  # equal bytes together
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    k, n = np.frombuffer(raw, "<i8", 2).tolist()
    at, columns = 16, []
    for _ in range(k):
        m, width = np.frombuffer(raw, "<i8", 2, at).tolist()
        values = np.frombuffer(raw, "<u8", m, at + 16)
        at += 16 + 8 * m
        place = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(f"<u{width}").ravel()
        at += n * width
        columns.append(values[place])
    return columns


def _local(path: str) -> str | None:
    """The path that open() takes, if the shared folder is a mounted one."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def _save(path: str, array: np.ndarray) -> None:
    """Writes an .npy file under a temporary name and renames it: whole or not at all."""
    temp = f"{path}.{uuid.uuid4().hex}"
    if local := _local(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        np.save(_local(temp) + ".npy", array)
        os.replace(_local(temp) + ".npy", local)
        return
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(place), recursive=True)
    beside = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as out:
        np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(array))
        out.write(memoryview(np.ascontiguousarray(array)).cast("B") if array.size else b"")
    system.move(beside, place)


def _open(path: str) -> np.ndarray:
    """Memory-mapped where the shared folder is mounted, which the model is made for; elsewhere a shard is read whole through pyarrow's file systems."""
    if local := _local(path):
        return np.load(local, mmap_mode="r")
    import io

    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as f:
        return np.load(io.BytesIO(f.readall()))


def _sum_by(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], [np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns]


def _statistics(context: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of counts, and number of continuations counted once, twice and oftener, of each context."""
    keys, (total, one, two, more) = _sum_by(context, count, (count == 1).astype(np.uint64), (count == 2).astype(np.uint64), (count > 2).astype(np.uint64))
    return keys, np.stack([total, one, two, more], axis=1) if len(keys) else np.zeros((0, 4), np.uint64)


def _as_stats(table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(table), _STATS)
    out["sum"], out["n"] = table[:, 0], table[:, 1:]
    return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of n-grams counted 1 to 4 times; 0.5, 1 and 1.5 if one of them is 0."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(min(max(d, 0.0), float(k)) for k, d in zip((1, 2, 3), raw, strict=True))


@dataclass(frozen=True)
class KneserNey:
    """A model: numbers, and where its arrays are."""

    folder: str
    shards: int
    frequent: np.ndarray  # of each bucket, whether its contexts are spread over shards
    tokens: int
    words: int
    types: int  # distinct bigrams
    continuations: tuple[int, int, int]  # words with 1, 2, more left neighbours
    discount2: tuple[float, float, float]
    discount1: tuple[float, float, float]

    @cached_property
    def _files(self) -> dict:
        return {}

    def _array(self, name: str, shard: int) -> np.ndarray:
        if (name, shard) not in self._files:
            self._files[name, shard] = _open(f"{self.folder}/{name}-{shard}.npy")
        return self._files[name, shard]

    def _look_up(self, name: str, keys: np.ndarray, shard: np.ndarray, values: str, out: np.ndarray) -> None:
        """Fills out at the places of keys (ascending within each shard) that the sorted hash arrays `name` hold."""
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.unique(shard).tolist():
            own = order[cut[s] : cut[s + 1]]
            have = self._array(name, s)
            if not len(have):
                continue
            at = np.searchsorted(have, keys[own])
            at[at == len(have)] = 0
            hit = have[at] == keys[own]
            out[own[hit]] = self._array(values, s)[at[hit]]

    def score(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        flat, size = tokens(texts)
        before = contexts(flat, size)
        words, word_at = np.unique(flat, return_inverse=True)
        shard = shard_of(words, self.shards) if self.shards else np.zeros(len(words), np.int64)
        pair = np.zeros((len(words), 2), np.uint64)  # left neighbours, count
        if self.shards:
            self._look_up("words", words, shard, "word-counts", pair)
        left, count = pair[:, 0].astype(np.float64), pair[:, 1].astype(np.float64)
        n, v = self.tokens, self.words
        base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
        if not self.shards:
            score = np.zeros(len(flat))
        else:
            keys, first, gram_at = np.unique(gram(before, flat), return_index=True, return_inverse=True)
            context = before[first]
            often = self.frequent[bucket_of(context)]
            c = np.zeros(len(keys), np.uint64)
            gram_shard = np.where(often, shard_of(keys, self.shards), shard_of(context, self.shards))
            self._look_up("grams", keys, gram_shard, "gram-counts", c)
            full = np.flatnonzero(c == 255)
            if len(full):
                more = c[full]
                self._look_up("large", keys[full], gram_shard[full], "large-counts", more)
                c[full] = more
            ctx, ctx_at = np.unique(context, return_inverse=True)
            stats = np.zeros(len(ctx), _STATS)
            spread = self.frequent[bucket_of(ctx)]
            ctx_shard = shard_of(ctx, self.shards)
            for name, own in (("contexts", ~spread), ("frequent", spread)):
                some = np.flatnonzero(own)
                found = stats[some]
                self._look_up(name, ctx[some], ctx_shard[some], f"{name}-stats", found)
                stats[some] = found
            d2, d1 = np.array((0.0, *self.discount2)), np.array((0.0, *self.discount1))
            spare = float(np.dot(self.continuations, d1[1:]))
            p1 = (np.maximum(left - d1[np.minimum(left, 3).astype(int)], 0) + spare / (v + 1)) / self.types
            stats = stats[ctx_at]
            p1 = p1[word_at][first]
            total = stats["sum"].astype(np.float64)
            kept = np.maximum(c.astype(np.float64) - d2[np.minimum(c, 3).astype(np.int64)], 0)
            p2 = (kept + (stats["n"] @ d2[1:]) * p1) / np.maximum(total, 1)
            score = np.log10(np.where(total > 0, p2, p1))[gram_at]
        at = np.cumsum(size) - size
        add = lambda x: np.add.reduceat(x, at) if len(at) else x[:0]
        return {"n_tokens": size, "n_known": add((count > 0).astype(np.int64)[word_at]), "base_score": add(base[word_at]), "score": add(score)}


def _groups(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of batches of about `most` characters, or one text."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        a, size = 0, 0
        for b, t in enumerate(texts):
            size += len(t or "") + 1
            if size >= most:
                yield batch.slice(a, b + 1 - a), texts[a : b + 1]
                a, size = b + 1, 0
        if a < len(texts):
            yield batch.slice(a), texts[a:]


def fit(docs: DataFrame, text: str = "text", shard_tokens: int = SHARD_TOKENS) -> KneserNey:
    """Learns from every text of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    texts = docs.select(F.col(text).alias("text"))

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, some in _groups(batches, 0, 4_000_000):
            total += np.bincount(bucket_of(tokens(some)[0]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = texts.mapInArrow(bucketed, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    total = int(sums["n"].sum())
    if not total:
        return KneserNey(folder, 0, np.zeros(BUCKETS, bool), 0, 0, 0, (0, 0, 0), (0.5, 1.0, 1.5), (0.5, 1.0, 1.5))
    shards = -(-total // shard_tokens)
    frequent = np.zeros(BUCKETS, bool)
    frequent[sums["bucket"][sums["n"] > shard_tokens // 16]] = True

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> pa.RecordBatch:
            context, word = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            held.clear()
            keys, first, count = np.unique(gram(context, word), return_index=True, return_counts=True)
            context, word = context[first], word[first]
            to = np.where(frequent[bucket_of(context)], shard_of(keys, shards), shard_of(context, shards))
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(shards + 1))
            own = [(s, order[cut[s] : cut[s + 1]]) for s in range(shards) if cut[s + 1] > cut[s]]
            blobs = [_pack(context[i], word[i], count[i]) for _, i in own]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in own], pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

        size = 0
        for _, some in _groups(batches, 0, 4_000_000):
            flat, sizes = tokens(some)
            held.append((contexts(flat, sizes), flat))
            size += len(flat)
            if size >= HELD:
                yield send()
                size = 0
        if held:
            yield send()

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
        """The blobs of each shard, unpacked; rows come sorted by shard."""
        now, parts = None, []
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if parts and s != now:
                    yield now, parts
                    parts = []
                now = s
                parts.append(_unpack(blob.as_py()))
        if parts:
            yield now, parts

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, parts in by_shard(batches):
            context, word, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
            parts.clear()
            key = gram(context, word)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.add.reduceat(count[order], first)
            key, context, word = key[first], context[order[first]], word[order[first]]
            _save(f"{folder}/grams-{s}.npy", key)
            _save(f"{folder}/gram-counts-{s}.npy", np.minimum(count, 255).astype(np.uint8))
            large = count >= 255
            _save(f"{folder}/large-{s}.npy", key[large])
            _save(f"{folder}/large-counts-{s}.npy", count[large].astype(np.uint64))
            often = frequent[bucket_of(context)]
            keys, stats = _statistics(context[~often], count[~often])
            _save(f"{folder}/contexts-{s}.npy", keys)
            _save(f"{folder}/contexts-stats-{s}.npy", _as_stats(stats))
            many, partial = _statistics(context[often], count[often])
            words, (left, seen) = _sum_by(word, np.ones(len(word), np.uint64), count)
            of = [int((count == k).sum()) for k in (1, 2, 3, 4)]
            # kind 0: a word's left neighbours and count; kind 1: part of a frequent context's statistics
            for kind, own, table in ((0, words, np.stack([left, seen], axis=1)), (1, many, partial)):
                to = shard_of(own, shards)
                for t in np.unique(to).tolist():
                    i = to == t
                    blob = _pack(own[i], *table[i].T)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t], pa.int32()), pa.array([blob], pa.binary()), pa.array([kind], pa.int32()), pa.array([of], pa.list_(pa.int64()))],
                        ["shard", "blob", "kind", "of"],
                    )
                    of = [0, 0, 0, 0]

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kinds() -> Iterator[tuple[int, int, list]]:
            now, parts = None, []
            for batch in batches:
                for s, blob, kind in zip(*(batch.column(i) for i in range(3)), strict=True):
                    at = (s.as_py(), kind.as_py())
                    if parts and at != now:
                        yield *now, parts
                        parts = []
                    now = at
                    parts.append(_unpack(blob.as_py()))
            if parts:
                yield *now, parts

        for s, kind, parts in kinds():
            columns = [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))]
            keys, sums = _sum_by(*columns)
            if kind == 1:
                _save(f"{folder}/frequent-{s}.npy", keys)
                _save(f"{folder}/frequent-stats-{s}.npy", _as_stats(np.stack(sums, axis=1)))
                continue
            left, count = sums
            _save(f"{folder}/words-{s}.npy", keys)
            _save(f"{folder}/word-counts-{s}.npy", np.stack([left, count], axis=1).astype(np.uint64))
            row = [len(keys), int(left.sum()), *(int((left == k).sum()) for k in (1, 2, 3, 4)), int((left > 2).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["words", "types", "c1", "c2", "c3", "c4", "more"])

    def empty(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards that nothing is sent to have empty arrays."""
        for batch in rows:
            for s in batch.column(0).to_pylist():
                for name, kind in (("grams", "<u8"), ("large", "<u8"), ("contexts", "<u8"), ("words", "<u8"), ("frequent", "<u8")):
                    _save(f"{folder}/{name}-{s}.npy", np.zeros(0, kind))
            yield batch

    spark.range(shards).mapInArrow(empty, "id long").write.format("noop").mode("overwrite").save()
    sent = texts.mapInArrow(counted, "shard int, blob binary")
    spread = sent.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")  # one shard a task
    parts = staged(spread.mapInArrow(merged, "shard int, blob binary, kind int, of array<long>"), "lm")
    summary = parts.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind").select("shard", "blob", "kind")
    names = ["words", "types", "c1", "c2", "c3", "c4", "more"]
    done = summary.mapInArrow(finished, ", ".join(f"{n} long" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
    of = parts.agg(*[F.sum(F.get("of", i)).alias(f"n{i}") for i in range(4)]).first()
    return KneserNey(
        folder, shards, frequent, total, done["words"], done["types"], (done["c1"], done["c2"], done["more"]),
        discounts(list(of)), discounts([done[c] for c in ("c1", "c2", "c3", "c4")]),
    )


def perplexity_scores(docs: DataFrame, model: KneserNey, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score): log10 probabilities; 10 ** (-score / n_tokens) is the perplexity."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _groups(batches, 1, 4_000_000):
            found = model.score(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in found.values())], [key, *found])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(scored, f"`{key}` {kind}, n_tokens long, n_known long, base_score double, score double")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.where(remainder("doc_id", 10) != 0))
    return perplexity_scores(docs, model).select(
        "doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
