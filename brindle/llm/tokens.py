"""Operator 4: token ids in binary files, compressed by Re-Pair grammars.

Documents are range-partitioned and sorted by id, encoded, and packed into shards of consecutive documents.  In each shard the
frequent pairs of neighbouring symbols are replaced by nonterminals, round after round until no pair occurs LEAST times; no pair spans two
documents.  A shard is a row of a Parquet file (so that Spark writes, commits and retries it on any file system) with its first and last
document id, which let a reader skip files, and these binary sections, all little-endian:

    doc_id int64, n_tokens int64 and n_symbols int64 of each document; rounds int64: rules after each round;
    left and right uint32: the two symbols of each rule (rule r is symbol first_rule + r); expansion uint32: ids that it stands for;
    sequence uint32: the symbols of all documents

A document is decoded alone: its place in the sequence is a sum of n_symbols, and rules hold what they expand to.

Defined results: a null text is empty; each document ends with the end id; null ids are written first, as the smallest int64, and read back as null; rows
with equal ids are ordered by their texts' hash and then text, written each, and spread over tasks if they are many; a document longer than a shard is a shard of its own;
an empty table gives no shards; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, single_threaded, small_batches, staged

END = 2
NULL_ID = -(1 << 63)
#: Tokens that a shard is closed after; least count of a pair that is replaced.
SHARD_TOKENS, LEAST = 1 << 19, 8
#: Counters of a round, and multipliers of their hashes.
SLOTS, ODD = 1 << 18, np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
SCHEMA = (
    "part int, shard int, first_id long, last_id long, first_rule long, tokens long, doc_id binary, n_tokens binary, n_symbols binary, rounds binary, "
    "left binary, right binary, expansion binary, sequence binary"
)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start[0] .. start[0]+count[0]-1, start[1] .., as one array."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


#: Multipliers of the unit hash, one for each of the first bytes; longer units are not kept.
_LONGEST_UNIT = 64
_FACTORS = np.random.default_rng(5).integers(0, 1 << 64, (2, _LONGEST_UNIT + 1), dtype=np.uint64)


def unit_hashes(units: pa.Array) -> np.ndarray:
    """64-bit hashes of strings (bytes times position factors, summed twice and mixed); 0 for empty and for long ones."""
    units = units.cast(pa.large_string())
    offsets = np.frombuffer(units.buffers()[1], np.int64, len(units) + 1, 8 * units.offset)
    if not len(units) or offsets[-1] == offsets[0]:
        return np.zeros(len(units), np.uint64)
    size = np.diff(offsets)
    data = np.frombuffer(units.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    place = np.minimum(np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size), _LONGEST_UNIT)
    some = np.flatnonzero(size)
    begin = (offsets[:-1] - offsets[0])[some]
    h = np.zeros(len(units), np.uint64)
    one, two = (np.add.reduceat((data + np.uint64(1)) * f[place], begin) for f in _FACTORS)
    mixed = (one ^ (one >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ ((two ^ (two >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) ^ size[some].astype(np.uint64)
    h[some] = np.where(size[some] <= _LONGEST_UNIT, np.maximum(mixed, np.uint64(1)), np.uint64(0))
    return h


class Encoder:
    """Byte-level BPE of the tokenizers library over whole texts.

    The pre-tokenizer never joins text across a space that stands between two other characters, so a text is the
    concatenation of its space-led units; each distinct unit goes to the library once and its ids are kept under a 64-bit hash, up to
    a bounded number of units.  Texts with adjacent white space, or with one of the library's added tokens, go to it whole.
    """

    #: White space that does not stand between two other characters.
    ADJACENT = r"[\s\x0b\x1c-\x1f\x85\pZ]{2}|^[\s\x0b\x1c-\x1f\x85\pZ]| $"

    def __init__(self, path: str, units: int = 2_000_000):
        single_threaded()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.added = "|".join(sorted(added, key=len, reverse=True))
        names = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.width = np.array([len(names.get(i, "")) for i in range(max(names) + 1)], np.int64)  # byte-level: a character a byte
        self._clear(units)

    def _clear(self, most: int) -> None:
        self.most = most
        self.known = np.zeros(0, np.uint64)  # ascending
        self.start, self.count, self.ids = np.zeros(0, np.int32), np.zeros(0, np.uint16), np.zeros(0, np.uint32)

    #: Pattern of the tokens that the library finds before it splits a text, none for "".
    added = ""

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of the units ' ' + word: some hundred units are encoded as one text and cut where the tokens' bytes end.

        The library's encodings are some hundred bytes a token, so few texts go to it at once.
        """
        bytes_of = pc.binary_length(words).to_numpy().astype(np.int64) + 1
        strings = words.to_pylist()
        texts = [" " + " ".join(strings[i : i + 256]) for i in range(0, len(strings), 256)]
        ids = np.concatenate([x for k in range(0, len(texts), 16) for x in self.whole(texts[k : k + 16])])
        first = np.cumsum(self.width[ids]) - self.width[ids]
        place = np.searchsorted(first, np.cumsum(bytes_of) - bytes_of)  # each unit's first token
        return ids, np.diff(np.append(place, len(ids)))

    def _learn(self, words: pa.Array, hashes: np.ndarray) -> None:
        if len(self.known) + len(words) > self.most:
            self._clear(self.most)
        ids, count = self.units(words)
        start = len(self.ids) + np.cumsum(count) - count
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, at, hashes[order])
        self.start = np.insert(self.start, at, start[order].astype(np.int32))
        self.count = np.insert(self.count, at, count[order].astype(np.uint16))
        self.ids = np.concatenate([self.ids, ids])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The places of hashes among those known, -1 for others."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        order = np.argsort(hashes)
        ascending = hashes[order]
        at = np.searchsorted(self.known, ascending)  # in order, for the caches' sake
        at[at == len(self.known)] = 0
        found = np.empty(len(hashes), np.int64)
        found[order] = np.where(self.known[at] == ascending, at, -1)
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (strings without nulls)."""
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        hashes = unit_hashes(words)
        if self.added:
            hashes[pc.match_substring_regex(words, self.added).to_numpy(zero_copy_only=False)] = 0
        blank = pc.utf8_is_space(words).to_numpy(zero_copy_only=False)
        found = self._find(hashes)
        fresh = np.flatnonzero((found < 0) & (hashes != 0) & ~blank)
        if len(fresh):
            cleared = len(self.known) + len(fresh) > self.most
            if cleared:
                self._clear(self.most)
                fresh = np.flatnonzero((hashes != 0) & ~blank)
            self._learn(words.take(pa.array(fresh)), hashes[fresh])
            found = self._find(hashes)
        unit = found[coded.indices.to_numpy()]
        first = offsets[:-1]
        unknown = unit < 0
        unknown[first] = False
        unit[first] = -1  # the place past the end: no ids
        start, count = np.append(self.start, 0)[unit], np.append(self.count, 0)[unit].astype(np.int64)
        flat = self.ids[ranges(start, count)]
        ends = np.cumsum(np.add.reduceat(count, first))
        strings = texts.to_pylist()
        # texts with other units than kept ones (long words), or with spaces that do not stand between two characters
        other = np.logical_or.reduceat(unknown, first)
        pattern = f"{self.ADJACENT}|{self.added}" if self.added else self.ADJACENT
        odd = np.flatnonzero(other | pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)).tolist()
        out = [np.concatenate([h, p]) for h, p in zip(self.heads([t.partition(" ")[0] for t in strings]), np.split(flat, ends[:-1]), strict=True)]
        for i, ids in zip(odd, self.whole([strings[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def heads(self, words: list[str]) -> list[np.ndarray]:
        """The ids of the texts' first words, which no space leads."""
        return self.whole(words)


@functools.lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    return Encoder(path)


def _frequent(seq: np.ndarray, at: np.ndarray, least: int, odd: np.uint64, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places among `at` where a pair begins that occurs `least` times among them, its number, the pairs).

    Counters are hashed; of frequent pairs that share one a single pair is found, unless `exact`.
    """
    code = (seq[at] << 32) | seq[at + 1]
    hashed = ((code.view(np.uint64) * odd) >> np.uint64(65 - SLOTS.bit_length())).view(np.int64)  # as counting and indexing take it
    may = (np.bincount(hashed, minlength=SLOTS) >= least)[hashed]
    at, code, hashed = at[may], code[may], hashed[may]
    if exact:
        pairs, number, counts = np.unique(code, return_inverse=True, return_counts=True)
    else:
        pairs = np.zeros(SLOTS, np.int64)
        pairs[hashed] = code
        own = pairs[hashed] == code
        at, number = at[own], hashed[own]
        counts = np.bincount(number, minlength=SLOTS)
    often = counts >= least
    hit = often[number]
    return at[hit], (np.cumsum(often) - 1)[number[hit]], pairs[often]


def repair(ids: np.ndarray, sizes: np.ndarray, first_rule: int, least: int = LEAST) -> dict:
    """Grammar of the documents whose ids are concatenated (sizes: ids of each).

    A round counts neighbouring pairs, gives the frequent ones nonterminals and replaces their occurrences left to right; of overlapping occurrences
    every second one is gone with its neighbours.  All other pairs then occur less often than `least`, so the next round looks at the places
    beside new symbols.  When it finds nothing, all places are counted exactly; rounds end when that finds no pair that occurs `least` times
    in places that do not overlap.
    """
    seq = ids.astype(np.int64)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    left, right, upto = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    expansion = [np.zeros(0, np.int64)]
    symbol = first_rule
    length = lambda s, known: np.where(s < first_rule, 1, known[np.maximum(s - first_rule, 0)]) if len(known) else np.ones(len(s), np.int64)
    places, exact, round_ = None, False, 0
    while len(seq) > 1:
        whole = np.flatnonzero(~last[:-1]) if places is None else places
        at, rule, pairs = _frequent(seq, whole, least, ODD[round_ % len(ODD)], exact)
        round_ += 1
        fresh = np.concatenate([[True], np.diff(at) != 1])[: len(at)]
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - begin) % 2 == 0
        at, rule = at[take], rule[take]
        enough = np.bincount(rule, minlength=len(pairs)) >= least  # of what is left after overlaps
        if not enough.any():
            if exact:
                break
            places, exact = None, True
            continue
        stays = enough[rule]
        at, rule, pairs = at[stays], (np.cumsum(enough) - 1)[rule[stays]], pairs[enough]
        seq[at] = symbol + rule
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
        new = at - np.arange(len(at))  # where the new symbols are now
        beside = np.zeros(len(seq), bool)
        beside[new] = True
        beside[new[new > 0] - 1] = True
        places = np.flatnonzero(beside & ~last)
        exact = False
        known = np.concatenate(expansion)
        left.append(pairs >> 32)
        right.append(pairs & 0xFFFFFFFF)
        expansion.append(length(left[-1], known) + length(right[-1], known))
        symbol += len(pairs)
        upto.append(symbol - first_rule)
    symbols = np.zeros(len(sizes), np.int64)
    symbols[sizes > 0] = np.diff(np.concatenate([[0], np.flatnonzero(last) + 1]))
    pack = lambda parts: np.concatenate(parts).astype("<u4").tobytes()
    return {
        "first_rule": first_rule, "tokens": int(sizes.sum()), "n_tokens": sizes.astype("<i8").tobytes(), "n_symbols": symbols.astype("<i8").tobytes(),
        "rounds": np.array(upto, "<i8").tobytes(), "left": pack(left), "right": pack(right), "expansion": pack(expansion), "sequence": seq.astype("<u4").tobytes(),
    }


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind).astype(np.int64)
        self.base = int(row["first_rule"])
        self.doc_id, self.n_tokens, self.n_symbols = (get(k, "<i8") for k in ("doc_id", "n_tokens", "n_symbols"))
        self.sequence, self.expansion = get("sequence", "<u4"), get("expansion", "<u4")
        self.place = np.concatenate([[0], np.cumsum(self.n_symbols)])
        left, right = get("left", "<u4"), get("right", "<u4")
        self.start = np.cumsum(self.expansion) - self.expansion
        self.ids = np.zeros(int(self.expansion.sum()), np.uint32)
        begin = 0
        for end in get("rounds", "<i8").tolist():  # a round's rules only use earlier rounds
            both = np.stack([left[begin:end], right[begin:end]], axis=1).ravel()
            a = int(self.start[begin]) if end > begin else 0
            expanded = self.expand(both)
            self.ids[a : a + len(expanded)] = expanded
            begin = end

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols - self.base
        own = rule >= 0
        at = np.maximum(rule, 0)
        count = np.where(own, self.expansion[at], 1) if len(self.expansion) else np.ones(len(symbols), np.int64)
        if not len(self.expansion):
            return symbols.astype(np.uint32)
        ends = np.cumsum(count)
        out = self.ids[ranges(np.where(own, self.start[at], 0), count)]
        out[(ends - count)[~own]] = symbols[~own]
        return out

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the shard, from its own symbols."""
        return self.expand(self.sequence[self.place[i] : self.place[i + 1]])

    def documents(self) -> list[np.ndarray]:
        return np.split(self.expand(self.sequence), np.cumsum(self.n_tokens)[:-1])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Writes docs (integer key, text) as shards under `path`, in ascending order of the key."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer)
        first_rule = encoder.library.get_vocab_size(with_added_tokens=True)
        first_rule = max(first_rule, end + 1)
        part, n = TaskContext.get().partitionId(), 0
        keys: list[int] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in ids], np.int64)
            row = {"part": part, "shard": n, "first_id": keys[0], "last_id": keys[-1], "doc_id": np.array(keys, "<i8").tobytes(), **repair(np.concatenate(ids), sizes, first_rule)}
            keys.clear()
            ids.clear()
            kinds = {"part": pa.int32(), "shard": pa.int32(), "first_id": pa.int64(), "last_id": pa.int64(), "first_rule": pa.int64(), "tokens": pa.int64()}
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c, pa.binary())) for c in names], names)

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2500):
                some = batch.slice(at, 2500)
                own = pc.fill_null(some.column(0), NULL_ID).to_pylist()
                for k, x in zip(own, encoder.encode(pc.fill_null(some.column(1), "")), strict=True):
                    keys.append(k)
                    ids.append(np.append(x, np.uint32(end)))
                    held += len(x) + 1
                    if held >= SHARD_TOKENS:
                        yield close()
                        n, held = n + 1, 0
        if keys:
            yield close()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))  # ranges may end inside an id that many rows have
    rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").drop("h").mapInArrow(encoded, SCHEMA).write.parquet(path)


def _shards(spark, path: str, of, schema: str) -> DataFrame:
    """Applies `of` (shard, ids before it, ids of its documents) -> arrays to every shard under path, one at a time."""
    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = files.select("part", "shard", "tokens")
    # ids before a task's shards: one row a task; then before a shard among its task's
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("n"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("n").over(upto(Window.orderBy("part"))), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("tokens").over(upto(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    base = sizes.withColumn("own", own).join(before, "part").select("part", "shard", (F.col("before") + F.col("own")).alias("base"))
    base = staged(base, "tokens")  # three numbers a shard: small files, which Spark broadcasts, so that the shards stay where they are

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(row := batch.slice(i, 1).to_pylist()[0])
                starts = row["base"] + np.cumsum(shard.n_tokens) - shard.n_tokens
                keys = pa.array(shard.doc_id, mask=shard.doc_id == NULL_ID)
                columns = of(shard.documents())
                yield pa.RecordBatch.from_arrays([keys, pa.array(starts), *columns], [c.split()[0] for c in schema.split(", ")])

    return files.join(base, ["part", "shard"]).mapInArrow(each, schema)


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, ids binary of little-endian uint32) of each document; start counts the ids of all documents before it."""
    return _shards(spark, path, lambda docs: [pa.array([x.astype("<u4", copy=False).tobytes() for x in docs], pa.binary())], "doc_id long, start long, ids binary")


def read_document(spark, path: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of the documents of one id: files and row groups without it are skipped, and of a shard only its own symbols are expanded."""
    key = NULL_ID if doc_id is None else doc_id
    files = spark.read.schema(SCHEMA).parquet(path).where((F.col("first_id") <= key) & (F.col("last_id") >= key))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                found = [shard.document(i).astype("<u4").tobytes() for i in np.flatnonzero(shard.doc_id == key)]
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(found, pa.binary())], ["part", "shard", "i", "ids"])

    rows = files.mapInArrow(each, "part int, shard int, i int, ids binary").orderBy("part", "shard", "i").collect()
    return [np.frombuffer(r.ids, "<u4") for r in rows]


def token_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, the checksum over its ids as read_token_files gives them."""

    def digests(docs: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array([len(x) for x in docs], pa.int64()), pa.array([zlib.crc32(x.astype("<u4", copy=False).tobytes()) for x in docs], pa.int64())]

    return _shards(spark, path, digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, str(public_tokenizers.path("byte_bpe_50k.json")))
    return token_digests(spark, path)
