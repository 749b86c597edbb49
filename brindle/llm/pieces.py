"""Operator 7: SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

The model is a BPE with byte fallback.  A sequence of pieces is the BPE of its text exactly if every two neighbours are the BPE of their
own concatenation, so encoding is a best path: weight 0 for neighbours that go together and minus infinity for others, and
there is one path of weight 0.

Ordinary texts go through the sentencepiece library, one distinct space-led unit at a time.  Giant texts are cut into chunks anywhere.
A boundary state is the piece that reaches or crosses the boundary, and how far it reaches beyond.  Each chunk yields, in a task of its own,
the max-plus transfer matrix from its entry states to its exit states.  Products of FAN neighbouring matrices are taken in tasks, then products
of those, up to one matrix a document (the product is associative); downwards, each product's two states fix those of its factors, until every
boundary's state is known.  Each chunk is then traced back on its own between its two states, and the parts are joined in order.  A task holds FAN
matrices of some ten states each, whatever a document's length.

Where a run of spaces begins, no piece crosses: inside a chunk such resets separate the few characters that depend on the entry or exit
state from the rest, which the library encodes.  A chunk without a reset (one giant word) takes the full matrix.

Decoding joins the pieces' bytes, so it inverts encoding for every text without U+2581 (which the model cannot tell from a space) and
without unpaired surrogates.

Defined results: a null text is empty; an empty text has no pieces; repeated rows are encoded each; other columns pass through whatever their
names, and a column named `pieces` is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, staged
from .tokens import Encoder

SPACE = "▁"
#: Characters from which a text is giant, and characters of a chunk.
GIANT, CHUNK = 65_536, 16_384
#: Matrices that one product takes.
FAN = 16

#: Characters that the piece reaches beyond the boundary, and the piece ("" at the ends of the text and at a reset).
State = tuple[int, str]


class Model:
    """A sentencepiece BPE model and what the scan needs of it."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        if m.normalize("a  b ") != "▁a▁▁b▁":
            raise ValueError("a model that keeps all white space and adds a dummy prefix is needed")
        size = m.get_piece_size()
        self.rank: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        for i in range(size):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif m.is_control(i):
                self.bytes_of.append(b"")
            elif m.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.rank[piece] = m.get_score(i)
                self.bytes_of.append(piece.encode())
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece holds a space after another character")
        self.longest = max(map(len, self.rank))
        self.together = functools.lru_cache(1 << 16)(self._together)

    def merge(self, text: str) -> list[str]:
        """BPE of a short string: the best-scored neighbours merge first, the leftmost of equals."""
        s = list(text)
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                score = self.rank.get(s[i] + s[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def _together(self, p: str, q: str) -> bool:
        """Weight 0 (True) or minus infinity (False) of piece q after p; p may be empty."""
        if q[:1] == SPACE and p[-1:] != SPACE:  # after a reset
            p = ""
        return self.merge(p + q) == ([p, q] if p else [q])

    def ids(self, piece: str) -> list[int]:
        """The id of a piece, or those of the bytes of a character without one."""
        if piece in self.rank:
            return [self.library.piece_to_id(piece)]
        return [self.library.piece_to_id(f"<0x{b:02X}>") for b in piece.encode("utf-8", "replace")]

    def starting(self, text: str, at: int) -> Iterator[str]:
        """The pieces that text has at a place: those of the model, and its next character in any case."""
        yield text[at]
        for n in range(2, min(self.longest, len(text) - at) + 1):
            if text[at : at + n] in self.rank:
                yield text[at : at + n]

    def paths(self, text: str, entry: int, before: str, end: int) -> dict[tuple[int, str], tuple]:
        """Nodes (place, piece that ends there) on weight-0 paths from (entry, before), up to the first places at or past `end`,
        each with the node it came from."""
        came: dict[tuple[int, str], tuple] = {(entry, before): ()}
        todo: dict[int, list[str]] = {entry: [before]}
        for place in range(entry, end):
            for p in todo.pop(place, ()):
                for q in self.starting(text, place):
                    node = (place + len(q), q)
                    if node not in came and self.together(p, q):
                        came[node] = (place, p)
                        todo.setdefault(node[0], []).append(q)
        return came

    def plain(self, units: str) -> list[int]:
        """BPE, by the library, of normalised text that begins with a space mark and ends before one."""
        return self.library.encode(units.replace(SPACE, " ")[1:], num_threads=1) if units else []

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return raw[1:] if raw[:1] == " " else raw


@functools.lru_cache(2)
def model(path: str) -> Model:
    """One model a worker process."""
    return Model(path)


class UnitEncoder(Encoder):
    """tokens.Encoder over a sentencepiece model, whose first word is led by a space like any other."""

    def __init__(self, path: str, units: int = 500_000):  # kept from task to task, beside what other stages' workers hold
        self.model = model(path)
        self._clear(units)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.model.library.encode(texts, num_threads=1)] if texts else []

    def units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.library.encode(words.to_pylist(), num_threads=1)
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(count.sum())), count


@functools.lru_cache(1)
def encoder_of(path: str) -> UnitEncoder:
    """One encoder a worker process, kept from task to task."""
    return UnitEncoder(path)


class Chunk:
    """Some characters of a normalised text, seen with the margins that pieces may reach into."""

    def __init__(self, m: Model, text: str, start: int, end: int, first: bool, final: bool):
        """The chunk is text[start:end]; first and final: whether the whole text begins or ends there."""
        self.m, self.text, self.start, self.end, self.first, self.final = m, text, start, end, first, final
        a, b = self._reset(start, 1), self._reset(end, -1)
        self.resets = None if a is None else (a, b)
        self.opens = first or a == start
        self.closes = final or b == end

    def _reset(self, at: int, step: int) -> int | None:
        """The first place from `at` on, within the chunk, where a run of spaces begins."""
        t = self.text
        while self.start <= at <= self.end:
            if at < len(t) and t[at] == SPACE and (t[at - 1] != SPACE if at else self.first):
                return at
            at += step
        return None

    def entries(self) -> list[State]:
        """Every state that the chunk may be entered in, by what the text has there."""
        if self.opens:
            return [(0, "")]
        s = self.start
        pieces = [(a, p) for a in range(max(0, s - self.m.longest), s) for p in self.m.starting(self.text, a)]
        return [(a + len(p) - s, p) for a, p in pieces if a + len(p) >= s and self.m.together("", p)]

    def _exits(self, came: dict) -> list[State]:
        if self.closes:
            return [(0, "")] if any(place == self.end for place, _ in came) else []
        return [(place - self.end, p) for place, p in came if place >= self.end]

    def matrix(self) -> dict[State, set[State]]:
        """The transfer matrix: the exit states of weight 0 from each entry state; all others are minus infinity."""
        paths, t = self.m.paths, self.text
        if self.resets is None:
            rows = {i: self._exits(paths(t, self.start + i[0], i[1], self.end)) for i in self.entries()}
        else:
            a, b = self.resets
            after = self._exits(paths(t, b, "", self.end))
            rows = {i: after for i in self.entries() if any(place == a for place, _ in paths(t, self.start + i[0], i[1], a))}
        return {i: set(js) for i, js in rows.items() if js}

    def trace(self, entry: State, leave: State) -> list[int]:
        """The ids of the pieces from the entry state to the exit state."""
        m, t, end = self.m, self.text, self.end

        def back(place: int, piece: str, limit: int, last: tuple[int, str] | None) -> list[int]:
            came = m.paths(t, place, piece, limit)
            node = last or next(n for n in came if n[0] == limit)
            out: list[str] = []
            while came[node]:
                out.append(node[1])
                node = came[node]
            return [i for p in reversed(out) for i in m.ids(p)]

        last = (end + leave[0], leave[1]) if leave[1] else None
        if self.resets is None:
            return back(self.start + entry[0], entry[1], end, last)
        a, b = self.resets
        left = back(self.start + entry[0], entry[1], a, None)
        return left + m.plain(t[a:b]) + (back(b, "", end, last) if b < end else [])


Matrix = dict[State, set[State]]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two transfer matrices: associative, as products of matrices are."""
    rows = {i: set().union(*(b.get(j, ()) for j in js)) for i, js in a.items()}
    return {i: js for i, js in rows.items() if js}


def scan(matrices: list[Matrix], entry: State = (0, ""), leave: State = (0, "")) -> list[tuple[State, State]]:
    """(entry, exit) of each factor on the path of weight 0 from `entry` to `leave` through all of them.

    There is one such path, as a text has one encoding; a reset state is shared by all paths through it.
    """
    alive: list[set[State]] = [{leave}]
    for m in reversed(matrices):
        alive.append({i for i, js in m.items() if js & alive[-1]})
    alive.reverse()
    state = entry
    out = []
    for m, rest in zip(matrices, alive[1:], strict=True):
        before, state = state, min(m[state] & rest)
        out.append((before, state))
    return out


ENTRIES = "_row long, k long, i long, before string, j long, after string"


def _matrices(own: pd.DataFrame) -> list[Matrix]:
    """The matrices of some consecutive numbers k, in order."""
    found: dict[int, Matrix] = {}
    for k, *x in zip(*(own[c] for c in ("k", "i", "before", "j", "after")), strict=True):
        found.setdefault(k, {}).setdefault((x[0], x[1]), set()).add((x[2], x[3]))
    return [found[k] for k in sorted(found)]


def _entries(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["_row", "k", "i", "before", "j", "after"])


def boundary_states(matrices: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """(ENTRIES) with the one entry of each matrix that the path takes; matrices: all entries of each; most: the largest k + 1."""
    of = F.floor(F.col("k") / fan)

    def product(own: pd.DataFrame) -> pd.DataFrame:
        row, up = own["_row"].iloc[0], int(own["k"].iloc[0]) // fan
        return _entries([(row, up, *i, *j) for i, js in functools.reduce(times, _matrices(own)).items() for j in sorted(js)])

    def solved(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return _entries([])
        x = above.iloc[0] if len(above) else None
        ends = ((0, ""), (0, "")) if x is None else ((x["i"], x["before"]), (x["j"], x["after"]))
        row, first = own["_row"].iloc[0], int(own["k"].min())
        return _entries([(row, first + n, *i, *j) for n, (i, j) in enumerate(scan(_matrices(own), *ends))])

    levels = [matrices]
    while most > fan:
        levels.append(staged(levels[-1].groupBy("_row", of.alias("up")).applyInPandas(product, ENTRIES), "pieces"))
        most = -(-most // fan)
    states = levels[-1].where(F.lit(False))  # above the top: from nothing to nothing
    for level in reversed(levels):
        states = level.groupBy("_row", of.alias("up")).cogroup(states.groupBy("_row", F.col("k").alias("up"))).applyInPandas(solved, ENTRIES)
    return states


def _giant_pieces(giants: DataFrame, path: str, chunk: int) -> DataFrame:
    """(_row, pieces) of staged giant texts (_row, _text)."""
    longest = 64

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row, t in zip(part["_row"], part["_text"], strict=True):
                whole = SPACE + t.replace(" ", SPACE)
                begins = range(0, len(whole), chunk)
                yield pd.DataFrame(
                    {
                        "_row": row, "k": range(len(begins)), "text": [whole[max(0, i - longest) : i + chunk + longest] for i in begins],
                        "start": [min(i, longest) for i in begins], "size": [min(chunk, len(whole) - i) for i in begins], "final": [i + chunk >= len(whole) for i in begins],
                    }
                )

    chunks = giants.mapInPandas(cut, "_row long, k long, text string, start long, size long, final boolean")
    chunks = staged(chunks.repartition("_row", "k"), "pieces")

    def chunk_of(r, m: Model) -> Chunk:
        if m.longest > longest:
            raise ValueError("a piece is longer than the margin")
        return Chunk(m, r.text, r.start, r.start + r.size, r.k == 0, r.final)

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for part in batches:
            yield _entries([(r.of, r.k, *i, *j) for r in part.rename(columns={"_row": "of"}).itertuples(name="R") for i, js in chunk_of(r, m).matrix().items() for j in sorted(js)])

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for part in batches:
            part = part.rename(columns={"_row": "of"})
            ids = [chunk_of(r, m).trace((r.i, r.before), (r.j, r.after)) for r in part.itertuples(name="R")]
            yield pd.DataFrame({"_row": part["of"], "k": part["k"], "ids": ids})

    most = chunks.agg(F.max("k")).first()[0]
    states = boundary_states(staged(chunks.mapInPandas(transfer, ENTRIES), "pieces"), 0 if most is None else most + 1)
    parts = chunks.join(states, ["_row", "k"]).mapInPandas(traced, "_row long, k long, ids array<int>")
    joined = F.sort_array(F.collect_list(F.struct("k", "ids")))  # a text's own ids, as its row holds them
    return parts.groupBy("_row").agg(F.flatten(F.transform(joined, lambda x: x["ids"])).alias("pieces"))


def encode(docs: DataFrame, path: str, text: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """docs with `pieces` (array<int>), the ids of the sentencepiece model at `path`."""

    small_batches(docs.sparkSession)
    own = docs.drop("pieces")
    rows = own.select(F.struct(*own.columns).alias("row"))
    place = [c.lower() for c in own.columns].index(text.lower())
    string = F.col("row")[own.columns[place]]
    long = F.coalesce(F.length(string) >= giant, F.lit(False))
    giants = staged(rows.where(long).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    found = giants.join(_giant_pieces(giants.select("_row", string.alias("_text")), path, chunk), "_row").select("row", "pieces")

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for part in _slices(batches):
            ids = encoder.encode(pc.fill_null(pc.struct_field(part.column(0), [place]), ""))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            pieces = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), pieces], ["row", "pieces"])

    of = T.StructType([rows.schema["row"], T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    return rows.where(~long).mapInArrow(ordinary, of).unionByName(found).select("row.*", "pieces")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Small parts of Arrow batches, so that what a part expands to stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def decode(docs: DataFrame, path: str, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """docs with the text of their pieces in the column `out`."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for part in _slices(batches):
            lists = part.column(part.schema.get_field_index(pieces))
            texts = pa.array([None if x is None else m.decode(x) for x in (v.as_py() for v in lists)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, out])

    docs = docs.drop(out)
    return docs.mapInArrow(decoded, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def op7(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; the digests of the result are taken where the ids are, so neither they nor texts travel back."""
    import public_tokenizers

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for part in _slices(batches):
            ids = [np.asarray(x.values) for x in part.column(2)]
            texts = [m.decode(x.tolist()) for x in ids]
            same = [(t or "") == d for t, d in zip(part.column(1).to_pylist(), texts, strict=True)]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            counts = (pa.array([len(x) for x in v], pa.int64()) for v in (ids, texts))
            n, chars = counts
            yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(crc, pa.int64()), chars, pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "decoded_chars", "same_text"])

    return encoded.select("doc_id", "text", "pieces").mapInArrow(digests, "doc_id long, n_pieces long, ids_crc32 long, decoded_chars long, same_text boolean")
