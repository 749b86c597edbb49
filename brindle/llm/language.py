"""Operator 5: language identification of whole, possibly mixed texts.

Each word's script (Unicode ranges) narrows the languages to those that were seen in that script; each language scores the word
by its character n-grams; a Viterbi pass over the words with a penalty for each switch labels spans.  The text's language is the
one with most letters.

A text longer than GROUP characters is worked on in parts that end at white space: each part yields the max-plus matrix of its best
scores from one language at its start to one at its end, the matrices give the language at every part's ends, and each part is then
traced between its two.  So memory does not grow with a text, but for one byte a word.  Within a part, blocks of words advance together.

Model: log-probabilities of hashed character n-grams (1 to 4, with word boundaries) for each language, learned from a bounded
number of documents of each language and counted in Spark.

Defined results: `und` with score 0 for null texts, texts without a letter, and when nothing was learned; words without a letter
belong to the span around them; ties go to the language first by code point; a run of more than LONGEST_WORD characters is words of that many;
repeated rows are labelled each; other columns pass through whatever their names, but for the three that are added.
"""

from __future__ import annotations

import functools
import math
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_sample, remainder, small_batches, staged

# fixed values: first code point of each range and its script, from the Unicode block list
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"), (0x0E00, "Thai"),
    (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x40000, "Other"),
)
SCRIPTS = tuple(dict.fromkeys(s for _, s in SCRIPT_RANGES))
#: Bits of the n-gram hash; longest n-gram.
BITS, LONGEST = 16, 4
#: Log-probability lost at each change of language, and that of a word in a script its language was never seen in.
SWITCH, FOREIGN = 12.0, -40.0
#: Characters that are worked on at a time: arrays of some hundred bytes a character.
GROUP = 500_000
#: Characters after which a longer word is cut.
LONGEST_WORD = 10_000
#: Scores of characters, one for each language, that are held at a time.
SLICE = 4_000_000
#: Share of a language's letters from which a script counts as its own.
SCRIPT_SHARE = 0.005


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


@functools.cache
def _scripts() -> np.ndarray:
    starts = np.array([a for a, _ in SCRIPT_RANGES])
    of = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES], np.uint8)
    return of[np.searchsorted(starts, np.arange(sys.maxunicode + 1), "right") - 1]


@dataclass(frozen=True)
class Words:
    """The words of some texts as flat arrays: codes padded by one space on either side of each word."""

    codes: np.ndarray  # code points, lower case
    start: np.ndarray  # of each word, the place of the space before it
    text: np.ndarray  # of each word, the text's number
    letters: np.ndarray  # of each word
    script: np.ndarray  # of each word's first letter; -1 if none


def words_of(texts: list[str]) -> Words:
    """Words are what str.split() gives of the lower-cased NFC texts, cut after LONGEST_WORD characters."""
    split = [unicodedata.normalize("NFC", t).lower().split() for t in texts]
    for i, s in enumerate(split):
        if any(len(w) > LONGEST_WORD for w in s):
            split[i] = [w[a : a + LONGEST_WORD] for w in s for a in range(0, len(w), LONGEST_WORD)]
    flat = [w for s in split for w in s]
    if not flat:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, none)
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    codes = np.frombuffer((" " + " ".join(flat) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    letter = _letters()[codes]
    count = np.add.reduceat(letter.astype(np.int64), start)
    upto = np.concatenate([[0], np.cumsum(letter)])
    where = np.flatnonzero(letter)
    first = where[np.minimum(upto[start], len(where) - 1)] if len(where) else np.zeros(len(start), np.int64)
    script = np.where(count > 0, _scripts()[codes[first]].astype(np.int64), -1)
    return Words(codes, start, np.repeat(np.arange(len(texts)), [len(s) for s in split]), count, script)


_SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def parts_of(text: str, most: int = GROUP) -> Iterator[str]:
    """The text in parts of at most `most` characters that begin at white space, or after `most` characters where there is none."""
    a = 0
    while len(text) - a > most:
        cut = max(text.rfind(c, a + 1, a + most) for c in _SPACES)
        cut = cut if cut > a else a + most - most % LONGEST_WORD if most > LONGEST_WORD else a + most
        yield text[a:cut]
        a = cut
    yield text[a:]


def grams(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hash at each place, whether the n-gram there lies within one word and its two boundaries)."""
    space = codes == 32
    h, ok = np.zeros(len(codes), np.uint64), np.ones(len(codes), bool)
    for n in range(1, LONGEST + 1):
        ahead = codes[n - 1 :]
        m = len(ahead)
        h = (h[:m] ^ ahead.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n > 2:  # no space strictly inside
            ok = ok[:m] & ~space[n - 2 : n - 2 + m]
        else:
            ok = ok[:m]
        yield n, ((h ^ np.uint64(n)) >> np.uint64(7)) & np.uint64((1 << BITS) - 1), ok & ~(space[:m] if n == 1 else (space[:m] & space[n - 1 : n - 1 + m]))


@dataclass(frozen=True)
class LanguageModel:
    """langs in code-point order; table (LONGEST, 2**BITS, langs) of float32 log-probabilities; allowed (scripts, langs)."""

    langs: tuple[str, ...]
    table: np.ndarray
    allowed: np.ndarray

    def word_scores(self, words: Words) -> np.ndarray:
        """(words, langs): mean-free log-likelihoods, FOREIGN where the script rules a language out, 0 for words without letters."""
        s = np.zeros((len(words.start), len(self.langs)))
        step = max(1, SLICE // len(self.langs))
        cuts = [0, *(np.flatnonzero(np.diff(words.start // step)) + 1).tolist(), len(words.start)]
        for a, b in zip(cuts, cuts[1:], strict=False):  # some words at a time: the table below has a row for each character
            begin, end = int(words.start[a]), int(words.start[b]) if b < len(words.start) else len(words.codes) - 1
            codes = words.codes[begin : end + 1]
            total = np.zeros((len(codes), len(self.langs)), np.float32)
            for n, h, ok in grams(codes):
                at = np.flatnonzero(ok)
                total[at] += self.table[n - 1][h[at].astype(np.int64)]
            s[a:b] = np.add.reduceat(total, words.start[a:b] - begin, axis=0)
        s[words.letters == 0] = 0
        known = words.script >= 0
        may = self.allowed[words.script[known]]
        may |= ~may.any(axis=1, keepdims=True)
        s[known] = np.where(may, s[known], s[known] + FOREIGN)
        return s


def _blocks(n: int) -> np.ndarray:
    """Where blocks of about the square root of n words begin."""
    return np.arange(0, n, max(1, math.isqrt(n)))


def transfer(scores: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """(k, k) max-plus matrix of some words: the best score of a path over them that is entered from language i and ends in language j,
    where a change at the entry costs, too.  All blocks of words advance together from every language, then their matrices are multiplied."""
    n, k = scores.shape
    begin = _blocks(n)
    size = np.diff(np.append(begin, n))
    best = np.where(np.eye(k, dtype=bool), 0.0, -penalty)[None].repeat(len(begin), axis=0) + scores[begin][:, None, :]
    for t in range(1, int(size.max(initial=0))):
        m = size > t  # all but the last block, or all
        own = best[m]
        best[m] = np.maximum(own, own.max(axis=2, keepdims=True) - penalty) + scores[begin[m] + t][:, None, :]
    return functools.reduce(times, best)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, which is associative."""
    return (a[:, :, None] + b[None]).max(axis=1)


def between(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, exit) language of each part on a best path through all of them; the first part is entered for nothing."""
    ahead = [np.zeros(len(matrices[0]))]  # of each language: the best score of what follows
    for m in reversed(matrices[1:]):
        ahead.append((m + ahead[-1]).max(axis=1))
        ahead[-1] -= ahead[-1].max()
    ahead.reverse()
    out = []
    state = -1
    for m, rest in zip(matrices, ahead, strict=True):
        value = (m.max(axis=0) if state < 0 else m[state]) + rest
        before, state = state, int(value.argmax())
        out.append((before, state))
    return out


def viterbi(scores: np.ndarray, text: np.ndarray, n_texts: int, penalty: float = SWITCH, ends: tuple[int, int] | None = None) -> np.ndarray:
    """The best language of each word, where each change between neighbours in a text costs `penalty`.

    All texts advance together, longest first, so a step costs one vector operation for the texts still running; a text much longer
    than the others is cut into blocks, which advance together once their ends are known.  ends: (entry, exit) languages of a single text
    that is entered from the first (-1: for nothing) and ends in the second.
    """
    n, k = scores.shape
    out = np.zeros(n, np.int64)
    if n == 0 or k == 1:
        return out
    size = np.bincount(text, minlength=n_texts)
    if size.max() > 4096:
        begin = np.cumsum(size) - size
        for t in np.flatnonzero(size > 4096).tolist():
            own = scores[begin[t] : begin[t] + size[t]]
            cut = np.append(_blocks(len(own)), len(own))
            parts = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            first, matrices = (ends or (-1, -1)), [transfer(own[a:b], penalty) for a, b in parts]
            if first[0] >= 0:
                matrices[0] = matrices[0][first[0]][None].repeat(k, axis=0)
            else:
                matrices[0] = (matrices[0].max(axis=0))[None].repeat(k, axis=0)
            if first[1] >= 0:
                matrices[-1] = np.where(np.arange(k) == first[1], matrices[-1], -np.inf)
            known = between(matrices)
            known[0] = (first[0], known[0][1])
            out[begin[t] : begin[t] + size[t]] = _trace(own, np.repeat(np.arange(len(parts)), np.diff(cut)), len(parts), penalty, known)
        rest = (size <= 4096)[text]
        if rest.any():
            keep = np.flatnonzero(size <= 4096)
            number = np.cumsum(size <= 4096) - 1
            out[rest] = _trace(scores[rest], number[text[rest]], len(keep), penalty, None)
        return out
    return _trace(scores, text, n_texts, penalty, [ends] if ends else None)


def _trace(scores: np.ndarray, text: np.ndarray, n_texts: int, penalty: float, ends: list[tuple[int, int]] | None) -> np.ndarray:
    """Viterbi of texts that advance together; ends: entry and exit language of each."""
    n, k = scores.shape
    out = np.zeros(n, np.int64)
    size = np.bincount(text, minlength=n_texts)
    begin = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    size, begin = size[order], begin[order]
    entry, leave = (np.array(ends)[order].T if ends else np.full((2, len(order)), -1))
    active = np.searchsorted(-size, -np.arange(size[0] + 1), "left")  # texts longer than t
    came = np.zeros(n, np.int8 if k < 127 else np.int32)  # the language before a switch
    switched = np.zeros((n, k), bool)
    best = scores[begin].copy()
    best -= np.where((entry[:, None] >= 0) & (entry[:, None] != np.arange(k)), penalty, 0.0)

    def end(value: np.ndarray, i: slice) -> np.ndarray:
        return np.where(leave[i] >= 0, leave[i], value.argmax(axis=1))

    short = active[1]
    out[begin[short:]] = end(best[short:], slice(short, None))
    for t in range(1, size[0]):
        m = active[t]
        best = best[:m]
        top = best.argmax(axis=1)
        high = best[np.arange(m), top] - penalty
        at = begin[:m] + t
        move = high[:, None] > best
        came[at], switched[at] = top, move
        best = np.where(move, high[:, None], best) + scores[at]
        best -= best.max(axis=1, keepdims=True)
        ending = active[t + 1]  # the texts that go on
        if ending < m:
            out[at[ending:]] = end(best[ending:], slice(ending, m))
    for t in range(size[0] - 1, 0, -1):
        at = begin[: active[t]] + t
        now = out[at]
        before = np.where(switched[at, now], came[at], now)
        out[at - 1] = before
    return out


def groups(texts: list[str], most: int = GROUP) -> Iterator[list[int]]:
    """Places of texts in groups of about `most` characters or one text; texts of like length go together, as they advance together."""
    held, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if held and size + len(texts[i]) > most:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(texts[i])
    if held:
        yield held


Span = tuple[str, int, int, int]


def _runs(lang: np.ndarray, words: Words) -> list[tuple[int, int, int, int, int]]:
    """(text, language, first word of the text's, words, letters) of each run of equal languages."""
    cut = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (words.text[1:] != words.text[:-1])]))
    letters = np.add.reduceat(words.letters, cut)
    begin = np.searchsorted(words.text, words.text[cut])
    return list(zip(words.text[cut].tolist(), lang[cut].tolist(), (cut - begin).tolist(), np.diff(np.append(cut, len(lang))).tolist(), letters.tolist(), strict=True))


def spans(model: LanguageModel, texts: list[str]) -> list[list[Span]]:
    """For each text its spans (language, first word, words, letters); none for a text without a letter."""
    if not model.langs:
        return [[] for _ in texts]
    words = words_of(texts)
    if len(words.start) == 0:
        return [[] for _ in texts]
    lang = viterbi(model.word_scores(words), words.text, len(texts))
    found: list[list[Span]] = [[] for _ in texts]
    for t, of, first, n, letters in _runs(lang, words):
        found[t].append((model.langs[of], first, n, letters))
    return [s if any(x[3] for x in s) else [] for s in found]


def long_spans(model: LanguageModel, text: str, most: int = GROUP) -> list[Span]:
    """spans() of one text, part by part: scores are made twice and never held for more than a part."""
    if not model.langs:
        return []
    matrices = []
    for part in parts_of(text, most):
        words = words_of([part])
        matrices.append(transfer(model.word_scores(words)) if len(words.start) else None)
    known = iter(between([m for m in matrices if m is not None])) if any(m is not None for m in matrices) else iter(())
    found: list[list] = []
    at = 0
    for part, matrix in zip(parts_of(text, most), matrices, strict=True):
        if matrix is None:
            continue
        words = words_of([part])
        for _, of, first, n, letters in _runs(viterbi(model.word_scores(words), words.text, 1, ends=next(known)), words):
            if found and found[-1][0] == of:
                found[-1][2] += n
                found[-1][3] += letters
            else:
                found.append([of, at + first, n, letters])
        at += len(words.start)
    return [(model.langs[of], first, n, letters) for of, first, n, letters in found] if any(x[3] for x in found) else []


def fit(docs: DataFrame, docs_per_lang: int = 1000, key: str = "doc_id") -> LanguageModel:
    """Learns from at most `docs_per_lang` whole documents of each non-null lang of docs (key, text, lang).

    n-grams are counted in tasks and summed in Spark, which packs each language's counts into one row (under 2 MB); the driver reads one row at a
    time into the model, whose table takes 1 MB a language.
    """
    sample = bounded_sample(docs.where("text is not null and lang is not null").select(key, "text", "lang"), "lang", docs_per_lang, key)

    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for lang, own in part.groupby("lang"):
                texts = [x for t in own["text"] for x in parts_of(t)]
                for some in groups(texts):
                    words = words_of([texts[i] for i in some])
                    rows = [pd.DataFrame({"lang": [], "kind": [], "h": [], "c": []})]
                    if len(words.codes):
                        letters = _letters()[words.codes]
                        found = [(0, _scripts()[words.codes[letters]]), *((n, h[ok]) for n, h, ok in grams(words.codes))]
                        for kind, keys in found:
                            h, c = np.unique(keys, return_counts=True)
                            rows.append(pd.DataFrame({"lang": lang, "kind": kind, "h": h.astype(np.int64), "c": c}))
                    yield pd.concat(rows[1:] or rows)

    sums = sample.mapInPandas(counted, "lang string, kind int, h long, c long").groupBy("lang", "kind", "h").agg(F.sum("c").alias("c"))
    place = F.col("kind") * F.lit(1 << BITS) + F.col("h")
    packed = staged(sums.groupBy("lang").agg(F.collect_list(F.shiftleft(place, 40).bitwiseOR(F.col("c"))).alias("counts")), "language")
    langs = tuple(sorted(r["lang"] for r in packed.select("lang").collect()))
    table = np.zeros((LONGEST, 1 << BITS, len(langs)), np.float32)
    allowed = np.zeros((len(SCRIPTS), len(langs)), bool)
    for row in packed.toLocalIterator():
        at = langs.index(row["lang"])
        counts = np.array(row["counts"], np.int64)
        kind, h, c = counts >> (40 + BITS), (counts >> 40) & ((1 << BITS) - 1), counts & ((1 << 40) - 1)
        letters = c * (kind == 0)
        allowed[h[(kind == 0) & (letters >= SCRIPT_SHARE * letters.sum())], at] = True
        for n in range(1, LONGEST + 1):
            own = kind == n
            value = np.full(1 << BITS, 0.5)
            value[h[own]] += c[own]
            table[n - 1, :, at] = np.log(value / value.sum())
    table -= table.mean(axis=2, keepdims=True) if langs else 0
    return LanguageModel(langs, table * np.float32(1 / LONGEST), allowed)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score (share of letters in that language) and lang_spans; columns of these names are replaced.

    The model (LONGEST * 2**BITS floats a language, 1 MB each) goes to the workers as a broadcast variable.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<lang:string,score:double,spans:array<struct<lang:string,first_word:long,words:long,letters:long>>>"

    def label(s: list[tuple[str, int, int, int]]) -> tuple[str, float, list[dict]]:
        total: dict[str, int] = {}
        for lang, _, _, letters in s:
            total[lang] = total.get(lang, 0) + letters
        if not total:
            return "und", 0.0, []
        best = min(total, key=lambda x: (-total[x], x))
        return best, total[best] / sum(total.values()), [dict(zip(("lang", "first_word", "words", "letters"), x, strict=True)) for x in s]

    @pandas_udf(kind)
    def labels(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            out: list = [None] * len(texts)
            giant = [i for i, t in enumerate(texts) if len(t) > GROUP]
            for i in giant:
                out[i] = label(long_spans(sent.value, texts[i]))
                texts[i] = ""
            for some in groups(texts):
                some = [i for i in some if out[i] is None]
                for i, s in zip(some, spans(sent.value, [texts[i] for i in some]), strict=True):
                    out[i] = label(s)
            yield pd.DataFrame(out, columns=["lang", "score", "spans"])

    own = docs.drop("lang_pred", "lang_score", "lang_spans")
    found = own.select(F.struct(*own.columns).alias("row"), labels.asNondeterministic()(docs[text]).alias("found"))
    return found.select("row.*", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("lang_score"), F.col("found.spans").alias("lang_spans"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(remainder("doc_id", 3) != 1))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
