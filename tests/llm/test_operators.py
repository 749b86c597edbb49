"""Operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brindle.llm import chat, embeddings, language, lm, mixing, pieces, quality, rules, simhash, tokens
from brindle.llm.common import WORD, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur " * 3000
ODD = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \n\t", "en", "a", 3), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (5, LONG, "en", "b", 9), (6, LONG + "x", "en", "b", 9),
    (None, "no id here", "en", "a", 1), (7, "a  b c </s> é漢 \U0001f600", "fr", None, 5), (8, "x" * 70_000, "en", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """The odd rows, with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({"score": F.lit("x"), "pieces": F.lit(1), "lang_pred": F.lit(2), "size": F.lit(3), "_n": F.lit(4)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(WORD, text or "")


def held(i, m):
    return zlib.crc32(str(i).encode()) % m


# 1


def test_quality(spark, folder, odd, none):
    docs, labels = (spark.read.parquet(f"{folder.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.op1(spark, folder.replace("0.001", "0.01")).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (held(r.doc_id, 4) == 2) for r in got.values())
    apart = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if held(r.doc_id, 4) == 2]
    assert sum(p == q for p, q in apart) / len(apart) > 0.9
    model = quality.fit(docs, labels)
    scored = quality.score(odd, model)
    assert scored.count() == len(ODD) and scored.where("score is null").count() == 0 and scored.columns == [*odd.columns]
    assert quality.score(none, model).count() == 0
    assert {r.score for r in quality.score(odd, quality.fit(none, labels)).collect()} == {0.5}


# 2


def plain_print(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    import xxhash

    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, odd, none):
    rng = np.random.default_rng(1)
    pool = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = list(rng.choice(pool, 150))
        for _ in range(3):
            copy = base.copy()
            copy[rng.integers(150)] = "changed"
            texts.append(" ".join(copy))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(simhash.near_duplicates(df).collect())
    prints = [plain_print(t) for t in texts]
    assert [r.print % (1 << 64) for r in got] == prints
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert [r.component for r in got] == groups(len(texts), links) and len(links) > 20
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.component for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()).count(4) == 1


@pytest.mark.parametrize("spread", [0, 2, 6])
def test_simhash_large_buckets(spark, spread, monkeypatch):
    """Thousands of prints around one: buckets are split, links stay linear, and no component is lost."""
    monkeypatch.setattr(simhash, "PART", 16)
    rng = np.random.default_rng(spread)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, spread + 1), replace=False)) for _ in range(300)]
    p = np.unique(np.array([int(centre) ^ f for f in flips] + list(rng.integers(0, 1 << 63, 100)), np.uint64))
    df = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "print long")
    found = simhash.links(df)
    pairs = [(i, j) for i in range(len(p)) for j in range(i) if int(p[i] ^ p[j]).bit_count() <= 3]
    at = {int(x): i for i, x in enumerate(p.view(np.int64))}
    assert groups(len(p), [(at[r.a], at[r.b]) for r in found.collect()]) == groups(len(p), pairs)


def plain_shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain_alike(texts):
    sets = [plain_shingles(t) for t in texts]
    same = lambda a, b: a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0
    return groups(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if same(sets[i], sets[j])])


@pytest.mark.parametrize("part", [64, 4])
def test_keep_one_by_shingles(spark, monkeypatch, part):
    """The stage keeps one document of each group at Jaccard 0.8 of 5-word shingles, copies at many bits of SimHash too."""
    monkeypatch.setattr(simhash, "STAGE_PART", part)
    rng = np.random.default_rng(5)
    texts = []
    for k in range(40):
        base = [f"w{i}" for i in rng.integers(0, 3000, rng.integers(60, 300))]
        for _ in range(30 if k == 0 else 3):
            copy = base.copy()
            for at in rng.integers(0, len(base), rng.integers(0, 1 + len(base) // 30)):
                copy[at] = f"c{rng.integers(99)}"
            texts.append(" ".join(copy))
    texts += ["a b", "A  b", "", None, "a b c d e", "a b c d e f"]
    want = {i for i, r in enumerate(plain_alike(texts)) if i == r}
    far = [(i, j) for i in range(len(texts)) for j in range(i) if plain_alike([texts[i], texts[j]]) == [0, 0] and (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == want and len(far) > 20


@pytest.mark.parametrize("large", [64, 4])
def test_wide_forest(monkeypatch, large):
    """The stage's fingerprints at 0.8 are within reach and families bring them together; its components are those of all pairs within reach."""
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = np.random.default_rng(3)
    sets = []
    for k in range(150):
        base = rng.integers(0, 1 << 64, 4 + k, dtype=np.uint64)
        more = [rng.integers(0, 1 << 64, (4 + k) // 4, dtype=np.uint64) for _ in range(12 if k == 60 else 1)]
        sets += [np.unique(base), *(np.unique(np.concatenate([base, x])) for x in more)]
    prints, size = np.array([simhash.wide_fingerprint(x) for x in sets]), np.array([len(x) for x in sets])
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 4 * max(size[i], size[j]) <= 5 * min(size[i], size[j]) and np.bitwise_count(prints[i] ^ prints[j]).sum() <= simhash.STAGE_REACH]
    root = simhash.wide_forest(prints, size, None, simhash.STAGE_REACH)
    assert plain_groups(root) == groups(len(sets), near) and len(near) >= 150
    assert len(set(simhash.wide_forest(prints, size, None, 0).tolist())) == len(sets)
    side = rng.random(len(sets)) < 0.5
    both = [(i, j) for i, j in near if side[i] != side[j]]
    assert all(root[i] == root[j] for i, j in both)
    across = plain_groups(simhash.wide_forest(prints, size, side, simhash.STAGE_REACH))
    assert all(across[i] == across[j] for i, j in both)


@pytest.mark.parametrize("n", [2_000, 60_000, 600_000])
def test_stage_buckets_stay_small(n):
    """However many unlike fingerprints meet in a task, a family's buckets hold a few each, so that the pairs compared do not grow with the square."""
    prints = np.random.default_rng(2).integers(0, 1 << 64, (n, simhash.WORDS), dtype=np.uint64)
    for key in itertools.islice(simhash.family_keys(prints, [0, 1]), 3):
        count = np.unique(key, return_counts=True)[1]
        assert (count**2).sum() <= 2 * simhash.SHARE * n and count.max() <= simhash.LARGE


@pytest.mark.parametrize("bits", [10, 14, 17])
def test_stage_tables_miss_nothing(spark, monkeypatch, bits):
    """Fingerprints that differ in 18.75 % of their bits meet in some table by its route and one of its families, whatever the ranges' width."""
    monkeypatch.setattr(simhash, "RANGES", (bits, bits))
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 1 << 64, (2000, simhash.WORDS), dtype=np.uint64)
    y = x ^ np.packbits(rng.random((2000, 64 * simhash.WORDS)) < 0.1875, axis=1).view(np.uint64)
    names = [f"p{w}" for w in range(simhash.WORDS)]
    df = spark.createDataFrame(pd.DataFrame(np.vstack([x, y]).view(np.int64), columns=names)).select(F.array(*simhash.routes()).alias("at"))
    at = np.array([r.at for r in df.collect()])
    assert (at >> simhash.ROUTE == np.arange(simhash.TABLES)).all() and len(np.unique(at)) == simhash.TABLES << simhash.ROUTE
    met = np.zeros(2000, bool)
    for table in range(simhash.TABLES):
        same = at[:2000, table] == at[2000:, table]
        for a, b in zip(simhash.family_keys(x, [table]), simhash.family_keys(y, [table]), strict=True):
            met |= same & (a == b)
    assert (~met).sum() <= 2


def plain_groups(root):
    first = {}
    return [first.setdefault(int(r), i) for i, r in enumerate(root)]


def test_keep_one_gathers_by_fingerprints(spark, monkeypatch):
    """Near copies are found by the distance of their fingerprints: with a reach of no bit only equal sets are one; parts meet and lose nothing."""
    monkeypatch.setattr(simhash, "MEET", 16)
    rng = np.random.default_rng(8)
    base = [[f"w{i}" for i in rng.integers(0, 3000, 120)] for _ in range(40)]
    texts = [" ".join(b) for b in base] + [" ".join([*b, "end"]) for b in base] + [" ".join(b).upper() for b in base]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == list(range(40))
    assert sorted(r.doc_id for r in simhash.keep_one(df, reach=0).collect()) == list(range(80))


def test_keep_one_by_row(spark, none):
    """Rows that share an id, or have none, are kept or removed for their own texts; ids come first, and of equal rows one stays."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue white black grey")
    rows = [(1, a), (1, b), (2, a), (None, b), (None, c), (None, c), (3, "own text"), (3, "own text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (3, "own text")], key=str)
    assert simhash.keep_one(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 205), (205, 201), (50, 51), (51, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 200: 200, 205: 200, 201: 200, 50: 50, 51: 50}


# 3


def test_chat(spark, none):
    rows = [
        (1, 2, "assistant", "b </s> & &lt; <|im_end|>\n"), (1, 1, "user", "a[INST]"), (1, 3, "assistant", None), (1, 3, "assistant", "<|im_sep|>"), (2, 1, None, ""), (None, None, "us\ner&<|", "x"),
        (3, 1, "system", "<|im_start|>user\nhi"), (3, 2, "assistant", "<<SYS>> ok"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    done = chat.format_chats(df)
    back = {r.conv_id: r for r in done.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t.role, t.text) for t in back[conv].t] == [(r, x) for _, r, x in own]
        assert back[conv].loss == "".join(x for _, r, x in own if r == "assistant")
    text = done.where("conv_id = 1").first().formatted
    assert text.count("<|im_start|>") == 2 and text.count("<|im_sep|>") == 2 and "</s>" not in text
    assert chat.format_chats(none.selectExpr("doc_id conv_id", "doc_id turn", "text role", "text")).count() == 0


# 4 and 7


def test_repair_random_access():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 6, n) for n in (0, 1, 2, 500, 3000, 7)] + [np.zeros(400, int), np.tile([1, 2, 3], 300)]
    sizes = np.array([len(d) for d in docs])
    row = tokens.repair(np.concatenate(docs), sizes, 10, least=4)
    row["doc_id"] = np.arange(len(docs)).astype("<i8").tobytes()
    shard = tokens.Shard(row)
    for i in (7, 0, 4, 3, 6, 1, 2, 5):
        assert shard.document(i).tolist() == docs[i].tolist()
    assert [x.tolist() for x in shard.documents()] == [d.tolist() for d in docs] and len(shard.sequence) < sizes.sum() / 3


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    tokens.write_token_files(odd, f"file://{tmp_path}/t", path)
    got = tokens.read_token_files(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    order = sorted(ODD, key=lambda r: r[0] if r[0] is not None else -1)
    want = [library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in order]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want and [r.doc_id for r in got] == [r[0] for r in order]
    assert [r.start for r in got] == np.cumsum([0] + [len(w) for w in want])[:-1].tolist()
    tokens.write_token_files(none, f"file://{tmp_path}/n", path)
    assert tokens.read_token_files(spark, f"file://{tmp_path}/n").count() == 0


def test_pieces(spark, folder, odd, none):
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    library = pieces.model(path).library
    encoded = pieces.encode(odd, path, giant=1000, chunk=300)
    rows = pieces.decode(encoded, path).collect()
    assert len(rows) == len(ODD) and all(list(r.pieces) == library.encode(r.text or "") and r.decoded == (r.text or "") for r in rows)
    assert set(encoded.columns) == set(odd.columns) and pieces.encode(none, path).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    assert all(list(r.pieces) == library.encode(r.text) for r in pieces.encode(docs, path, giant=500, chunk=170).collect())


@pytest.mark.parametrize("chunk", [5, 37, 400])
def test_max_plus_scan(chunk):
    m = pieces.model(str(public_tokenizers.path("piece_bpe_32k.model")))
    rng = np.random.default_rng(chunk)
    pool = ["the", "ing", "a", "tion", " ", "  ", "\n", "é", "漢", "龘", "...", "====", "aaaa", "12", "<s>", "▁", "er"]
    for text in ["".join(rng.choice(pool, rng.integers(1, 150))) for _ in range(60)] + ["a" * 500, " " * 90, "x" + " " * 40 + "y"]:
        whole = "▁" + text.replace(" ", "▁")
        cut = [(max(0, i - 64), i, min(i + chunk, len(whole))) for i in range(0, len(whole), chunk)]
        parts = [pieces.Chunk(m, whole[a : e + 64], s - a, e - a, s == 0, e == len(whole)) for a, s, e in cut]
        states = pieces.scan([c.matrix() for c in parts])
        assert [i for c, (x, y) in zip(parts, states, strict=True) for i in c.trace(x, y)] == m.library.encode(text)


# 5


def test_language(spark, folder, odd, none):
    large = folder.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{large}/documents.parquet").collect()}
    got = language.op5(spark, large).collect()
    apart = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(got) == len(truth) and sum(apart) / len(apart) > 0.97 and all(0 <= r.score <= 1 for r in got)
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat and then", "en"), ("привет мир как твои дела", "ru"), ("le chat est sur la table et puis", "fr")] * 20)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.langs == ("en", "fr", "ru") and model.allowed.sum() == 3
    mixed = "the cat sat on the mat and then привет мир как твои дела le chat est sur la table et puis"
    assert [s[0] for s in language.spans(model, [mixed])[0]] == ["en", "ru", "fr"]
    rows = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[5].lang_score > 0
    assert language.identify(none, model).count() == 0 and language.fit(none).langs == ()
    assert language.identify(odd, language.fit(none)).first().lang_pred == "und"


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_is_best(seed):
    rng = np.random.default_rng(seed)
    sizes = [1, 7, 3, 5]
    scores = rng.normal(size=(sum(sizes), 3)) * 3
    text = np.repeat(np.arange(4), sizes)
    got = language.viterbi(scores, text, 4, penalty=2.0)
    import itertools

    at = 0
    for n in sizes:
        own = scores[at : at + n]
        value = lambda path, own=own: sum(own[i, s] for i, s in enumerate(path)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))
        assert math.isclose(value(got[at : at + n]), max(map(value, itertools.product(range(3), repeat=n))))
        at += n


# 6


def test_mixing(spark, odd, none):
    docs = [(i, "w " * ((i * 7) % 40 + 1), "en", f"s{i % 5}" if i % 11 else None, 0) for i in range(1500)]
    rows = mixing.mix(spark.createDataFrame(docs, DOCS)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source_size, r.target].append(r)
    total = sum(r.size for r in rows)
    assert math.isclose(sum(t for _, t in by), 1.5 * total) and all(t <= 2 * s + 1e-9 for s, t in by)
    for (s, t), own in by.items():
        assert sum(r.size for r in own) == s and abs(sum(r.size * r.copies for r in own) - t) <= 40 and all(0 <= r.copies <= 2 for r in own)
    again = mixing.mix(spark.createDataFrame(docs, DOCS).repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    small = mixing.mix(odd).collect()
    assert len(small) == len(ODD) and {r.copies for r in small} <= {0, 1, 2} and mixing.mix(none).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and Counter(r.doc_id for r in out.collect()) == {i: n for i in {r.doc_id for r in small} if (n := sum(r.copies for r in small if r.doc_id == i))}


# 8


def test_rules(spark, odd, none):
    texts = ["a b c d a b c x", "x y\nx y\n\n \nz", "# $ a", "a b", "r r r r r", LONG, None, "", "q " * 60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in rules.text_counts(df).collect():
        w = words(r.text)
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = Counter(three)
        at = {i + o for i, x in enumerate(three) if many[x] > 1 for o in range(3)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in r.text or ""))
        assert (r.n_repeat_words, r.n_dup_lines) == (len(at), len(lines) - len(set(lines)))
    judged = rules.judge(rules.text_counts(odd).drop("text")).collect()
    assert len(judged) == len(ODD) and not any(r.kept for r in judged if r.n_words < 50)
    assert rules.judge(rules.text_counts(none)).count() == 0


# 9


def plain_links(rows, least=0.98):
    unit = []
    for _, v, label in rows:
        good = label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if good else None)
    return [
        (i, j) for i in range(len(rows)) for j in range(i)
        if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least
    ]


@pytest.mark.parametrize("part", [24, 1024])
def test_embeddings(spark, part, monkeypatch):
    monkeypatch.setattr(embeddings, "PART", part)
    monkeypatch.setattr(embeddings, "TREE", part // 3)
    rng = np.random.default_rng(part)
    rows = []
    for k in range(12):
        base = rng.normal(size=8)
        rows += [[float(x) for x in base + rng.normal(size=8) * rng.choice([0, 0.02, 0.1, 0.3])] for _ in range(25)]
    rows = [(i, v, int(i % 3 == 0)) for i, v in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 8, 1), (n + 2, [float("nan")] + [1.0] * 7, 1), (n + 3, rows[3][1], None), (n + 4, rows[3][1], rows[3][2]), (n + 5, [None] + [1.0] * 7, 0), (n + 6, rows[3][1][:4], rows[3][2])]
    got = {r.vec_id: r for r in embeddings.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("x"))).collect()}
    links = plain_links(rows)
    count = Counter(x for pair in links for x in pair)
    assert [got[i].n_links for i in range(len(rows))] == [count[i] for i in range(len(rows))] and sum(count.values()) > 100
    assert [got[i].component for i in range(len(rows))] == groups(len(rows), links)
    assert embeddings.near_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_cover_tree():
    rng = np.random.default_rng(2)
    x = embeddings.unit(np.concatenate([rng.normal(size=(300, 6)), rng.normal(size=(1, 6)) + rng.normal(size=(200, 6)) * 0.01]))
    tree = embeddings.CoverTree(x)
    for node, (a, b) in enumerate(tree.span):
        assert np.sqrt(((x[tree.order[a:b]] - tree.centres[node]) ** 2).sum(axis=1)).max() <= tree.radii[node] + 1e-12
        c, d = tree.child[node]
        assert c == d or (tree.span[c][0], tree.span[d - 1][1]) == (a, b) and all(tree.radii[c:d] <= tree.radii[node] / 2 + 1e-9)
    assert sorted(tree.order.tolist()) == list(range(500))


# 10


def test_lm(spark, odd, none):
    rng = np.random.default_rng(4)
    vocabulary = [f"W{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 40), p=p / p.sum())) for _ in range(200)] + [None, "", "never seen"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("score", F.lit("x"))
    model = lm.fit(df.where("doc_id < 150"), shard_tokens=500)
    assert model.shards > 3 and model.frequent.any()
    got = sorted(lm.perplexity_scores(df, model).collect())
    token = lambda t: [w.lower() for w in words(t)] + [""]
    two, one = Counter(), Counter()
    for t in texts[:150]:
        w = token(t)
        two.update(zip([" ", *w], w, strict=False))
        one.update(w)
    total, kinds = sum(one.values()), len(one)
    left = Counter(b for _, b in two)
    after = defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), c in two.items():
        after[a][0] += c
        after[a][min(c, 3)] += 1
    cut = lambda c: (0.0, *lm.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]))
    d2, d1 = cut(two), cut(left)
    spare = sum(d1[min(k, 3)] for k in left.values())

    def prob(a, b):
        k = left.get(b, 0)
        low = (max(k - d1[min(k, 3)], 0) + spare / (kinds + 1)) / sum(left.values())
        if a not in after:
            return low
        c, s = two.get((a, b), 0), after[a]
        return (max(c - d2[min(c, 3)], 0) + sum(d2[i] * s[i] for i in (1, 2, 3)) * low) / s[0]

    assert math.isclose(sum(prob("w1", w) for w in one) + prob("w1", "never"), 1.0)
    for r, t in zip(got, texts, strict=True):
        w = token(t)
        assert (r.n_tokens, r.n_known) == (len(w), sum(x in one for x in w))
        assert math.isclose(r.base_score, sum(math.log10((one[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(prob(a, b)) for a, b in zip([" ", *w], w, strict=False)), rel_tol=1e-9)
    assert lm.perplexity_scores(odd, model).count() == len(ODD) and lm.perplexity_scores(none, model).count() == 0
    empty = lm.fit(none)
    assert lm.perplexity_scores(odd, empty).where("score <> 0 or n_known <> 0").count() == 0
