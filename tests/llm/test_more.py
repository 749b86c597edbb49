"""Clashing names, planted signals at the ends of long texts, ties, and the pipeline, each against brute force."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import embeddings, language, lm, mixing, pieces, quality, rules, simhash, tokens
from brindle.llm.common import bounded_sample, sieved

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "one two three", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (3, "four five", "fr", "a", 2), (None, "six " * 60, "en", "a", 3)]
#: Names that the operators give columns of their own.
NAMES = (
    "row rows id h g text_ size target edge take source_size copies budget prefix below digit _source _time _times _part found spans lang_pred_ score_ maybe _slot _bucket _bits _byte "
    "node root best keys key low n i j s o u r by of part shard k _row _text _n _w _stop _all _left _rate _s _k _words _lines _hashes _windows _found _at _covers kept_ _lang _source_ measure "
    "symbols_most length_least all_length_most upto total bin component print _turns _conv _q q x y epoch worth child salt home away class weight vector kind label_"
).split()


def clash(df):
    have = {c.lower() for c in df.columns}
    return df.withColumns({n: F.lit(f"own {n}") for n in NAMES if n.lower() not in have})


PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
TRAIN = [(i, t, g) for i, (t, g) in enumerate([("the cat sat on the mat and then", "en"), ("le chat est sur la table et puis", "fr")] * 9)]


def run_mixed(spark, docs):
    return mixing.mixed(docs)


def run_mix(spark, docs):
    return mixing.mix(docs)


def run_keep_one(spark, docs):
    return simhash.keep_one(docs)


def run_near(spark, docs):
    return simhash.near_duplicates(docs)


def run_pieces(spark, docs):
    return pieces.decode(pieces.encode(docs, PATH, giant=100, chunk=40), PATH)


def run_language(spark, docs):
    return language.identify(docs, language.fit(spark.createDataFrame(TRAIN, "doc_id long, text string, lang string")))


def run_rules(spark, docs):
    return rules.judge(rules.text_counts(docs.drop(*[n for n in NAMES if n.startswith("_")])).drop("text"))


def run_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    return quality.score(docs, quality.fit(docs, clash(labels)))


def run_lm(spark, docs):
    return lm.perplexity_scores(docs, lm.fit(docs, shard_tokens=20))


def run_sample(spark, docs):
    return bounded_sample(docs, "source", 2)


RUNS = [run_mixed, run_mix, run_keep_one, run_near, run_pieces, run_language, run_rules, run_quality, run_lm, run_sample]


@pytest.mark.parametrize("run", RUNS)
def test_names(spark, run):
    """An input with every internal column name gives the rows that the plain input gives, and passes its own columns where the operator does."""
    docs = spark.createDataFrame(ROWS, DOCS)
    plain, full = run(spark, docs), run(spark, clash(docs))
    own = [c for c in plain.columns if c in full.columns]
    assert own == plain.columns
    seen = lambda df: sorted(str(tuple(r)) for r in df.select(*own).collect())
    if run not in (run_mixed, run_mix, run_sample):  # these draw by a hash of the whole row
        assert seen(plain) == seen(full)
    else:
        assert full.count() >= 0
    for c in ("u", "rows", "target", "edge"):
        if c in full.columns and c not in plain.columns:
            assert {r[0] for r in full.select(c).collect()} <= {f"own {c}"}


def test_names_of_embeddings_and_tokens(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.001], 0), (3, [2.0, -1.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted(embeddings.near_links(clash(v)).collect()) == sorted(embeddings.near_links(v).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tokens.write_token_files(clash(spark.createDataFrame(ROWS, DOCS)), f"file://{tmp_path}/t", path)
    assert tokens.read_token_files(spark, f"file://{tmp_path}/t").count() == len(ROWS)


def test_sieve(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    keys = rows.where("id % 50 = 0").select("h")
    some = {r.id for r in sieved(rows, "h", keys).where("maybe").collect()}
    assert set(range(0, 5000, 50)) <= some and len(some) < 120
    assert sieved(rows, "h", keys.limit(0)).where("maybe").count() == 0 and sieved(rows, "h", keys).columns == ["h", "id", "maybe"]


# 1


def test_quality_by_hand(spark):
    """Scores by a loop over blocks and the calibration by plain gradient descent; counted strings by a set for each text."""
    import zstandard

    rng = np.random.default_rng(1)
    good, bad = ([f"{k}{i}" for i in range(300)] for k in ("fair", "junk"))
    docs = [(i, " ".join(rng.choice(good if i % 2 else bad, rng.integers(20, 300))), "en", "a", 0) for i in range(120)]
    df = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 100)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    rows = quality.score(df, model).collect()
    for r in rows:
        data = r.text.encode()
        blocks = [data[a : a + model.block] for a in range(0, len(data), model.block)]
        sizes = []
        for raw in (model.bad, model.good):
            c = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False, write_checksum=False)
            sizes.append(sum(len(c.compress(b)) for b in blocks))
        z = model.slope * (sizes[0] - sizes[1]) / len(data) + model.bias
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in rows)
    x, y = rng.normal(size=200), rng.integers(0, 2, 200).astype(float)
    slope, bias = quality._logistic(x, y, np.ones(200))
    a = b = 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(a * x + b)))
        a, b = a - 0.01 * ((p - y) * x).mean() * 10, b - 0.01 * (p - y).mean() * 10
    assert abs(a - slope) < 1e-3 and abs(b - bias) < 1e-3
    data = bytes(rng.integers(0, 4, 5000).astype(np.uint8))
    want = {int(quality.string_slots(data[i : i + 8])[0]) for i in range(len(data) - 7)}
    assert set(np.flatnonzero(quality.text_slots(data, part=700)).tolist()) == want


def test_quality_learns_from_ends(spark):
    """Texts of either label are alike but for their last words, far beyond any prefix."""
    rng = np.random.default_rng(2)
    common, good, bad = ([f"{k}{i}" for i in range(400)] for k in ("word", "fair", "junk"))
    text = lambda own: " ".join([*rng.choice(common, 12_000), *rng.choice(own, 400)])
    docs = [(i, text(good if i % 2 else bad), "en", "a", 0) for i in range(24)] + [(100, " ".join(rng.choice(good, 90)), "en", "a", 0), (101, " ".join(rng.choice(bad, 90)), "en", "a", 0)]
    df = spark.createDataFrame(docs, DOCS)
    model = quality.fit(df, spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int"))
    found = {r.doc_id: r.score for r in quality.score(df, model).where("doc_id >= 100").collect()}
    assert b"fair" in model.good and b"junk" in model.bad and found[100] > found[101]


def test_quality_labels(spark):
    """Contradictory labels are not learned from, repeated ones once; unlike texts of one id do not make the model depend on their order."""
    docs = [(i, ("fair " if i % 2 else "junk ") * 50 + str(i), "en", "a", 0) for i in range(40)] + [(1, "other text", "en", "a", 0)]
    labels = [(i, i % 2) for i in range(40)] * 2 + [(5, 0)]
    fit = lambda d: quality.fit(spark.createDataFrame(d, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert fit(docs) == fit(docs[::-1])


# 4


def test_special_tokens_and_random_access(spark, tmp_path):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "plain words here", " ".join(f"w{i}" for i in rng.integers(0, 5000, 250_000))]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(None, f"null {i}", "en", "a", 0) for i in range(300)] + [(7, "seven", "en", "a", 0), (7, "seven", "en", "a", 0)]
    tokens.write_token_files(spark.createDataFrame(rows, DOCS).repartition(3), f"file://{tmp_path}/t", path)
    got = defaultdict(list)
    for r in tokens.read_token_files(spark, f"file://{tmp_path}/t").collect():
        got[r.doc_id].append(np.frombuffer(r.ids, "<u4").tolist())
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append(library.encode(t, add_special_tokens=False).ids + [2])
    assert 50256 in want[0][0] and len(want[4][0]) > tokens.SHARD_TOKENS
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    for i in (0, 4, 7, None):
        assert sorted(x.tolist() for x in tokens.read_document(spark, f"file://{tmp_path}/t", i)) == sorted(want[i])
    assert tokens.read_document(spark, f"file://{tmp_path}/t", 99) == []


def test_repair_goes_to_the_end():
    """No pair is left that occurs LEAST times without overlap, inside documents."""
    rng = np.random.default_rng(4)
    phrases = [rng.integers(0, 50, rng.integers(5, 60)) for _ in range(30)]
    docs = [np.concatenate([phrases[i] for i in rng.integers(0, 30, 20)]) for _ in range(60)]
    row = tokens.repair(np.concatenate(docs), np.array([len(d) for d in docs]), 60)
    row["doc_id"] = np.arange(60).astype("<i8").tobytes()
    shard = tokens.Shard(row)
    left = Counter(p for i in range(60) for p in itertools.pairwise(shard.sequence[shard.place[i] : shard.place[i + 1]].tolist()))
    assert max((n for (a, b), n in left.items() if a != b), default=0) < tokens.LEAST and len(np.frombuffer(row["rounds"], "<i8")) > 3
    assert [x.tolist() for x in shard.documents()] == [d.tolist() for d in docs]


# 5


def test_language_by_hand(spark):
    """The counted table and word scores against a loop over n-grams; then spans of long texts, in parts, against whole ones."""
    train = [(1, "aba b\nAb", "x"), (2, "cd dc cab", "y"), (3, "aba", "x"), (4, None, "x"), (5, "zz", None)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))

    def plain(word):
        padded = f" {word} "
        return [(n, padded[i : i + n]) for n in range(1, language.LONGEST + 1) for i in range(len(padded) - n + 1) if not padded[i] == padded[i + n - 1] == " "]

    def slot(gram):
        n, text = gram
        codes = np.array([ord(c) for c in text])
        return next(int(h[0]) for k, h, _ in language.grams(codes) if k == n)

    counts = defaultdict(Counter)
    for _, t, lang in train:
        for w in (t or "").lower().split() if lang else ():
            for g in plain(w):
                counts[lang, g[0]][slot(g)] += 1
    size = 1 << language.BITS
    logs = lambda lang, n, h: math.log((counts[lang, n][h] + 0.5) / (sum(counts[lang, n].values()) + 0.5 * size))
    words = language.words_of(["aba cd zebra 12"])
    got = model.word_scores(words)
    for i, w in enumerate(["aba", "cd", "zebra"]):
        value = {lang: sum(logs(lang, n, slot((n, g))) for n, g in plain(w)) for lang in ("x", "y")}
        assert math.isclose(got[i, 0] - got[i, 1], (value["x"] - value["y"]) / language.LONGEST, rel_tol=1e-3, abs_tol=1e-3)
    assert got[3].tolist() == [0, 0] and model.langs == ("x", "y")


@pytest.fixture(scope="module")
def two_languages(spark):
    return language.fit(spark.createDataFrame(TRAIN, "doc_id long, text string, lang string"))


@pytest.mark.parametrize("most", [60, 1000, 40_000])
def test_language_of_long_texts(spark, two_languages, most):
    rng = np.random.default_rng(most)
    text = "".join(" ".join([rng.choice([TRAIN[0][1], TRAIN[1][1], "x" * 90, "12 . \n"])] * int(rng.integers(1, 30))) + rng.choice([" ", "\n", "  "]) for _ in range(120))
    assert "".join(language.parts_of(text, most)) == text
    if most > 90:  # no word is cut; words without a letter may fall to either side of a switch
        parts, whole = language.long_spans(two_languages, text, most), language.spans(two_languages, [text])[0]
        assert [(s[0], s[3]) for s in parts] == [(s[0], s[3]) for s in whole] and sum(s[2] for s in parts) == sum(s[2] for s in whole)
    assert sum(n for *_, n, _ in language.long_spans(two_languages, text, most)) >= len(text.split())


def test_language_counts_the_end_of_a_giant_text(spark, two_languages, monkeypatch):
    monkeypatch.setattr(language, "GROUP", 5000)
    text = (TRAIN[0][1] + " ") * 400 + (TRAIN[1][1] + " ") * 900
    r = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), two_languages).first()
    assert r.lang_pred == "fr" and [s.lang for s in r.lang_spans] == ["en", "fr"]


@pytest.mark.parametrize("n", [5, 300, 5000])
def test_max_plus_products_in_any_bracketing(n):
    rng = np.random.default_rng(n)
    scores = rng.normal(size=(n, 3)) * 3
    value = lambda path: scores[np.arange(n), path].sum() - 2.0 * (np.diff(path) != 0).sum()
    cut = [0, n // 5, n // 2, n - 1, n]
    m = [language.transfer(scores[a:b], 2.0) for a, b in itertools.pairwise(cut)]
    t = language.times
    assert np.allclose(t(t(m[0], m[1]), t(m[2], m[3])), t(m[0], t(m[1], t(m[2], m[3])))) and np.allclose(t(t(t(m[0], m[1]), m[2]), m[3]), language.transfer(scores, 2.0))
    whole = language._trace(scores, np.zeros(n, int), 1, 2.0, None)
    parts = [language.viterbi(scores[a:b], np.zeros(b - a, int), 1, 2.0, ends=e) for (a, b), e in zip(itertools.pairwise(cut), language.between(m), strict=True)]
    assert math.isclose(value(whole), value(np.concatenate(parts))) and math.isclose(value(whole), value(language.viterbi(scores, np.zeros(n, int), 1, 2.0)))


# 6


def test_mixing_of_equal_rows(spark):
    """Half of a source has one id and one text: as many of them are taken as the target needs."""
    rows = [(None, "a b c", "en", "s", 5)] * 3000 + [(i, "w " * (i % 9 + 1), "en", "t", 0) for i in range(600)] + [(None, None, "en", "u", i) for i in range(50)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == size]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 9
    again = mixing.mix(df.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mixed(df).count() == sum(r.copies for r in got)


# 7


def test_piece_matrices_in_any_bracketing(spark, monkeypatch):
    m = pieces.model(PATH)
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(["the", "ing", " ", "  ", "é", "漢", "====", "aaaa", "12"], 400))
    whole = "▁" + text.replace(" ", "▁")
    cut = [(max(0, i - 64), i, min(i + 20, len(whole))) for i in range(0, len(whole), 20)]
    mats = [pieces.Chunk(m, whole[a : e + 64], s - a, e - a, s == 0, e == len(whole)).matrix() for a, s, e in cut]
    left = mats[0]
    for x in mats[1:]:
        left = pieces.times(left, x)
    right = mats[-1]
    for x in mats[-2::-1]:
        right = pieces.times(x, right)
    assert left == right == {(0, ""): {(0, "")}}
    rows = [(1, k, *i, *j) for k, x in enumerate(mats) for i, js in x.items() for j in js]
    want = pieces.scan(mats)
    for fan in (2, 3, 100):
        got = sorted(pieces.boundary_states(spark.createDataFrame(rows, pieces.ENTRIES), len(mats), fan).collect())
        assert [((r.i, r.before), (r.j, r.after)) for r in got] == want


# 8


def test_rules_have_no_step(spark):
    """A group's cutoffs move little with one text more, whatever its size."""
    def cut(n):
        counted = [(i, "en", "a" if i < n else "b", 100, 500, 40 if i < n else 0, 0, 0) for i in range(n + 400)] + [(10_000, "en", "a", 100, 500, s, 0, 0) for s in range(0, 120, 2)]
        df = spark.createDataFrame(counted, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
        return sum(r.kept for r in rules.judge(df).where("doc_id = 10000").collect())

    seen = [cut(n) for n in (30, 49, 50, 51)]
    assert abs(seen[1] - seen[2]) <= 2 and abs(seen[2] - seen[3]) <= 2
    lone = spark.createDataFrame([(1, None, None, 100, 500, 0, 0, 0)], "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    assert rules.judge(lone).first().kept


# 9


@pytest.mark.parametrize("seed", range(4))
def test_visits_lose_no_neighbour(seed):
    rng = np.random.default_rng(seed)
    x = embeddings.unit(rng.normal(size=(400, 5)))
    y = embeddings.unit(x + rng.normal(size=x.shape) * 0.08)
    centres, reach = x[:20], 0.25
    _, may, _ = embeddings.visits(x, centres, reach)
    nearest, _, _ = embeddings.visits(y, centres, reach)
    near = np.linalg.norm(x - y, axis=1) <= reach
    assert near.sum() > 50 and may[np.arange(400), nearest][near].all() and may.mean() < 0.9


# 10


def test_arrays_off_a_mounted_folder(tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "_local", lambda path: None)
    for a in (np.arange(10, dtype=np.uint64), np.zeros(0, "<u8"), np.ones((3, 2), np.uint64), np.zeros(2, lm._STATS)):
        lm._save(f"file://{tmp_path}/x/a.npy", a)
        back = lm._open(f"file://{tmp_path}/x/a.npy")
        assert back.dtype == a.dtype and back.shape == a.shape and (back == a).all()
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["a.npy"]


# the pipeline


def plain_pipeline(spark, rows, labels, folder):
    """run() by hand: models are fitted by the operators, every decision is made here, row by row."""
    docs = spark.createDataFrame(rows, DOCS)
    model = quality.fit(docs, labels.where(F.col("doc_id").isNotNull()).where(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")))
    scorer = quality.Scorer(model)
    rows = [r for r in rows if scorer.score(r[1]) >= corpus_pipeline.QUALITY]
    held = lambda r: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 1
    found = language.fit(spark.createDataFrame([r for r in rows if not held(r)], DOCS))
    out = []
    for r in rows:
        spans = language.spans(found, [r[1] or ""])[0]
        letters = Counter()
        for lang, _, _, n in spans:
            letters[lang] += n
        if letters and max(letters.values()) >= corpus_pipeline.ONE_LANGUAGE * sum(letters.values()):
            out.append(r)
    from test_operators import plain_alike

    out.sort(key=lambda r: (r[0] is None, r[0] or 0))
    root = plain_alike([r[1] for r in out])
    groups = defaultdict(list)
    for i, k in enumerate(root):
        groups[k].append(out[i])
    return out, groups


def test_pipeline(spark, folder, tmp_path):
    """Every stage's rows against brute force on a table with nulls, empty texts, repeated ids and rows."""
    source = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    rows = [tuple(r) for r in source[:120]]
    good = rows[0]
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), (502, "123 456", "en", "a", 7), (None, good[1] + " and more", "en", None, 3), good, (good[0], rows[5][1], "en", "b", 1)]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out, groups = plain_pipeline(spark, rows, labels, folder)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        seen.append(docs.collect())
        assert docs.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
        docs = spark.createDataFrame(seen[-1], DOCS)
    assert sorted(map(str, (tuple(r) for r in seen[1]))) == sorted(map(str, out))
    assert len(seen[2]) == len(groups) and len(groups) < len(out)
    for own in groups.values():  # one of the rows with the group's first id
        assert sum(tuple(r) in own and r.doc_id == own[0][0] for r in seen[2]) >= 1
    library = pieces.model(PATH).library
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert set(map(str, (tuple(r)[:5] for r in final))) <= set(map(str, (tuple(r) for r in seen[2])))
    times = Counter(str(tuple(r)[:5]) for r in final)
    assert set(times.values()) <= {1, 2} and all(list(r.pieces) == library.encode(r.text or "") for r in final)
    size = {r.doc_id: len((r.text or "").split()) for r in seen[2]}
    assert abs(sum(len((r.text or "").split()) for r in final) - 1.5 * sum(size.values())) <= 0.1 * sum(size.values()) + max(size.values())


def test_pipeline_of_nothing(spark, folder, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert done.count() == 0 and done.columns[-1] == "pieces"
