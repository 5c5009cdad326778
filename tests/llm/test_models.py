"""Tokens, packing, classifiers, near-duplicates, decontamination, pipeline: against brute force, round trips, held-out labels."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellgrid.llm import decontaminate, langid, near_dups, packing, quality, queries, textvec, token_store, tokens
from cellgrid.llm.common import hash_sample, scratch

SCHEMA = "doc_id long, text string"
ODD = ["", None, "it's  a\n\n test 's don't", "a  b   c \n d", " lead", "trail  ", "\n", "x\n", "12ab 3.5!! ,, é×÷ñ", "日本語 テスト", "tab\t\tx", "  ", "<|endoftext|> x", "\r\n a\r\n\tb ", "ª²³ ¿qué?", "a" * 5000 + " b", "''''s 's", "é", "\x1c x\x85y", "a <|endoftext|> b", "<|endoftext|"]
# two words that polynomial hashes modulo 2**64 can't tell apart
_BITS = [bin(i).count("1") & 1 for i in range(2048)]
TWINS = ["".join("ab"[b] for b in _BITS), "".join("ba"[b] for b in _BITS)]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", None) for i, t in enumerate(ODD)] + [(None, "no id", "x", "y"), (3, ODD[3], "x", "y"), (3, "another text", None, "y")]
    return spark.createDataFrame(rows, SCHEMA + ", score string, lang string").withColumn("_text", F.lit(1))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# tokens


def test_pieces_give_the_librarys_ids(library, documents):
    enc = tokens.Encoder(tokens.default_path())
    texts = ODD + TWINS + [r.text for r in documents.select("text").collect()]
    assert 50256 in library("a <|endoftext|> b")
    for _ in range(2):
        ids, at = enc.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library(t), t
    letters = "ab é1.,'\n\t _-日ß"
    rng = random.Random(5)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)]
    ids, at = enc.encode(pa.array(texts).slice(1000))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(2000)] == [library(t) for t in texts[1000:]]


def test_pieces_whose_hashes_collide(library, documents, monkeypatch):
    whole = textvec.range_hashes
    monkeypatch.setattr(textvec, "range_hashes", lambda *a: whole(*a) & np.uint64(0xF00000000000000F))
    enc = tokens.Encoder(tokens.default_path())
    texts = ODD + [r.text for r in documents.select("text").limit(50).collect()]
    for _ in range(2):
        ids, at = enc.encode(pa.array(texts))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [library(t) for t in texts]


def test_word_hashes():
    hashes, first = textvec.words(*textvec.text_bytes(pa.array([*TWINS, TWINS[0].upper(), "A" * 64, "a" * 65, "a" * 64, "a\0", "a"])))
    assert first.tolist() == list(range(9))
    assert len(set(hashes.tolist())) == 6 and hashes[0] == hashes[2] and hashes[3] == hashes[5]


@pytest.mark.parametrize("name", ["odd", "documents", "none"])
def test_token_store(spark, request, library, name, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_DOCS", 7)
    docs = request.getfixturevalue("odd" if name == "none" else name)
    docs = docs.limit(0) if name == "none" else docs
    path = scratch(spark, "test-store")
    token_store.write(docs, path)
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for i, t in rows:
        ids = [*library(t), 2]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = token_store.read(spark, path, with_ids=True).collect()
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=lambda r: r[1]) == want
    assert {(r.start, tuple(r.ids)) for r in got} == {(w[1], (*library(t), 2)) for w, (_, t) in zip(want, rows, strict=True)}
    for i, t in rows[-3:]:
        assert token_store.read_document(spark, path, i) == [*library(t), 2]
    assert token_store.read_document(spark, path, 10**9) is None
    stored = spark.read.parquet(f"{path}/dictionary").head()
    assert len(stored.dict_hash) == 64 and (stored.why_none is None) == bool(stored.dictionary) == (name == "documents")


def test_a_hot_id_is_split(spark, library):
    docs = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("the same words here "), (F.col("id") % 3).cast("string")).alias("text")).repartition(4)
    path = scratch(spark, "test-store")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small parts are put together
    try:
        token_store.write(docs, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_store.read(spark, path).orderBy("start").collect()
    sizes = [len(library(f"the same words here {i}")) + 1 for i in range(3)]
    assert len(got) == 4000 and [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1]) and got[-1].start + got[-1].n_tokens == 1334 * sizes[0] + 1333 * (sizes[1] + sizes[2])
    assert spark.read.parquet(f"{path}/parts").count() > 2


# packing


@pytest.mark.parametrize("seed", range(6))
def test_differencing_and_windows(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 100) for _ in range(rng.randrange(1, 60))]
    for k in (1, 2, 5, 17):
        windows = packing.differencing(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and len(windows) == k
    if len(sizes) > 30:
        sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 3)]
        assert max(sums) - min(sums) <= max(sizes) // 4
    lengths = [rng.choice([1, 2, 30, 64, 65, 100, 300]) for _ in range(rng.randrange(0, 50))]
    windows = packing.pack(lengths, 64)
    covered = defaultdict(list)
    for w in windows:
        n = sum(x[2] for x in w)
        assert n == 64 or n & (n - 1) == 0
        for d, s, size in w:
            covered[d].append((s, size))
    for d, n in enumerate(lengths):
        at = 0
        for s, size in sorted(covered[d]):
            assert s == at and size > 0
            at += size
        assert at == n
    assert sum(sum(x[2] for x in w) < 64 for w in windows) <= 7


def test_the_window_count_rises():
    seen = []
    whole = packing.differencing
    packing.differencing = lambda sizes, k: seen.append(k) or whole(sizes, k)
    try:
        windows = packing.balanced([40] * 10, 64)  # 400 ids would fill 7 windows, but no two items fit in one
        assert seen[0] == 7 and seen == sorted(set(seen)) and len(windows) == seen[-1] == 10
        seen.clear()
        assert len(packing.balanced([16] * 8, 64)) == 2 and seen == [2]
    finally:
        packing.differencing = whole
    rng = random.Random(1)
    sizes = [rng.randrange(1, 65) for _ in range(400)]
    sums = [sum(sizes[i] for i in w) for w in packing.balanced(sizes, 64)]
    assert max(sums) <= 64 and sum(sums) == sum(sizes)


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_packing(request, library, name):
    docs = request.getfixturevalue(name)
    want = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id].append([*library(r.text), 1])
    sequences, parts, got = defaultdict(list), defaultdict(list), packing.pack_documents(docs, with_ids=True, group_tokens=1 << 16).collect()
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == crc(r.ids)
        sequences[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    tokens_in = sum(len(x) for v in want.values() for x in v)
    padded = sum(n if (n := sum(p[1] for p in s)) & (n - 1) == 0 else 2048 for s in sequences.values())
    assert padded - tokens_in <= 0.01 * padded
    for i, whole in want.items():
        if len(whole) == 1:
            assert sum((list(p[1]) for p in sorted(parts[i])), []) == whole[0] and {p[2] for p in parts[i]} == {len(whole[0])}
        else:
            assert sum(len(p[1]) for p in parts[i]) == sum(map(len, whole))
    assert packing.pack_documents(docs.limit(0)).count() == 0


# classifiers


def test_quality(spark, sf_dir, odd):
    got = queries.op1_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.held_out for r in got} == {zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got}
    assert sum(r.predicted == r.quality for r in held) >= 0.85 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    messy = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).unionByName(spark.createDataFrame([(None, 1), (1, None), (2, 7), (10**9, 0)], "doc_id long, quality int"))
    model = quality.fit(docs, messy)
    assert quality.scored(odd, model).count() == odd.count()
    assert quality.scored(odd.limit(0), model).count() == 0
    kept = quality.kept(odd, model, threshold=0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert {r.score for r in quality.scored(odd, quality.fit(docs, labels.limit(0))).collect()} == {quality.PRIOR}


def test_quality_is_an_exact_vote():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 5)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    m = quality.Model(np.ones(5, np.float32), np.zeros(5, np.float32), np.eye(5, dtype=np.float32), v, (rng.random(40) < 0.5).astype(np.float32))
    x = rng.normal(size=(9, 5)).astype(np.float32)
    for row, s in zip(x, m.scores(x, block=4), strict=True):
        near = sorted(((float(row @ w / np.linalg.norm(row)), y) for w, y in zip(v, m.labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(c, 0) ** 2, y) for c, y in near]
        assert abs(s - (sum(c * y for c, y in votes) + quality.PRIOR_VOTES * quality.PRIOR) / (sum(c for c, _ in votes) + quality.PRIOR_VOTES)) < 1e-5


def test_equal_cosines_all_vote():
    v = np.eye(2, dtype=np.float32)[[0] * 20 + [1] * 5]
    m = quality.Model(np.ones(2, np.float32), np.zeros(2, np.float32), np.eye(2, dtype=np.float32), v, np.array([1] * 5 + [0] * 15 + [1] * 5, np.float32))
    assert abs(m.scores(np.array([[1, 0]], np.float32))[0] - (5 + quality.PRIOR_VOTES * quality.PRIOR) / (20 + quality.PRIOR_VOTES)) < 1e-6


def test_one_id_many_times(spark):
    docs = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 4000).cast("string")).alias("text"), F.lit("xx").alias("lang"))
    labels = spark.createDataFrame([(1, 1), (2, 0), *((10**6 + i, 0) for i in range(5000))], "doc_id long, quality int")
    docs = docs.unionByName(spark.createDataFrame([(2, "another", "yy")], "doc_id long, text string, lang string"))
    model = quality.fit(docs, labels)
    assert len(model.labels) == quality.SAMPLE + 1  # labels without a document don't take the others' places
    assert langid.fit(docs).languages == ["xx", "yy"]


def test_loss_weighted_decoding():
    rng = np.random.default_rng(3)
    code = langid.codewords(5)
    bits = code.shape[1]
    m = langid.Model(list("abcde"), code, np.zeros(4), rng.normal(size=(4, bits)).astype(np.float32), rng.normal(size=bits).astype(np.float32), rng.random(bits))
    x = rng.normal(size=(30, 4))
    langs, score = m.predict(x)
    for row, lang, p in zip(x, langs, score, strict=True):
        margin = [sum(row[i] * m.weights[i, b] for i in range(4)) + m.bias[b] for b in range(bits)]
        loss = [sum(m.trust[b] * math.log1p(math.exp(-langid.SHARPNESS * margin[b] * word[b])) for b in range(bits)) for word in code]
        assert lang == "abcde"[int(np.argmin(loss))] and abs(p - 1 / sum(math.exp(min(loss) - v) for v in loss)) < 1e-5
    same = langid.Model(["a", "b"], np.array([[1.0], [1.0]]), np.zeros(1), np.ones((1, 1)), np.zeros(1), np.ones(1))
    langs, score = same.predict(np.ones((2, 1)))
    assert langs == ["a", "a"] and (score == 0.5).all()  # a tie: the first, and ambiguous


def test_language(spark, sf_dir, odd):
    got = queries.op8_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.held_out for r in got} == {zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = langid.predicted(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.lang_pred for r in rows}
    assert [by[i] for i, t in enumerate(ODD) if i != 3 and not re.search(r"[^\W\d_]", t or "")] and all(by[i] == "und" for i, t in enumerate(ODD) if i != 3 and not re.search(r"[^\W\d_]", t or ""))
    assert by[17] != "und" and by[9] != "und"
    assert langid.predicted(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.predicted(odd, langid.fit(odd.filter("lang is null"))).collect()} == {"und"}
    one = langid.fit(odd)  # one language alone, y
    assert {r.lang_pred for r in langid.predicted(odd, one).collect()} == {"y", "und"}


def test_every_language_is_learned(spark, monkeypatch):
    rng = random.Random(8)
    signs = {i: rng.sample("abcdefghijklmnopqrstuvwxyz", 5) for i in range(70)}
    text = lambda i: " ".join("".join(rng.choice(signs[i]) for _ in range(rng.randrange(2, 7))) for _ in range(80))
    rows = [(100 * i + k, text(i), f"l{i}") for i in range(70) for k in range(12 if i < 64 else 6)]  # six rarer ones
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == sorted(f"l{i}" for i in range(70))
    new = spark.createDataFrame([(i, text(i)) for i in range(70)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predicted(new, model).collect()}
    assert sum(got[i] == f"l{i}" for i in range(70)) >= 67 and all(got[i] == f"l{i}" for i in range(64, 70))
    monkeypatch.setattr(langid, "HELD", 0)  # the sums give the same model
    same = langid.fit(docs)
    assert same.languages == model.languages
    for name in ("mean", "weights", "bias", "trust"):
        assert np.allclose(getattr(same, name), getattr(model, name), atol=1e-3), name


@pytest.mark.parametrize("n", [2, 4, 7, 8, 30])
def test_codewords(n):
    code = langid.codewords(n)
    gaps = [int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)]
    assert min(gaps) >= max(1, code.shape[1] // 4)


def test_ngram_counts():
    texts = ["Abc", "", "é a" * 900, None, "x"]
    buf, offsets = textvec.text_bytes(pa.array(texts))
    old, textvec.CHUNK_BYTES = textvec.CHUNK_BYTES, 100
    try:
        got = textvec.ngram_counts(buf, offsets, 64, lower=False)
    finally:
        textvec.CHUNK_BYTES = old
    whole = textvec.ngram_counts(buf, offsets, 64, lower=False)
    assert (got == whole).all()
    for row, t in zip(got, texts, strict=True):
        n = len((t or "").encode())
        assert row[:256].sum() == n and row[256:].sum() == max(0, n - 1) + max(0, n - 2)


def test_words_across_blocks():
    texts = ["One two\tTHREE  four", "", "x" * 20_000 + " y", None, "ends", "one TWO"]
    buf, offsets = textvec.text_bytes(pa.array(texts))
    whole, first = textvec.words(buf, offsets)
    old, textvec.CHUNK_BYTES = textvec.CHUNK_BYTES, 8
    try:
        small, again = textvec.words(buf, offsets)
    finally:
        textvec.CHUNK_BYTES = old
    assert (whole == small).all() and (first == again).all() and first.tolist() == [0, 4, 4, 6, 6, 7, 9]
    assert whole[0] == whole[7] and whole[1] == whole[8] and len(set(whole.tolist())) == 7


def test_hash_sample(spark):
    rows = spark.range(5000).withColumn("doc_id", F.col("id")).withColumn("g", F.col("id") % 2)
    a, b = (sorted(r.doc_id for r in hash_sample(rows, 100).collect()) for _ in range(2))
    assert a == b and len(a) == 100
    assert {r.g: r.n for r in hash_sample(rows, 50, by="g").groupBy("g").agg(F.count("*").alias("n")).collect()} == {0: 50, 1: 50}
    assert hash_sample(rows, 10**6).count() == 5000 and hash_sample(rows.limit(0), 5).count() == 0


# near-duplicates


def exact_components(rows, n):
    sets = defaultdict(set)
    sizes = []
    for i, t in rows:
        w = re.findall("[^ \t\n\x0b\x0c\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        sizes.append((i, len(s)))
        if s and i is not None:
            sets[i].add(frozenset(s))
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    post = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            for x in s:
                post[x].add(i)
    for i in ids:
        for s in sets[i]:
            near = defaultdict(int)
            for x in s:
                for j in post[x]:
                    if j < i:
                        near[j] += 1
            for j in near:
                if any(100 * len(s & t) >= 80 * len(s | t) for t in sets[j]):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
    return sorted(((i, n, root(i) if i is not None else None, i is None or root(i) == i) for i, n in sizes), key=str)


def near_rows(df, n):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(df, words=n).collect()), key=str)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, documents, odd, words):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(1000 - i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    for k in range(150):  # one large group of near copies, and a chain whose ends aren't alike
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(80)] = rng.choice(vocabulary)
        rows.append((2000 + k, " ".join(w)))
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for k in range(12):
        chain = chain[4:] + [f"new{k}{j}" for j in range(4)]
        rows.append((3000 + k, " ".join(chain).upper()))
    rows += [(None, " ".join(base)), (1, ""), (2, None), (3, "one"), (4, "ONE"), (5, "one two"), (7, rows[0][1]), (7, rows[1][1]), (6, " ".join(base * 300))]
    assert near_rows(spark.createDataFrame(rows, SCHEMA), words) == exact_components(rows, words)
    whole = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert near_rows(documents, words) == exact_components(whole, words)
    assert near_rows(odd, words) == exact_components([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], words)
    assert near_rows(odd.limit(0), words) == []


def test_near_duplicates_in_a_crowded_region(spark):
    passage, rows, want = [f"p{k}" for k in range(301)], [], {}
    for i in range(2000):  # unlike texts (0.75) share a passage; every tenth has one that is 0.804 alike
        own = [f"t{i}x{k}" for k in range(49)]
        rows.append((i, " ".join(passage + own)))
        want[i] = i
        if i % 10 == 0:
            rows.append((10_000 + i, " ".join(passage + own[:12] + [f"u{i}x{k}" for k in range(37)])))
            want[10_000 + i] = i
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_bits_lose_less_than_the_forest():
    n, most = near_dups.TREES * near_dups.DEPTH, int(near_dups.BITS_APART * near_dups.TREES * near_dups.DEPTH)
    lost = sum(math.comb(n, k) * 0.1**k * 0.9 ** (n - k) for k in range(most + 1, n + 1))
    assert lost < (1 - 0.8**near_dups.MIN_DEPTH) ** near_dups.TREES


def test_one_of_each_group_stays(odd):
    kept = near_dups.without_near_duplicates(odd.unionByName(odd.filter("doc_id = 3")))
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(3) == 1 and ids.count(None) == 1


@pytest.mark.parametrize("n", [1, 40, 500])
def test_components(spark, n):
    rng = random.Random(n)
    chain = [(i, i + 1) for i in range(10_000, 10_000 + n)]
    rng.shuffle(chain)
    links = [(a, b) for a, b in chain] + [(5, 9), (9, 7), (7, 5), (20_000, 1)]
    got = {r.node: r.comp for r in near_dups.components(spark.createDataFrame([(min(x), max(x)) for x in links], "a long, b long").repartition(4)).collect()}
    want = {10_000 + i: 10_000 for i in range(1, n + 1)} | {9: 5, 7: 5, 20_000: 1}
    assert {k: v for k, v in got.items() if k != v} == want


# decontamination


def smith_waterman(a, b):
    best, above = 0, [0] * (len(a) + 1)
    for x in b:
        here = [0]
        for j, y in enumerate(a, 1):
            here.append(max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, here[j - 1] - 1))
        best, above = max(best, *here), here
    return best


def test_alignment():
    rng = np.random.default_rng(2)
    windows, items = rng.integers(1, 6, (30, 25)).astype(np.uint64), rng.integers(1, 6, (30, 9)).astype(np.uint64)
    lengths = rng.integers(1, 10, 30)
    for i, n in enumerate(lengths):
        items[i, n:] = 0
    best, end = decontaminate.align(windows, items, lengths)
    for i, n in enumerate(lengths):
        assert best[i] == smith_waterman(windows[i].tolist(), items[i, :n].tolist())
        assert smith_waterman(windows[i, : end[i]].tolist(), items[i, :n].tolist()) == best[i]


def test_leaks(spark, sf_dir, documents):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(30)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"r{rng.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 60)))) for i in range(30)] + [(100, None), (101, ""), (102, "c1 c2"), (None, "an item without id that someone copied in full")]
    rows, want = [], set()
    for d in range(200):
        text = [word() for _ in range(rng.randrange(0, 300))]
        if d % 4 == 0:
            item = rng.randrange(30)
            copy = items[item][1].split()
            for k in range(len(copy)):
                if rng.random() < 0.12:  # an eighth of the words is edited
                    copy[k] = rng.choice([f"new{k}", "", copy[k] + " extra"])
            at = rng.randrange(len(text) + 1)
            text[at:at] = [*copy]
            want.add((d, item))
        rows.append((d, " ".join(text).upper() if d % 8 == 0 else ", ".join(text)))
    rows += [(None, items[3][1]), (900, None), (901, ""), (902, items[5][1] * 2), (902, items[6][1]), (903, items[-1][1])]
    want |= {(None, 3), (902, 5), (902, 6), (903, None)}
    docs, bench = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", item_id int"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(decontaminate.THRESHOLD <= r.score <= 1 for r in got)
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns
    leaked = {d for d, _ in want}
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in leaked), key=str)
    for a, b in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert decontaminate.leaks(a, b).count() == 0
    # the tables: every document that has an item's words in a row is found
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    wanted = {(d.doc_id, i.item_id) for i in bench.collect() for d in documents.collect() if plain(i.text) in plain(d.text)}
    assert wanted <= {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents, bench).collect()}


def test_leaks_without_a_full_copy(spark):
    rng = random.Random(11)
    items = [[f"i{i}x{k}" for k in range(rng.randrange(15, 50))] for i in range(40)]
    docs = []
    for i, words in enumerate(items):
        noise = [f"n{i}x{k}" for k in range(60)]
        if i % 2:  # every fourth word is another
            copy = [f"o{k}" if k % 4 == 3 else w for k, w in enumerate(words)]
        else:  # one half, several times; the other half is nowhere
            half = (len(words) + 1) // 2
            copy = words[:half] if i % 4 else words[-half:]
        docs += [(i + 1000 * c, " ".join(noise[:30] + copy + noise[30:])) for c in range(1 if i % 2 else 3)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted((d, d % 1000) for d, _ in docs)


def scores(rows, items):
    """Every (doc, item) whose best alignment counts, by the plain algorithm over whole texts."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    split = [(i, words(t)) for i, t in items]
    found = {}
    for d, t in rows:
        w = words(t)
        for i, item in split:
            if len(item) >= 3 and len(set(item) & set(w)) * 2 >= 0.4 * len(set(item)):
                s = smith_waterman(w, item)
                if s >= 2 * min(8, len(item)) and s >= 0.8 * len(item):
                    found[d, i] = s / (2 * len(item))
    return found


def test_leaks_equal_brute_force(spark, documents, sf_dir):
    rng = random.Random(12)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in documents.collect() if len(r.text) < 4000][:60]
    for k, (_, text) in enumerate(bench * 5):  # one word in 2 to 5 is another, gone, or has one more before it
        words = text.split()
        every, how = 2 + k % 4, rng.randrange(3)
        copy = [x for i, w in enumerate(words) for x in ([w] if (i + 1) % every else [[f"new{i}"], [], [f"more{i}", w]][how])]
        around = [rng.choice(rows[:60])[1].split()[:30] for _ in range(2)]
        rows.append((10_000 + k, " ".join([*around[0], *copy, *around[1]])))
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    want = scores(rows, bench)
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert sum(d >= 10_000 for d, _ in want) > 100


def test_a_long_item(spark):
    words = [f"w{k}" for k in range(8000)]
    docs = [(i, " ".join(words[: 3600 + 800 * i])) for i in range(3)]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    assert [(r.doc_id, round(r.score, 3)) for r in got.orderBy("doc_id").collect()] == [(0, 0.45), (1, 0.55), (2, 0.65)]


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_ITEM_WORDS", 8)
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(10))) for i in range(5)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(bench.withColumnRenamed("item_id", "doc_id"), bench).collect()} == {(i, i) for i in range(5)}


# pipeline


def test_pipeline(spark, sf_dir, documents, library):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality classifier", "line dedup", "near duplicates", "decontamination", "packing"]
    docs = documents
    seen = [docs.count()]
    for _, stage in p.STAGES[:-1]:
        new = stage(spark, docs, sf_dir)
        path = scratch(spark, "stage")
        new.write.parquet(path)
        new = spark.read.parquet(path)
        assert new.columns == documents.columns and new.dtypes == documents.dtypes
        docs = new
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[1] < seen[0] and seen[2] == seen[1] and seen[3] < seen[2] and seen[4] < seen[3]
    assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    want = {r.doc_id: len(library(r.text)) + 1 for r in docs.collect()}
    pieces = p.run(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == want
    empty = documents.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_stages_equal_brute_force(spark, sf_dir, documents):
    import corpus_pipeline as p

    stages, rows = dict(p.STAGES), lambda df: {r.doc_id: r.text for r in df.collect()}
    whole = rows(documents)
    # quality: what the vote of op1's model gives, and every document with the held-out label 1
    scores_of = {r.doc_id: r.predicted for r in queries.op1_quality(spark, sf_dir).collect()}
    good = rows(stages["quality classifier"](spark, documents, sf_dir))
    assert good == {i: t for i, t in whole.items() if scores_of[i]}
    # line dedup: keys of ten documents of those given
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    count = defaultdict(int)
    for t in whole.values():
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            count[k] += 1
    lines = rows(stages["line dedup"](spark, documents, sf_dir))
    assert lines == {i: "\n".join(x for x in (t or "").split("\n") if count[key(x)] < 10) for i, t in whole.items()} and lines != whole
    # near-duplicates: the least id of each group, by full sets of five-word shingles
    kept = {i for i, _, _, first in exact_components(list(whole.items()), 5) if first}
    assert set(rows(stages["near duplicates"](spark, documents, sf_dir))) == kept and len(kept) < len(whole)
    # decontamination: plain alignment of all pairs
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {d for d, _ in scores(list(whole.items()), bench)}
    assert set(rows(stages["decontamination"](spark, documents, sf_dir))) == set(whole) - leaked and leaked


def test_registered_queries(spark, sf_dir):
    import __spark_entry__ as e

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11)) and "pipeline" in e.queries()
    assert math.isclose(len(names), 10)
