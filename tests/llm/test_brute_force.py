"""Operators against plain versions, and their defined results for odd rows."""

import base64
import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import encode, jaccard, mixing, neighbours, pairs, quantiles, queries, repeated_lines, spam_pages, splitting, text, threads
from tests.compare import assert_same, connect

TOKENIZER = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken"
VARIED = st.text(alphabet="ab XY's't're've'll'd \n\t\r　 é中文字12٣_-!?.'’😀İß​", max_size=80)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# words and shingles


def plain_words(t):
    return re.findall(r"[一-鿿]|(?:(?![一-鿿])[^\W_])+", t.lower())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab 中文-_1é\n", max_size=30), max_size=5))
def test_words(texts):
    h, counts = text.words(texts)
    plain = [plain_words(t) for t in texts]
    assert counts.tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def sets(texts, width):
    out = []
    for t in texts:
        w = plain_words(t)
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    return out


def test_shingles_are_sets():
    texts = ["a b c d", "", "a b", "中文中文中文", "x y z x y z x y z"]
    _, at = jaccard.shingles(texts, 3)
    assert np.diff(at).tolist() == [len(s) for s in sets(texts, 3)]


# near-duplicates


def edited(rng, words):
    w = list(words)
    for _ in range(rng.randint(0, 6)):
        i = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.4:
            w[i] = f"n{rng.randrange(99)}"
        elif kind < 0.7:
            w.insert(i, f"n{rng.randrange(99)}")
        elif len(w) > 5:
            del w[i]
    return w


@pytest.mark.parametrize(("t", "width", "hot"), [(0.6, 3, 50_000), (0.6, 3, 2), (0.8, 5, 3), (0.4, 1, 8)])
def test_similar_texts_finds_every_pair(spark, t, width, hot):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(25)]  # few words, so that shingles are shared widely
    data, k = [], 0
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(12, 60))]
        for _ in range(rng.randint(1, 4)):
            data.append((k, " ".join(edited(rng, base))))
            k += 1
    data += [(1000, data[0][1]), (1001, data[0][1].upper()), (1002, None), (1003, ""), (None, data[0][1]), (1004, " ".join(f"u{i}" for i in range(400))), (1005, " ".join(f"u{i}" for i in range(390)))]
    df = spark.createDataFrame(data, "id bigint, t string").withColumn("n", F.lit(1)).withColumn("a", F.lit("x")).withColumn("h", F.lit(1))
    own = {i: s for (i, x), s in zip(data, sets([x or "" for _, x in data], width)) if i is not None and len(s) >= 4}
    want = {(a, b) for a, b in itertools.combinations(sorted(own), 2) if len(own[a] & own[b]) >= t * len(own[a] | own[b]) - 1e-9}
    classes, copies, near = jaccard.similar_texts(df, "id", "t", t, width, least=4, hot=hot)
    assert {tuple(r) for r in jaccard.member_pairs(copies, near, "id", "a", "b").collect()} == want
    assert {r.id for r in classes.collect()} == set(own)
    if hot == 2:
        group = {r.id: r.group_id for r in jaccard.groups(classes, near, "id").collect()}
        assert all(group[a] == group[b] for a, b in want)
        assert len(set(group.values())) == len(own) - forest(own, want)


def test_low_similarity_of_small_sets(spark):
    """One hot shared shingle is enough for a pair."""
    data = [(i, f"hot own{i}") for i in range(12)] + [(50, "hot"), (51, "hot hot"), (60, "cold")]
    df = spark.createDataFrame(data, "id bigint, t string")
    classes, copies, near = jaccard.similar_texts(df, "id", "t", 0.3, 1, hot=2)
    got = {tuple(r) for r in jaccard.member_pairs(copies, near, "id", "a", "b").collect()}
    assert got == {(a, b) for a, b in itertools.combinations([i for i, _ in data if i < 60], 2)}


def test_full_sketch():
    """A sketch whose counters are all high makes as many entries as an empty one, and templates stay few too."""
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 1 << 63, 420).astype(np.uint64))[:400]
    at, size = np.array([0, 400]), 1 << 12
    base = np.rint(np.log2(1 + rng.poisson(70_000, size)) * jaccard.STEPS).astype(np.uint16)
    plain = jaccard.entries(h, at, np.full(size, 2 * int(jaccard.STEPS), np.uint16), jaccard.hot_level(np.full(size, 512, np.uint16), 50_000), 0.6, 1)
    full = jaccard.entries(h, at, base, jaccard.hot_level(base, 50_000), 0.6, 1)
    assert len(full[0]) == len(plain[0]) == 161
    # a template: 55 % of the shingles stand in a million texts, the rest of the text is its own
    slots = (h[:220] & np.uint64(size - 1)).astype(np.int64)
    base[slots] = int(np.log2(1_070_000) * jaccard.STEPS)
    own = np.setdiff1d((h[220:] & np.uint64(size - 1)).astype(np.int64), slots)
    got = len(jaccard.entries(h, at, base, jaccard.hot_level(base, 50_000), 0.6, 1)[0])
    assert len(own) >= 161 and got <= 161


def stock_texts(phrases, per_text, count, seed=1):
    rng = random.Random(seed)
    stock = [" ".join(f"p{i}w{k}" for k in range(12)) for i in range(phrases)]
    return [(i, " ".join(rng.sample(stock, per_text))) for i in range(count)]


def test_texts_of_stock_phrases_enter_few_regions(spark):
    """All shingles but those between phrases are hot; with phrases as pivots a text has about as many entries as without
    hot ones, in place of one per pair of shingles."""
    data = stock_texts(25, 10, 400)
    df = spark.createDataFrame(data, "id bigint, t string")
    counted = jaccard._counts(df, "id", "t", 3, 1, 1 << 20).checkpoint()
    counts = jaccard._sketch(counted, 1 << 20)
    level = jaccard.hot_level(counts, 40)
    keys, reps = jaccard._phrases(df, "id", "t", 3, spark.sparkContext.broadcast(counts), level, 1.0)
    assert len(set(reps.tolist())) == 25 and len(keys) >= 250
    h, at = jaccard.shingles([t for _, t in data], 3)
    per_text = lambda phrases, level: len(jaccard.entries(h, at, counts, level, 0.6, 1, phrases)[0]) / len(data)
    cold, pairs_, few = per_text(None, 1e9), per_text(None, level), per_text((keys, reps), level)
    assert few <= cold < pairs_ / 5


def test_stock_phrases_lose_no_pair(spark):
    data = stock_texts(9, 5, 120)
    df = spark.createDataFrame(data, "id bigint, t string")
    own = dict(zip([i for i, _ in data], sets([t for _, t in data], 3)))
    want = {(a, b) for a, b in itertools.combinations(sorted(own), 2) if len(own[a] & own[b]) >= 0.6 * len(own[a] | own[b]) - 1e-9}
    for hot in (20, 60):
        classes, copies, near = jaccard.similar_texts(df, "id", "t", 0.6, 3, hot=hot)
        assert {tuple(r) for r in jaccard.member_pairs(copies, near, "id", "a", "b").collect()} == want


def test_sketches_are_added_as_a_tree(spark, monkeypatch):
    texts = [(i, f"a{i % 3} b{i % 5} c d e{i}") for i in range(300)]
    df = spark.createDataFrame(texts, "id bigint, t string").repartition(9)
    one = jaccard._sketch(jaccard._counts(df, "id", "t", 1, 1, 1 << 20).checkpoint(), 1 << 20)
    monkeypatch.setattr(jaccard, "FAN_IN", 2)
    assert (jaccard._sketch(jaccard._counts(df, "id", "t", 1, 1, 1 << 20).checkpoint(), 1 << 20) == one).all()
    h = jaccard.shingles(["c"], 1)[0][0]
    assert abs(2 ** (one[int(h) & ((1 << 20) - 1)] / jaccard.STEPS) - 301) < 2


def forest(nodes, edges):
    up, joined = {n: n for n in nodes}, 0

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        if top(a) != top(b):
            up[top(a)] = top(b)
            joined += 1
    return joined


def test_similar_texts_of_nothing(spark):
    classes, copies, near = jaccard.similar_texts(spark.createDataFrame([], "id bigint, t string"), "id", "t")
    assert classes.count() == copies.count() == near.count() == 0


# byte-pair encoding


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_like_the_library(reference):
    rng = random.Random(3)
    alphabet = "ab s't're've'll'd'm  \n\t\r　 é中文字12٣_-!?.'’😀İ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", "<|endoftext|>", "a" * 5000, " " * 999, "'" * 20, "x's", "don'tt"]
    ids, at = encode.Encoder(TOKENIZER).encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == reference.encode_ordinary(t), t


@settings(max_examples=150, deadline=None)
@given(st.lists(VARIED, min_size=1, max_size=4))
def test_encode_any_text(reference, texts):
    ids, at = encode.encoder(TOKENIZER).encode(texts)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [reference.encode_ordinary(t) for t in texts]


def test_encode_corpus_rows(spark, reference):
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (1, "one two"), (None, "x")], "doc_id bigint, text string").withColumn("ids", F.lit(0))
    got = [(r.doc_id, list(r.ids)) for r in encode.encode_corpus(df).collect()]
    two = reference.encode_ordinary("one two")
    assert sorted(got, key=str) == sorted([(1, two), (2, []), (3, []), (1, two), (None, reference.encode_ordinary("x"))], key=str)
    assert encode.encode_corpus(df.where("false")).count() == 0


def test_encoder_forgets(monkeypatch, reference):
    monkeypatch.setattr(encode, "REMEMBERED_WORDS", 3)
    own = encode.Encoder(TOKENIZER)
    for t in ("alpha beta gamma", "delta epsilon", "alpha zeta eta theta"):
        assert own.encode([t])[0].tolist() == reference.encode_ordinary(t)


# repeated lines


def test_repeated_lines(spark):
    notice, share = "All rights reserved by us!", "Share this page, please"
    data = []
    for i in range(8):
        data.append((i, i, f"Own line of number {'abcdefgh'[i]} here\n{notice.upper()}\r\n{share}\nshort"))
    data += [(20, 100, f"{notice}\n{share}"), (21, 50, None), (22, 51, ""), (23, None, notice), (24, 0, f"  all-rights, reserved by us?\n{share}")]
    df = spark.createDataFrame(data, "id bigint, document_id bigint, t string").withColumn("scope", F.lit("z")).withColumn("lines", F.lit(1))
    scopes = spark.createDataFrame([(i, "s") for i in range(8)] + [(50, "s"), (51, "s"), (100, None)], "document_id bigint, scope string")
    lines, blocks = repeated_lines.repeated_lines(df, scopes, "id", "document_id", "t", "scope", 6, 10)
    assert {(r.row_id, r.line_no) for r in lines.collect()} == {(i, n) for i in range(8) for n in (1, 2)} | {(24, 0), (24, 1)}
    assert [(r.n_lines, r.documents, r.n) for r in blocks.collect()] == [(2, 8, 9)]
    left = {r.id: r.t for r in repeated_lines.without_lines(df, lines, "id", "t").collect()}
    assert left[0] == "Own line of number a here\nshort" and left[24] == "" and left[21] is None and left[20] == f"{notice}\n{share}"


def test_hot_line_is_split(spark, monkeypatch):
    monkeypatch.setattr(repeated_lines, "BUCKET_ROWS", 3)
    df = spark.createDataFrame([(i, i % 9, "the same old notice\nand one more of them") for i in range(40)], "id bigint, d bigint, t string")
    scopes = spark.createDataFrame([(i, "s") for i in range(9)], "d bigint, scope string")
    lines, blocks = repeated_lines.repeated_lines(df, scopes, "id", "d", "t", "scope")
    assert lines.count() == 80 and [(r.n_lines, r.documents, r.n) for r in blocks.collect()] == [(2, 9, 40)]


def test_long_block(spark):
    notice = "\n".join(f"Clause {''.join(chr(97 + int(c)) for c in f'{i:03}')} of the notice" for i in range(100))
    df = spark.createDataFrame([(i, i, f"Own line of text {'abcdefg'[i]} here\n{notice}") for i in range(7)], "id bigint, d bigint, t string")
    scopes = spark.createDataFrame([(i, "s") for i in range(7)], "d bigint, s string")
    lines, blocks = repeated_lines.repeated_lines(df, scopes, "id", "d", "t", "s")
    assert lines.count() == 700
    assert [(r.n_lines, r.documents, r.n) for r in blocks.collect()] == [(100, 7, 7)]
    assert {r.line_no: r.n_lines for r in lines.where("row_id = 3").collect()} == {i: 101 - i for i in range(1, 101)}


@pytest.mark.parametrize(("depth", "bucket"), [(16, 20_000), (2, 20_000), (4, 5)])
def test_longest_blocks(spark, monkeypatch, depth, bucket):
    """Longest blocks and covered lines against all runs of all lengths."""
    monkeypatch.setattr(repeated_lines, "DEPTH", depth)
    monkeypatch.setattr(repeated_lines, "BUCKET_ROWS", bucket)
    rng = random.Random(11)
    name = lambda i: "line " + "".join(chr(97 + int(c)) for c in f"{i:04}") + " of many"
    notices = [[name(rng.randrange(30)) for _ in range(rng.randint(1, 9))] for _ in range(6)]
    texts = []
    for i in range(60):
        own = [name(1000 + i)]
        for _ in range(rng.randint(0, 4)):
            own += rng.choice(notices)[rng.randint(0, 2) :] + ([name(2000 + rng.randrange(200))] if rng.random() < 0.5 else [])
        texts.append((i, i % 23, own))
    df = spark.createDataFrame([(i, d, "\n".join(t)) for i, d, t in texts], "id bigint, d bigint, t string")
    scopes = spark.createDataFrame([(d, "s" if d % 5 else "z") for d in range(23)], "d bigint, s string")
    spans, places = {}, {}
    for i, d, t in texts:
        for a in range(len(t)):
            for b in range(a + 1, len(t) + 1):
                k = (d % 5 == 0, tuple(t[a:b]))
                spans.setdefault(k, set()).add(d)
                places[k] = places.get(k, 0) + 1
    longest = {}
    for i, d, t in texts:
        for a in range(len(t)):
            n = max((b - a for b in range(a + 1, len(t) + 1) if len(spans[d % 5 == 0, tuple(t[a:b])]) >= 3), default=0)
            if n:
                longest[i, a] = n
    lines, blocks = repeated_lines.repeated_lines(df, scopes, "id", "d", "t", "s", documents=3)
    assert {(r.row_id, r.line_no): r.n_lines for r in lines.collect()} == longest
    want = {(d % 5 == 0, tuple(t[a : a + longest[i, a]])) for i, d, t in texts for a in range(len(t)) if (i, a) in longest and longest.get((i, a - 1), 0) <= longest[i, a]}
    assert rows(blocks.select("n_lines", "documents", "n")) == sorted((len(k[1]), len(spans[k]), places[k]) for k in want)


def test_no_repeated_lines(spark):
    lines, blocks = repeated_lines.repeated_lines(spark.createDataFrame([], "id bigint, d bigint, t string"), spark.createDataFrame([], "d bigint, s string"), "id", "d", "t", "s")
    assert lines.count() == blocks.count() == 0


# splitting


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc  .\n!,中。，'\"é", max_size=400), st.integers(20, 90), st.integers(0, 15))
def test_split_round_trip(t, limit, overlap):
    parts = splitting.split(t, limit, overlap)
    whole = t.strip(splitting.BLANKS)
    assert all(len(p) <= limit for _, p in parts) and all(whole[b : b + len(p)] == p for b, p in parts)
    assert parts[0][1] + "".join(p[overlap:] for _, p in parts[1:]) == whole
    assert (len(parts) > 1) == (len(whole) > limit)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab e\u0301\u0302 。\n", min_size=60, max_size=400), st.integers(30, 60), st.integers(0, 12))
def test_pieces_begin_with_a_character(t, limit, overlap):
    whole = t.strip(splitting.BLANKS)
    longest = max((len(m) for m in re.findall("[\u0301\u0302]+", whole)), default=0)
    parts = splitting.split(t, limit, overlap)
    assert parts[0][1] + "".join(p[overlap:] for _, p in parts[1:]) == whole
    if longest <= 2:  # there is always a place for a cut
        assert not any(p[0] in "\u0301\u0302" for _, p in parts[1:])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc .\n中文字é🙂", max_size=300), st.integers(16, 60), st.integers(0, 15))
def test_split_keeps_the_token_limit(t, tokens, overlap):
    code = encode.encoder(TOKENIZER)
    parts = splitting.split(t, 90, overlap, tokens, code.counts)
    whole = t.strip(splitting.BLANKS)
    assert all(len(p) <= 90 for _, p in parts) and code.counts([p for _, p in parts]).max() <= tokens
    at = 0
    for begin, p in parts:  # nothing is lost, and no piece begins before the one before it
        assert begin <= at and whole[begin : begin + len(p)] == p
        at = begin + len(p)
    assert at == len(whole)


def test_split_prefers_strong_borders():
    t = "word " * 30 + "end.\n\n" + "word " * 30
    cut = splitting.split(t, 200, 0)[0][1]
    assert cut.endswith("\n\n")


def test_split_rows(spark):
    data = [(1, 10, 7, 2, "x" * 2000), (2, 10, 7, 1, None), (3, 10, 7, 3, " \n" * 900), (4, None, None, None, "One sentence. " * 100)]
    df = spark.createDataFrame(data, "id bigint, d bigint, p bigint, no int, t string").withColumn("begin", F.lit(1))
    pieces = splitting.split_oversized(df, "id", "t", "d", "no", "p").collect()
    assert {r.id for r in pieces} == {1, 4} and all(r.char_count <= 800 for r in pieces)
    numbers = splitting.renumbered(df, splitting.split_oversized(df, "id", "t", "d", "no", "p"), "id", "d", "no")
    code = encode.encoder(TOKENIZER)
    assert all(r.token_count == code.counts([r.piece_text])[0] for r in pieces)
    few = splitting.split_oversized(df, "id", "t", "d", "no", "p", 800, 10, tokens=50).collect()
    assert {r.id for r in few} == {1, 4} and all(r.token_count <= 50 for r in few)
    assert [(r.id, r.piece_no) for r in numbers.where("id <> 4").orderBy("new_number").collect()] == [(2, None), (1, 0), (1, 1), (1, 2), (3, None)]


# conversations


def test_resolve_threads(spark):
    chain = [(i, i - 1 if i else None) for i in range(100)]
    data = chain + [(200, 0), (300, 999), (301, 300), (400, 401), (401, 402), (402, 400), (403, 400), (500, 500)]
    got = {r.id: (r.root, r.depth, r.state) for r in threads.resolve_threads(spark.createDataFrame(data, "id bigint, parent bigint"), "id", "parent").collect()}
    assert got[99] == (0, 99, "ok") and got[200] == (0, 1, "ok")
    assert got[300] == (999, 1, "orphan") and got[301] == (999, 2, "orphan")
    assert all(got[i] == (None, None, "cycle") for i in (400, 401, 402, 403, 500))
    assert threads.resolve_threads(spark.createDataFrame([], "id bigint, parent bigint"), "id", "parent").count() == 0


def test_resolve_random_forests(spark):
    rng = random.Random(8)
    data, step = {}, {}
    for i in range(400):
        data[i] = None if i % 60 == 0 else i - 1 if i % 3 else rng.randrange(i)  # long chains with branches
        step[i] = rng.randint(1, 9)
    data |= {1000 + i: 1000 + (i + 1) % 37 for i in range(37)} | {2000: 1003, 2001: 2000, 3000: 9999, 3001: 3000}
    df = spark.createDataFrame([(i, p, step.get(i, 1)) for i, p in data.items()], "id bigint, parent bigint, step int").withColumn("root", F.lit(1)).withColumn("depth", F.lit(1))

    def way(i):
        out = [i]
        while data[out[-1]] is not None and data[out[-1]] in data and len(out) < 999:
            out.append(data[out[-1]])
        return out if len(out) < 999 else None

    got = {r.id: (r.root, r.depth, r.state) for r in threads.resolve_threads(df, "id", "parent", "step").collect()}
    for i in data:
        w = way(i)
        if w is None:
            assert got[i] == (None, None, "cycle")
        else:
            top = data[w[-1]]
            steps = sum(step.get(x, 1) for x in (w if top is not None else w[:-1]))
            assert got[i] == ((w[-1], steps, "ok") if top is None else (top, steps, "orphan"))
    ways = {}
    for r in threads.root_paths(df, "id", "parent").collect():
        ways.setdefault(r.leaf, {})[r.depth] = r.id
    leaves = {i for i in data if i not in set(data.values()) and way(i)}
    assert set(ways) == leaves
    for leaf, own in ways.items():
        w = way(leaf)[::-1]
        assert own == {d + (data[w[0]] is not None): i for d, i in enumerate(w)}
    assert threads.root_paths(df.where("false"), "id", "parent").count() == 0


def test_conversations(spark):
    from datetime import datetime

    t = lambda n: datetime(2024, 1, 1, 0, n)
    data = [
        ("A", t(1), 1, "q", "a"), (" a ", t(2), 2, "q", None), ("a", t(2), 3, None, "a"),  # whole, over several rows
        ("b", t(1), 4, "q", None),  # no reply
        ("c", t(1), 5, "null", "..."),  # nothing said
        ("d", t(1), 6, "q", "a"), ("d", None, 7, "q", "a"),  # a row without a time
        ("e", t(1), 8, None, "a"), ("e", t(2), 9, "q", "a"),  # begins with the assistant
        ("f", None, 10, None, None),
    ] + [("long", t(i % 50), 1000 + i, "q", "a") for i in range(300)]
    e = spark.createDataFrame(data, "code string, time timestamp, id bigint, p string, r string").withColumn("conversation", F.lit(1))
    d = spark.createDataFrame([(x,) for x in ["A", "b", "c", "d", "e", "f", "none", "LONG", None]], "code string")
    kept, gone = threads.rebuilt(d, e, "code", "p", "r", "time")
    assert sorted(r[0] for r in gone.collect()) == ["b", "c", "d", "e", "f", "none"]
    out = kept.orderBy("dialogue_code", "depth").collect()
    assert [(r.depth, r.role, r.exchange_id) for r in out if r.dialogue_code == "A"] == [(0, "user", 1), (1, "assistant", 1), (2, "user", 2), (3, "assistant", 3)]
    long = [r for r in out if r.dialogue_code == "LONG"]
    assert [r.depth for r in long] == list(range(600)) and [(r.time, r.exchange_id) for r in long] == sorted((r.time, r.exchange_id) for r in long)
    kept, gone = threads.rebuilt(d, e.where("false"), "code", "p", "r", "time")
    assert kept.count() == 0 and gone.count() == 8


# vectors


def test_similar_vectors_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RESIDENTS", 100)
    monkeypatch.setattr(neighbours, "ASKING", 150)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))).astype(np.float32)
    x[50:60] = x[50]
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [1.0] * 3), (2003, [float("nan")] * 16), (2004, [float("inf")] + [0.0] * 15), (None, [1.0] * 16)]
    got = neighbours.similar_vectors(spark.createDataFrame(data, "id bigint, e array<float>").withColumn("v", F.lit(1)), "id", "e", k=5, width=16)
    found = {(r.id, r.other) for r in got.collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(900) for j in sorted(range(900), key=lambda j: (-s[i, j], j))[:5]}
    assert len(found & want) >= 0.9 * len(want) and len(found) == 4500
    assert {o for i, o in found if i == 59} == {50, 51, 52, 53, 54}
    assert {o for i, o in found if i == 52} == {50, 51, 53, 54, 55}


def test_second_level_cells():
    """More cells than sampled classes can train: cells are sums of two centroids, and the nearest are asked."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(640, 16))
    ix = neighbours.Index(x, 400, residents=50)
    assert len(ix.coarse) == 40 and len(ix.second) == 10 and np.bincount(ix.group[ix.cell_of(u := neighbours.unit(x), neighbours.nearest(u, ix.coarse)) // 10]).max() <= 80
    cells, centres = ix.asked(u, 60), ix.centre(np.arange(400))
    want = np.argsort(-(u @ centres.T - (centres**2).sum(axis=1) / 2), axis=1)[:, :60]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(cells.tolist(), want.tolist())]) > 50


def test_distance_tables_sum_to_products():
    rng = np.random.default_rng(6)
    ix = neighbours.Index(rng.normal(size=(600, 16)), 8)
    u = neighbours.unit(rng.normal(size=(50, 16)))
    cell = ix.cell_of(u, neighbours.nearest(u, ix.coarse))
    code = ix.encode(u, cell)
    tables = ix.tables(u[:7])
    summed = sum(t[code[:, s]] for s, t in enumerate(tables)).T + u[:7] @ ix.centre(cell).T
    assert np.allclose(summed, u[:7] @ (ix.centre(cell) + ix.decoded(code)).T, atol=1e-5)


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None)], "id bigint, e array<float>")
    assert {(r.id, r.other) for r in neighbours.similar_vectors(df, "id", "e", width=2).collect()} == {(1, 2), (2, 1)}
    assert neighbours.similar_vectors(df.where("id = 3"), "id", "e", width=2).count() == 0


# percentiles


def test_percentile_error_and_merge(spark):
    rng = random.Random(1)
    values = [round(rng.lognormvariate(5, 2) * rng.choice([1, 1, 1, -1]), 3) for _ in range(3000)] + [0] * 50
    df = spark.createDataFrame([(i % 3, i % 7, float(v)) for i, v in enumerate(values)] + [(0, 0, None), (0, 0, float("nan"))], "g int, day int, x double")
    days = quantiles.sketch(df, ["g", "day"], "x")
    points = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    for r in quantiles.percentiles(quantiles.merge(days, ["g"]), ["g"], points).collect():
        own = sorted(v for i, v in enumerate(values) if i % 3 == r.g)
        true = own[max(math.ceil(round(r.point * len(own), 6)), 1) - 1]
        assert r.n == len(own) and abs(r.value - true) <= quantiles.ERROR * abs(true) + 1e-9
    assert quantiles.percentiles(quantiles.sketch(df.where("false"), ["g"], "x"), ["g"], points).count() == 0


def test_every_double_has_its_bucket(spark):
    values = [5e-324, -5e-324, 1e-300, 3e-10, -1e-9, 1.0, 1e300, 1.7e308, -1.7e308, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(90, float("inf")), (91, float("-inf")), (92, None)], "g int, x double")
    got = {r.g: r.value for r in quantiles.percentiles(quantiles.sketch(df, ["g"], "x"), ["g"], [0.5]).collect()}
    assert set(got) == set(range(len(values)))
    assert all(abs(got[i] - v) <= quantiles.ERROR * abs(v) * 1.0001 + 5e-324 for i, v in enumerate(values))


def test_shortened_like_all_pairs(spark):
    rng = random.Random(12)
    for parts in (1, 5):
        texts = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))), rng.random() < 0.4) for i in range(150)] + [(1000 + i, "abab", True) for i in range(60)]
        df = spark.createDataFrame(texts, "k bigint, t string, w boolean").repartition(parts)
        want = {k for k, t, _ in texts if any(w and u != t and u.startswith(t) for _, u, w in texts)}
        assert {r.id for r in pairs.shortened(df, "k", "t", "w").collect()} == want
        want = {k for k, t, _ in texts if any(u != t and u.startswith(t) for _, u, _ in texts)}
        assert {r.id for r in pairs.shortened(df, "k", "t").collect()} == want


def test_sources_that_say_nothing_are_refusals():
    for reply in [
        "Nothing in the indexed files covers the price list; I would only be guessing.", "I'd rather not comment on the tax code. Please contact an auditor.", "Hello! No document mentions that. Feel free to ask something else.",
        "知识库里查不到价格目录，没有办法作答。您可以换一个问题。", "Über Gartabo liegen mir keine Angaben vor.", "Guten Tag, Die Unterlagen dazu reichen für eine Antwort nicht aus.", "Ese tema queda fuera de lo que puedo tratar; consulte con la guardia.", "Los documentos no mencionan el registro central, así que no hay respuesta.",
    ]:
        for spoken in (None, pairs.language(reply)):
            assert pairs.is_refusal("What about the price list?", reply, spoken), reply
    for reply in ["I can't see your price list from here, but the rule is clear. It applies from May.", "Eine Kopie kann ich nicht beilegen, die Regel lautet aber so. Sie gilt ab Mai.", "系统不能直接修改历史数据，不过处理方法如下。路由配置应排除保存期限表。", "No invoice is sent before the audit ends. The auditor signs it."]:
        assert not pairs.is_refusal("What about the price list?", reply, pairs.language(reply)), reply


# broken pairs


def test_defects(spark):
    end = [("Which team owns it?", f"The team number {w} owns the quality gate here today.") for w in ("one", "two", "three")]
    data = [
        (1, "What is it?", "  "), (2, "What is it?", "(no content)"), (3, "How does the gate work?", "You asked: how does the gate work"),
        (4, "How does the gate work?", "I'm sorry, but I can't help with that. Feel free to ask something else."), (5, "How does the gate work?", "I can't see your gate from here, but the rule is clear. The gate closes at noon every day."),
        (6, "How does the gate work in the office?", "Falls die offene Rechnung fehlt, muss die Verwaltung den Auftrag teilen."), (7, "Explain the gate. Please answer in German.", "Falls die offene Rechnung fehlt, muss die Verwaltung den Auftrag teilen."),
        (8, "Which team owns it?", "The team number one owns the quality gate here today. It is the"), (9, "How long?", "24 hours"), (10, "null", "x"), (11, None, "x"), (12, "Is it so?", "Yes."), (13, "Which team owns it?", "Do this:\n```\nopen("),
        (14, "Steps?", "Do this.\n1. Open the quality gate here today\n2. Close the quality gate here today"), (15, "What is it?", None),
    ] + [(100 + i, q, a) for i, (q, a) in enumerate(end)]
    df = spark.createDataFrame(data, "id bigint, p string, r string").withColumn("prompt", F.lit(1)).withColumn("defect", F.lit(""))
    assert dict(rows(pairs.defective_pairs(df, "id", "p", "r"))) == {1: "empty", 2: "empty", 15: "empty", 3: "copy", 4: "refusal", 6: "language", 8: "truncated", 13: "truncated"}
    assert pairs.defective_pairs(df.where("false"), "id", "p", "r").count() == 0


def test_cut_after_a_sentence(spark):
    """The beginning of a complete answer to the same prompt, and a length limit, decide for complete endings too."""
    ask, two = "How do I replace the fuse in the panel?", "Open the panel with the key first. Then take the old fuse out."
    data = [(1, ask, two), (2, ask, f"{two} Put the new one in at the end."), (3, "What comes before the test?", two), (4, ask, f"{two} Put the"), (5, "Which panel is it?", "That one.")]
    # 12 replies stop open at 90 characters and 9 with a full stop; others end where they like
    cut = lambda i, n, end: f"The item {'abcdefghijklmnopqrstuvwxyz'[i]} of the list is kept in the store behind the office on the left side of the long corridor"[: n - len(end)] + end
    data += [(10 + i, f"Where is item {i} kept?", cut(i, 90, "")) for i in range(12)] + [(30 + i, f"Where was item {i} kept?", cut(i, 90, ".")) for i in range(9)] + [(50 + i, f"Where will item {i} be?", cut(i, 60 + 3 * i, ".")) for i in range(9)]
    found = dict(rows(pairs.defective_pairs(spark.createDataFrame(data, "id bigint, p string, r string"), "id", "p", "r")))
    assert found == dict.fromkeys([1, 4, *range(10, 22), *range(30, 39)], "truncated")


def test_long_refusals():
    assert pairs.is_refusal("门禁怎么工作？", "抱歉，我无法回答这个问题。" * 12)
    asked = "How does the gate of the office work when " + "the list of visitors is long and " * 30 + "the porter is away?"
    assert pairs.is_refusal(asked, f"You asked:\n{asked}\nI'm sorry, but I can't help with that.")
    assert not pairs.is_refusal("How does it work?", "I can't help with that. " * 25 + "The gate closes at noon every day.")


@pytest.mark.parametrize("times", [1, 40])
def test_sentence_ends_at_any_size(spark, times):
    """A cut after a common word that now and then ends a sentence is found in a small table and in a large one."""
    data = [(f"The team of floor {i} checks the list of the old gate and of the new gate of the yard today.", "en") for i in range(60 * times)]
    data += [("This is what the yard consists of.", "en")] * times + [("El registro es original.", "es")] * (5 * times) + [("The original list is the original one.", "en")] * (5 * times)
    asked = spark.createDataFrame([(w,) for w in ("today", "one", "original", "of", "of", None, "unseen")], "last string")
    ends = {tuple(r) for r in pairs.sentence_ends(spark.createDataFrame(data, "t string, l string"), "t", "l", asked).collect()}
    assert not any(w in ("gate", "team", "yard") for _, w in ends)
    assert {("en", "today"), ("en", "one"), ("es", "original"), ("", "original")} <= ends and not ends & {("en", "of"), ("", "of"), ("en", "original")}


def test_cut_item_after_a_common_word(spark):
    data = [(i, f"What does team {i} check?", f"The team of floor {i} checks the list of the old gate and of the new gate of the yard today.") for i in range(300)]
    data += [(1000 + i, f"What is in the yard {i}?", "This is what the yard consists of.") for i in range(2)]
    data += [(2000, "Which steps are there?", "Do this.\n1. Open the gate of the yard today\n2. Close the list of"), (2001, "Which steps are left?", "Do this.\n1. Close the list of\n2. Open the gate of the yard today")]
    assert rows(pairs.defective_pairs(spark.createDataFrame(data, "id bigint, p string, r string"), "id", "p", "r")) == [(2000, "truncated")]


def test_shortened_of_whole_texts(spark):
    data = [(1, "a", True), (2, "ab", False), (3, "abc", True), (4, "abd", False), (5, "abde", False), (6, "b", True), (7, "abc", True)]
    for parts in (1, 4):
        df = spark.createDataFrame(data, "k bigint, t string, w boolean").repartition(parts)
        assert {r.id for r in pairs.shortened(df, "k", "t", "w").collect()} == {1, 2}


@pytest.mark.parametrize("parts", [1, 4])
def test_shortened(spark, parts):
    texts = ["a", "ab", "abc", "b", "bc x", "bc", "c", "", "c", None, "d e f", "d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string").repartition(parts)
    known = [t for t in texts if t is not None]
    want = {i for i, t in enumerate(texts) if t is not None and any(o != t and o.startswith(t) for o in known)}
    assert {r.id for r in pairs.shortened(df, "k", "t").collect()} == want


# mixtures


def test_permutation_is_one():
    for n in (1, 2, 3, 5, 16, 17, 1000):
        for key in (0, 7):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key)).tolist()) == list(range(n))


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["Big", "big ", "BIG", "mid"]) if i > 20 else "small", " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 400)))) for i in range(400)]
    docs += [(900, "big", None), (901, "big", ""), (902, None, "alpha"), (903, "other", "alpha")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("slot", F.lit(1)).withColumn("part", F.lit(2)).repartition(3)
    plans = spark.createDataFrame([("p", "big", 3.0, 1), ("p", "mid", 2.0, 2), ("p", "small", 1.0, 4), ("p", "absent", 1.0, 9), ("q", "absent", 1.0, 1), (None, "big", 1.0, 1)], "plan_code string, source string, target_share double, max_repeat int")
    mixed, shares = mixing.mix(df, plans, "doc_id", "source", "text", block=64, shards=8)
    limit = {"big": 1, "mid": 2, "small": 4}
    uses, slots = {}, {}
    for r in mixed.collect():
        assert r.plan_code == "p" and r.doc < 900 and r.to_token > r.from_token
        slots.setdefault((r.source, r.slot), 0)
        slots[r.source, r.slot] += r.to_token - r.from_token
        for k in range(r.from_token, r.to_token):
            uses[r.doc, k] = uses.get((r.doc, k), 0) + 1
    assert all(n <= 64 for n in slots.values())
    source = {i: s.strip().lower() for i, s, _ in docs if s}
    assert all(n <= limit[source[d]] for (d, _), n in uses.items())
    got = {(r.plan_code, r.source): r for r in shares.collect()}
    assert got["p", "absent"].tokens == got["q", "absent"].tokens == 0
    for s, want in (("big", 1 / 2), ("mid", 1 / 3), ("small", 1 / 6)):
        assert abs(got["p", s].actual_share - want) < 0.02
    again = mixing.mix(df.repartition(7, "text"), plans, "doc_id", "source", "text", block=64, shards=8)[0]
    assert rows(again) == rows(mixed)  # however the table is stored
    assert mixing.mix(df.where("false"), plans, "doc_id", "source", "text")[0].count() == 0


# spam pages


def test_spam_pages(spark):
    prose = "The finance partner should check the second page before noon. Nobody owned the shared folder, so an auditor had to repeat the upload. "
    tags = " ".join(f"#{w}" for w in ["cheap", "buy", "online", "best"] * 12)
    links = "\n".join(f"Printer {w} - www.{w}.example" for w in ["abc", "def", "ghi", "jkl"] * 5)
    stuffed = "badge printer " * 60
    shop = "\n".join(f"AB-{i} | badge printer | white | {i}.99" for i in range(100, 120))
    menu = "\n".join(f"Home > Badge printer > {w} > {w}x" for w in ["Best", "Free", "New", "Top"] * 5)
    data = [(1, prose * 3), (2, tags), (3, links), (4, stuffed), (5, shop), (6, menu), (7, prose + "\n" + stuffed), (8, prose * 3 + "\nTags: a, b, c\nwww.one.example"), (9, None), (10, ""), (11, "…"), (12, "c​h​e​a​p token " * 40), (13, prose * 300), (None, tags)]
    data += [(14, "因为多个办公室共用账户，所以共享邮箱会覆盖月度台账。档案专员可以提交更正说明。" * 3), (15, "文档解析工具免费，报销软件排行榜，大模型培训推荐，" * 12)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("links", F.lit(1))
    got = {r.doc_id: r.is_spam for r in spam_pages.label_pages(df).collect()}
    assert {k for k, v in got.items() if v} == {None, 2, 3, 4, 5, 6, 7, 12, 15}
    assert spam_pages.label_pages(df.where("false")).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    counts = np.array([3, 1, 4])
    symbols, words = rng.integers(0, 10, 8), rng.integers(0, 40, 8).astype(float)
    got = spam_pages.viterbi(symbols, words, counts)
    logs, steps, weight = np.log(spam_pages.EMISSION), np.log(spam_pages.TRANSITION), 1 + np.log2(1 + words / 12)
    at = 0
    for c in counts:
        def score(path, at=at, c=c):
            s = np.log(spam_pages.START[path[0]]) + sum(weight[at + i] * logs[path[i], symbols[at + i]] for i in range(c))
            return s + sum(steps[path[i], path[i + 1]] for i in range(c - 1))

        best = max(itertools.product(range(4), repeat=int(c)), key=score)
        assert abs(score(best) - score(tuple(got[at : at + c]))) < 1e-9
        at += c


def test_expected_states_are_sums_over_paths():
    rng = np.random.default_rng(5)
    counts = np.array([3, 0, 1, 4])
    symbols, words = rng.integers(0, 10, 8), rng.integers(0, 40, 8).astype(float)
    state, steps = spam_pages.expected(symbols, words, counts, spam_pages.Model())
    weight, at, own, all_steps = 1 + np.log2(1 + words / 12), 0, np.zeros((8, 4)), np.zeros((4, 4))
    for c in counts:
        total, sums, pairs_ = 0.0, np.zeros((c, 4)), np.zeros((4, 4))
        for path in itertools.product(range(4), repeat=int(c)) if c else []:
            p = spam_pages.START[path[0]] * np.prod([spam_pages.EMISSION[path[i], symbols[at + i]] ** weight[at + i] for i in range(c)]) * np.prod([spam_pages.TRANSITION[path[i], path[i + 1]] for i in range(c - 1)])
            total += p
            for i in range(c):
                sums[i, path[i]] += p
            for i in range(c - 1):
                pairs_[path[i], path[i + 1]] += p
        if c:
            own[at : at + c] = sums / total
            all_steps += pairs_ / total
        at += c
    assert np.allclose(state, own) and np.allclose(steps, all_steps)


def test_fitting_learns_the_symbols_of_a_state():
    rng = np.random.default_rng(7)
    tags = rng.choice([spam_pages.HASHTAGS, spam_pages.PLAIN], size=4000, p=[0.2, 0.8])
    tags[::5] = spam_pages.HASHTAGS
    model = spam_pages.fit(tags, np.full(4000, 5.0), np.full(400, 10), prior=50)
    assert model.emission[spam_pages.TAGS, spam_pages.PLAIN] > 1.5 * spam_pages.EMISSION[spam_pages.TAGS, spam_pages.PLAIN]
    assert all(np.allclose(x.sum(axis=-1), 1) for x in model)


# queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), connect(sf), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() >= 0
