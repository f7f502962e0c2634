"""Ranked lexical search, chunked byte-level BPE and the prefix trie against plain versions, and odd input."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from chalkline.llm import chunk_bpe, prefix_trie, term_scan

# -- op11: ranked lexical search ------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, length = sum(n > 0 for _, _, n in counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted = defaultdict(Counter)
    for i, t in items:
        wanted[i].update(terms(t))
    out = []
    for item, asked in wanted.items():
        scored = []
        for i, c, n in counted:
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // length))) for t, r in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ODD_DOCS = [
    (1, "Alpha beta, BETA gamma! élan vital"), (2, "alpha-alpha alpha_alpha alphabet"), (3, None), (4, ""), (5, "... !!!"), (6, "beta " * 30_000 + "gamma"),
    (7, "Élan élan ÉLAN"), (7, "Élan élan ÉLAN"), (None, "alpha beta"), (9, "x\x7fbeta\x00gamma\u0085beta delta"), (10, "日本 beta 日本"), (11, "alpha beta"), (12, "alpha beta"),
]
ODD_ITEMS = [(1, "alpha BETA beta"), (2, "Élan 日本"), (3, None), (4, ""), (5, "nowhere"), (1, "gamma"), (None, "beta alphabet alpha"), (8, "beta"), (9, "delta  delta")]


@pytest.mark.parametrize("block", [term_scan.BLOCK, 2100])
def test_search_odd_input(spark, block):
    docs = spark.createDataFrame(ODD_DOCS, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("item_id", "score", "term", "rank", "n")}).repartition(5)
    items = spark.createDataFrame(ODD_ITEMS, "item_id bigint, text string").withColumns({c: F.lit(1) for c in ("doc_id", "size", "block", "term")})
    assert found(term_scan.search(docs, items, 4, block)) == plain_search(ODD_DOCS, ODD_ITEMS, 4)
    assert not term_scan.search(docs.limit(0), items).count() and not term_scan.search(docs, items.limit(0)).count()


def test_search_many_documents(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcÉ9", k=rng.randint(1, 3))) for _ in range(80)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(2000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(60)]
    got = found(term_scan.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7), spark.createDataFrame(items, "item_id bigint, text string"), 20, 40_000))
    assert got == plain_search(docs, items, 20)


def test_search_keeps_the_best_over_many_settlements(monkeypatch):
    import numpy as np

    best, rng = term_scan.Best(3, 5), np.random.default_rng(0)
    kept = []
    for b in range(40):
        scores = rng.integers(0, 50, (64, 3))
        best.add(scores, np.arange(64) + 64 * b, np.zeros(64, bool))
        kept += [(j, -int(scores[i, j]), i + 64 * b) for i in range(64) for j in range(3) if scores[i, j] > 0]
        best.trim()
    item, score, ids, _ = best.trim()
    assert list(zip(item.tolist(), (-score).tolist(), ids.tolist(), strict=True)) == [x for j in range(3) for x in sorted(y for y in kept if y[0] == j)[:5]]


# -- op12: chunked BPE ------------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(library, doc, text):
    ids = library.encode_ordinary(text or "")
    return (doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def encoded(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr)


def odd_texts():
    rng = random.Random(5)
    parts = ["it's", "'", "''s", "'ll've", " ", "  ", "\n\n", "\t", " ", "\u0085", "\x1c", "é", "日本語", "😀", "12345", "!!", "a" * 70, " " * 50, "Word", " the", "　", "<|endoftext|>", "'re'd", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 120))) for _ in range(150)]
    return [*texts, *texts[:3], "", None, "x" * 900, " " * 700, "!" * 500 + "a" * 500 + " " * 300 + "b", "ab " * 3000, "'s" * 400]


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 20), (64, 64), (chunk_bpe.CHUNK, chunk_bpe.OVERLAP)])
def test_chunks_give_the_library_encoding(spark, library, chunk, overlap):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("row", "k", "body", "ids", "piece", "start")}).repartition(4)
    assert encoded(chunk_bpe.encode_decode(docs, RANKS, PATTERN, chunk, overlap)) == sorted((digests(library, i, t) for i, t in rows), key=repr)
    assert not chunk_bpe.encode_decode(docs.limit(0), RANKS, PATTERN, chunk, overlap).count()


def test_whole_documents_in_chunks_give_the_library_encoding(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = sorted((digests(library, i, t) for i, t in rows), key=repr)
    assert encoded(chunk_bpe.encode_decode(docs, RANKS, PATTERN, 2000, 100)) == want
    assert encoded(chunk_bpe.encode_decode(docs, RANKS, PATTERN)) == want


def test_pieces_are_the_ids_in_order(spark, library):
    text = "Some words, and more of them. " * 400
    rows = chunk_bpe.pieces(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), RANKS, PATTERN, 1000, 100).orderBy("k").collect()
    assert len(rows) > 5 and [i for r in rows for i in r.ids] == library.encode_ordinary(text)


def test_long_pretokens_merge_like_short_ones():
    machine = chunk_bpe.ranked(RANKS, PATTERN)
    rng = random.Random(8)
    for n in (2, 30, 99, 100, 400):
        raw = "".join(rng.choices("abcdetion", k=n)).encode()
        assert machine._few(raw) == machine._many(raw)
    assert sum(len(machine.labels[i]) for i in machine.piece("tion" * 50_000)) == 200_000


# -- op13: prefix trie ------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (
            (
                convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), children[node], leaves[node], saved[node],
                hashlib.sha256(",".join(str(c) for c in convs if len(whole[c]) == len(node)).encode()).hexdigest(),
            )
            for node, convs in members.items()
        ),
        key=repr,
    )


def nodes(df):
    return sorted((tuple(r) for r in df.select(*prefix_trie.COLUMNS).collect()), key=repr)


def random_conversations(rng, convs, longest):
    rows = []
    for c in convs:
        kind = rng.random()
        for turn in range(0 if kind < 0.1 else rng.randint(1, longest)):
            text = None if rng.random() < 0.05 else "é" * rng.randint(0, 2) if kind < 0.8 else "same"
            rows.append((c, None if rng.random() < 0.03 else turn // 2 if rng.random() < 0.1 else turn, rng.choice(["user", "user", None]), text))
    return rows


@pytest.mark.parametrize("shard_turns", [15, 120, prefix_trie.SHARD_TURNS])
def test_trie_of_random_conversations(spark, shard_turns):
    rng = random.Random(shard_turns)
    rows = random_conversations(rng, rng.sample(range(400), 250), 12) + random_conversations(rng, range(400, 404), 90)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    assert nodes(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_ids(df)), shard_turns)) == plain_trie(rows)


def test_trie_of_equal_and_long_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 300) for t in range(4)] + [(1000, t, "user", f"turn {t}") for t in range(700)] + [(1005, t, "user", f"turn {t}") for t in range(690)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert nodes(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_ids(df)), 100)) == plain_trie(rows)


def test_trie_odd_input(spark):
    rows = [(None, 0, "user", "x"), (5, 1, None, None), (5, 1, None, None), (5, None, "a", "b" * 100_000), (5, 0, "", ""), (7, 3, "user", "only"), (6, 0, "x:1", "y"), (1000, 0, "x", ":1y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("x") for c in ("at", "id", "ids", "sizes", "path", "node", "head", "depth", "t")})
    assert nodes(prefix_trie.prefix_trie(df)) == plain_trie(rows)
    assert not prefix_trie.prefix_trie(df.limit(0)).count()
    only = df.where("conv_id = 7")
    assert nodes(prefix_trie.prefix_trie(only)) == plain_trie([(7, 3, "user", "only")])
