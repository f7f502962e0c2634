"""A Katz backoff n-gram model over a corpus, and the score of every document under it.

Counts up to ``CUTOFF`` get Good-Turing discounts; larger ones a small absolute discount,
so that every context keeps mass to back off with.  The mass that a context's seen words
leave is spread over its unseen words in proportion to the next shorter context by an
exactly normalised backoff weight, down to single words; these leave their own discounted
mass to one unknown word.  A token's probability is evaluated recursively from the longest
context (``order - 1`` words, with start symbols before the text) to the first that has
seen it, every step taking the weight of the context it leaves.

The corpus is cut into chunks of documents inside the tasks that read it.  A chunk adds
up its own n-grams first and sends each distinct key once, packed and sorted, to the
table partition that owns the key's range; the partition adds the chunks up, stores its
slice of the order's count table, and answers each chunk with the totals in the order it asked.
So a word or word pair that makes up a third of the corpus is one entry per chunk, and
what is shuffled is distinct keys, not tokens.  The same exchange adds up the mass of
each context for the backoff weights.

Words are known by 64-bit hashes (two words of a corpus with V distinct ones share a hash
with probability about V^2 / 2^65).

Defined results: null and empty texts have the end token only; a null id counts as the
empty string for the train/held-out split; repeated rows are separate documents; an empty
table gives no rows; with no training tokens every score is that of the unknown word;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import LOWER, UPPER, arrow_rows, scratch, small_arrow_batches, written

#: Words of a context and the word after it.
ORDER = 2
CUTOFF = 5
#: Taken from counts above the cutoff.
TAIL = 0.1
CHUNK_TOKENS = 2_000_000
#: Tokens of the corpus per table partition.
PARTITION_TOKENS = 3_000_000
NO_ID = -(1 << 63)
MEMO_WORDS = 400_000

END = xxhash.xxh64_intdigest(b" ")
START = np.uint64(xxhash.xxh64_intdigest(b"  "))
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_memo: dict[bytes, int] = {}


# -- packed columns -------------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """Compressed bytes of an array; the bytes of equal rank stand together."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def slices(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, start, stop) of the non-empty key ranges of sorted ``keys``."""
    width = ((1 << 64) - 1) // parts
    part = np.minimum(keys // np.uint64(width), np.uint64(parts - 1)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        if b > a:
            yield int(part[a]), a, b


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    k = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
    k ^= k >> np.uint64(32)
    k *= np.uint64(0xD6E8FEB86659FD93)
    return k ^ (k >> np.uint64(32))


# -- chunks ---------------------------------------------------------------------------


def word_hashes(text: str | None) -> list[int]:
    words = (text or "").encode().translate(_TO_LOWER).split()
    out = list(map(_memo.get, words))
    if None in out:
        if len(_memo) > MEMO_WORDS:
            _memo.clear()
        for i, h in enumerate(out):
            if h is None:
                out[i] = _memo[words[i]] = xxhash.xxh64_intdigest(words[i])
    out.append(END)
    return out


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


CHUNKS = "chunk string, tokens bigint, ids binary, lengths binary, held binary, vocab binary, places binary"


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, n = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    held: list[bool] = []
    parts: list[np.ndarray] = []
    tokens = 0

    def chunk() -> pa.RecordBatch:
        vocab, at, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        rank = np.argsort(-counts, kind="stable")
        place = np.empty(len(vocab), np.uint32)
        place[rank] = np.arange(len(vocab), dtype=np.uint32)
        row = [
            [f"{task}-{n}"], [tokens], [pack(np.array(ids, np.int64))], [pack(np.array([len(p) for p in parts], np.uint32))],
            [pack(np.array(held, np.uint8))], [np.ascontiguousarray(vocab[rank]).tobytes()], [pack(place[at.reshape(-1)])],
        ]
        kinds = [pa.string(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(NO_ID if i is None else i)
            held.append(held_out(i))
            parts.append(np.array(word_hashes(text), np.uint64))
            tokens += len(parts[-1])
            if tokens >= CHUNK_TOKENS:
                yield chunk()
                n += 1
                ids, held, parts, tokens = [], [], [], 0
    if ids:
        yield chunk()
    _memo.clear()  # the worker goes on to other stages


class Chunk:
    """One chunk, unpacked: its documents and the places of its words."""

    def __init__(self, row: dict):
        self.name = row["chunk"]
        self.ids, self.lengths = unpack(row["ids"], np.int64), unpack(row["lengths"], np.uint32).astype(np.int64)
        self.held = unpack(row["held"], np.uint8).astype(bool)
        self.vocab = np.frombuffer(row["vocab"], np.uint64)
        self.place = unpack(row["places"], np.uint32)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lengths)
        self.train = ~self.held[self.doc]
        self.first = np.cumsum(self.lengths) - self.lengths  # of each document; every one has its end token at least

    def levels(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """(k, distinct k-grams, the place of every token's k-gram in them, the key of what stands before it) for k = 1 to ``order``.

        One order at a time, as each takes a few arrays of the chunk's length.
        """
        by_hash = np.argsort(self.vocab)
        rank = np.empty(len(by_hash), np.int32)
        rank[by_hash] = np.arange(len(by_hash), dtype=np.int32)
        yield 1, self.vocab[by_hash], rank[self.place], None
        gram = self.vocab[self.place]
        start = np.array([START])
        for k in range(2, order + 1):
            before = np.empty_like(gram)
            before[1:] = gram[:-1]
            before[self.first] = start[0]
            gram = pair_keys(before, self.vocab[self.place])
            start = pair_keys(start, np.array([START]))
            at = np.argsort(gram)
            keys = gram[at]
            new = np.append(True, keys[1:] != keys[:-1])
            of = np.empty(len(at), np.int32)
            of[at] = np.cumsum(new, dtype=np.int32) - 1
            del at
            yield k, keys[new], of, before


REQUESTS = "slot bigint, kind int, part int, chunk string, keys binary, counts binary"


def even_keys(spark, n: int) -> list[int]:
    """Numbers that Spark's hash deals to ``n`` partitions one each, so that no two slices meet in a task by chance."""
    found = spark.range(n * 16 + 64).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    by = {r["p"]: r["id"] for r in found}
    return [by.get(p, n * 16 + 64 + p) for p in range(n)]


def _requests(order: int, parts: list[int], slots: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                for k, keys, of, _ in c.levels(order):
                    counts = np.bincount(of[c.train], minlength=len(keys)).astype(np.uint32)
                    yield _batch([(slots[k][p], k, p, c.name, pack_keys(keys[a:b]), pack(counts[a:b])) for p, a, b in slices(keys, parts[k])], REQUESTS)

    return run


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


COUNTED = "role string, kind int, part int, chunk string, keys binary, counts binary, stats array<bigint>"


def _add_up(group: pa.Table) -> pa.Table:
    """One key range: the count table's slice, and for each chunk its totals (doubled, odd for the key's first chunk)."""
    rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
    kind, part = rows[0]["kind"], rows[0]["part"]
    asked = [unpack_keys(r["keys"]) for r in rows]
    sizes = [len(a) for a in asked]
    counts = np.concatenate([unpack(r["counts"], np.uint32) for r in rows])
    keys = np.concatenate(asked)
    del asked
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    totals = np.add.reduceat(counts[order], first, dtype=np.int64)
    del counts
    answer = np.empty(len(keys), np.uint64)
    del keys
    answer[order] = np.repeat((totals * 2).astype(np.uint64), np.diff(np.append(first, len(ordered))))
    answer[order[first]] += np.uint64(1)
    out, at = [], 0
    for r, n in zip(rows, sizes, strict=True):
        out.append(("answer", kind, part, r["chunk"], None, pack(answer[at : at + n]), None))
        at += n
    seen = totals > 0
    held = totals[seen]
    stats = [int(held.sum()), int(len(held)), *np.bincount(np.minimum(held, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2].tolist()]
    out.append(("table", kind, part, None, pack_keys(ordered[first][seen]), pack(held.astype(np.uint64)), stats))
    return pa.Table.from_batches([_batch(out, COUNTED)])


def discounts(of_counts: list[int]) -> np.ndarray:
    """Good-Turing factors for counts 0..CUTOFF from the numbers of n-grams seen 1..CUTOFF+1 times.

    Where these numbers give no factor inside (0, 1), half a count is taken instead.
    """
    out = np.ones(CUTOFF + 1)
    n = [0, *of_counts]
    common = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUTOFF + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Model:
    """The numbers that hold for the whole corpus; ``of_counts[k]``: how many k-grams were seen 1, 2, ... times."""

    def __init__(self, tokens: int, types: int, of_counts: dict[int, list[int]]):
        self.tokens, self.types, self.order = tokens, types, max(of_counts)
        self.factors = {k: discounts(n) for k, n in of_counts.items()}
        self.unknown = self._left_over(of_counts[1])

    def _left_over(self, of_one: list[int]) -> float:
        if not self.tokens:
            return 1.0
        low = sum(r * n * (1 - self.factors[1][r]) for r, n in enumerate(of_one[:CUTOFF], 1))
        return (low + TAIL * (self.types - sum(of_one[:CUTOFF]))) / self.tokens

    def discounted(self, counts: np.ndarray, k: int) -> np.ndarray:
        return np.where(counts > CUTOFF, counts - TAIL, counts * self.factors[k][np.minimum(counts, CUTOFF)])

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounted(counts, 1) / max(1, self.tokens), self.unknown)


PARTIAL = "role string, kind int, part int, chunk string, keys binary, seen binary, lower binary, needed binary, ids binary, held binary, lengths binary, known binary, base binary, score binary, waiting_doc binary, waiting_key binary"


def _evaluate(model: Model, parts: list[int]):
    """Scores of a chunk's documents up to the backoff weights, and the chunk's share of each context's mass."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        c = Chunk(next(r for r in rows if r["role"] == "chunk"))
        docs = len(c.ids)
        out = []

        def totals(k: int) -> tuple[np.ndarray, np.ndarray]:
            """How often each of the chunk's k-grams was seen in all, and whether the chunk is the first that has it."""
            mine = sorted((r for r in rows if r["kind"] == k), key=lambda r: r["part"])
            answer = np.concatenate([unpack(r["counts"], np.uint64) for r in mine])
            return (answer >> np.uint64(1)).astype(np.int64), (answer & np.uint64(1)).astype(bool)

        for k, keys, of, before in c.levels(model.order):
            count, own = totals(k)
            if k == 1:
                tokens = count[of]
                texts = count[np.searchsorted(keys, np.uint64(END))]  # training documents: each has one end
                lower = model.unigram(count)[of]  # per token, the probability one order down; right where that order has seen it
                log_found = np.log10(lower)
                base = np.bincount(c.doc, np.log10((tokens + 1) / (model.tokens + model.types + 1)), docs)
                known = np.bincount(c.doc, tokens > 0, docs).astype(np.int64)
                continue
            context = np.empty(len(c.doc), np.int64)  # how often what stands before the token is followed by anything
            context[1:] = tokens[:-1]
            context[c.first] = texts
            tokens = count[of]
            share = model.discounted(tokens, k) / np.maximum(context, 1)
            at = np.empty(len(count), np.int32)  # one token of each distinct k-gram
            at[of] = np.arange(len(tokens), dtype=np.int32)
            mine = at[own & (count > 0)]
            waiting = np.flatnonzero((tokens == 0) & (context > 0))
            del at, context
            need = np.unique(before[waiting])
            keys, place = np.unique(np.concatenate([before[mine], need]), return_inverse=True)
            place = place.reshape(-1)[: len(mine)]
            seen, below = np.bincount(place, share[mine], len(keys)), np.bincount(place, lower[mine], len(keys))
            del place, mine
            wanted = np.isin(keys, need).astype(np.uint8)
            if len(keys):
                out += [("context", k, p, c.name, pack_keys(keys[a:b]), pack(seen[a:b]), pack(below[a:b]), pack(wanted[a:b]), *[None] * 8) for p, a, b in slices(keys, parts[k - 1])]
            places = np.searchsorted(need, before[waiting]).astype(np.uint32)
            out.append(("waiting", k, 0, c.name, *[None] * 10, pack(c.doc[waiting].astype(np.uint32)), pack(places)))
            hit = tokens > 0
            log_found[hit] = np.log10(share[hit])
            lower = share
        score = np.bincount(c.doc, log_found, docs)
        out.append(("scores", 0, 0, c.name, *[None] * 4, pack(c.ids), pack(c.held.astype(np.uint8)), pack(c.lengths), pack(known), pack(base), pack(score), None, None))
        return pa.Table.from_batches([_batch(out, PARTIAL)])

    return run


WEIGHTS = "chunk string, kind int, part int, keys binary, alpha binary"


def _weigh(group: pa.Table) -> pa.Table:
    """One key range of contexts: log10 backoff weights for the chunks that wait for them."""
    rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
    asked = [unpack_keys(r["keys"]) for r in rows]
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    seen = np.bincount(place, np.concatenate([unpack(r["seen"], np.float64) for r in rows]), len(keys))
    lower = np.bincount(place, np.concatenate([unpack(r["lower"], np.float64) for r in rows]), len(keys))
    alpha = np.log10(np.maximum(1 - seen, 1e-300) / np.maximum(1 - lower, 1e-300))
    out, at = [], 0
    for r, a in zip(rows, asked, strict=True):
        mine = place[at : at + len(a)][unpack(r["needed"], np.uint8).astype(bool)]
        at += len(a)
        if len(mine):
            out.append((r["chunk"], r["kind"], r["part"], pack_keys(keys[mine]), pack(alpha[mine])))
    return pa.Table.from_batches([_batch(out, WEIGHTS)])


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _finish(train_tokens: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        s = next(r for r in rows if r["role"] == "scores")
        ids, held, lengths, known = unpack(s["ids"], np.int64), unpack(s["held"], np.uint8), unpack(s["lengths"], np.int64), unpack(s["known"], np.int64)
        base, score = unpack(s["base"], np.float64), unpack(s["score"], np.float64)
        for w in (r for r in rows if r["role"] == "waiting"):
            docs = unpack(w["waiting_doc"], np.uint32).astype(np.int64)
            if len(docs):
                answers = sorted((r for r in rows if r["alpha"] is not None and r["kind"] == w["kind"]), key=lambda r: r["part"])
                alpha = np.concatenate([unpack(r["alpha"], np.float64) for r in answers])
                score = score + np.bincount(docs, alpha[unpack(w["waiting_key"], np.uint32)], len(ids))
        return pa.table([
            pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(held.astype(bool)), pa.array(lengths), pa.array(known),
            pa.array(np.full(len(ids), train_tokens, np.int64)), pa.array(base), pa.array(score),
        ], names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``; contexts of ``order - 1`` words."""
    if order < 2:
        raise ValueError("a backoff model has order 2 at least")
    spark = docs.sparkSession
    small_arrow_batches(spark)
    chunks = written(docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_tokenize, CHUNKS), "chunks")
    tokens = chunks.agg(F.sum("tokens")).first()[0]
    if not tokens:
        return spark.createDataFrame([], SCORES)
    many = max(1, -(-tokens // PARTITION_TOKENS))
    parts = [0, max(1, many // 4), *[many] * (order - 1)]
    keys = even_keys(spark, sum(parts))
    slots = [keys[sum(parts[:k]) : sum(parts[: k + 1])] for k in range(order + 1)]
    path = scratch(spark, "ngrams")
    requests = chunks.mapInArrow(_requests(order, parts, slots), REQUESTS).repartition(sum(parts), "slot")
    with arrow_rows(spark, 1):  # a row is a whole chunk
        requests.groupBy("slot").applyInArrow(_add_up, COUNTED).write.partitionBy("role", "kind").parquet(path)
    counted = spark.read.schema(COUNTED).option("basePath", path).parquet(path)
    stats = {
        r["kind"]: r["s"]
        for r in counted.where("role = 'table'").groupBy("kind").agg(F.array(*(F.sum(F.col("stats")[i]) for i in range(CUTOFF + 3))).alias("s")).collect()
    }
    model = Model(stats[1][0], stats[1][1], {k: s[2:] for k, s in stats.items()})
    answers = counted.where("role = 'answer'").select("role", "kind", "part", "chunk", "counts")
    asked = chunks.select(F.lit("chunk").alias("role"), "*").unionByName(answers, allowMissingColumns=True)
    partial = written(asked.groupBy("chunk").applyInArrow(_evaluate(model, parts), PARTIAL), "partial")
    contexts = partial.where("role = 'context'").select("kind", "part", "chunk", "keys", "seen", "lower", "needed")
    # contexts of order k are dealt like the (k - 1)-grams they are, one range a task
    places = even_keys(spark, sum(parts[1:order]))
    before = F.lit([sum(parts[1 : k - 1]) for k in range(2, order + 1)])
    contexts = contexts.withColumn("slot", F.get(F.lit(places), F.get(before, F.col("kind") - 2) + F.col("part")))
    weights = written(contexts.repartition(len(places), "slot").groupBy("slot").applyInArrow(_weigh, WEIGHTS), "backoff")
    scores = partial.where("role <> 'context'").select("role", "kind", "chunk", "ids", "held", "lengths", "known", "base", "score", "waiting_doc", "waiting_key")
    return scores.unionByName(weights.select("chunk", "kind", "part", "alpha"), allowMissingColumns=True).groupBy("chunk").applyInArrow(_finish(model.tokens), SCORES)
