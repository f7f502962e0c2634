"""Exact top-k BM25 search with block-max pruning, per shard, merged by global statistics.

Documents become shards: packed inverted indexes built in the tasks that read them and
written as a table.  Inside a shard documents with the same common words stand together,
ordered by length, so that blocks of ``BLOCK`` documents are alike and their maxima tight.
Document frequencies, document count and mean length are summed over all shards, so every
shard scores with the same statistics and the merge is exact.

A task holds one shard at a time and streams the queries past it from the shared folder.
For every query on its own:

1. the short lists are added up, which gives each document a partial score;
2. block maxima of the long lists, times the query's weights, bound what these can add to
   any document of a block: the pivot test skips every block whose bound and greatest
   partial score together stay below the query's k-th score so far;
3. the long lists are scored in the blocks that are left, best first where no k-th score
   is known yet, in single precision;
4. documents that reach the k-th score within the rounding slack are scored exactly over
   all their terms, in one fixed term order.

Shards are met in rounds.  A query starts at a shard of its own (by its hash), then meets
``SPREAD`` times as many shards in every further round, each shard once; between rounds
its k-th score so far becomes the bound that it takes on.  So what all shards return for a
query grows with the logarithm of their number and not with their number.  Tasks are
(shard, group of queries); memory is one shard and one block of queries, whatever the input.

Scores are rounded to six decimals and ties go to the smaller doc_id; bounds are compared
with a margin, so pruning never changes a result.

Defined results: null and empty texts match nothing, and as queries return no rows; only
documents that share a term are returned, so a query may have fewer than k rows; null ids
are never queries and come back as null among results; repeated rows are separate
documents (repeated query ids count as one query, of the first text in order); an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import arrow_rows, scratch, written
from chalkline.llm.katz import NO_ID, pack, unpack, word_hashes

K = 10
K1 = 1.2
B = 0.75
BLOCK = 16
#: Lists that reach this share of a shard's documents (one in so many) are long.
LONG = 24
#: Relative error that single-precision sums stay well within.
SLACK = 1e-4
#: Scores are rounded to 1e-6; bounds get this margin.
MARGIN = 2e-6
#: A shard closes at so many tokens or documents, so texts of any length leave it of bounded size.
SHARD_TOKENS, SHARD_DOCS = 3_000_000, 65_536
QUERIES_AT_ONCE = 128
#: Queries in a folder of their own, which start at one shard; folders that one task streams past a shard at most.
SEED_QUERIES = 512
FOLDERS = 2000
#: How many times as many shards have been met after a round.
SPREAD = 8
#: Groups of documents in a shard, and common words that they are told apart by; both only order the documents.
CLUSTERS, CLUSTER_WORDS = 8, 1024

SHARDS = "shard string, docs bigint, tokens bigint, ids binary, lengths binary, vocab binary, starts binary, owners binary, tfs binary"


def _alike(words: np.ndarray, owner: np.ndarray, tf: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The documents of a shard with like ones side by side: clusters over their common words, then length."""
    n = len(lengths)
    long = np.argsort(-sizes, kind="stable")[:CLUSTER_WORDS]
    long = long[sizes[long] * LONG >= max(n, LONG)]
    if n <= BLOCK or not len(long):
        return np.argsort(lengths, kind="stable")
    column = np.full(len(sizes), -1)
    column[long] = np.arange(len(long))
    at = column[words] >= 0
    x = np.zeros((n, len(long)), np.float32)
    x[owner[at], column[words[at]]] = 1 + np.log(tf[at])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = x[np.random.default_rng(0).choice(n, CLUSTERS, replace=n < CLUSTERS)]
    for _ in range(8):
        near = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(CLUSTERS)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return np.lexsort((lengths, near))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    task, made = context.partitionId() if context else 0, 0
    ids: list[int] = []
    parts: list[np.ndarray] = []
    tokens = 0

    def shard() -> pa.RecordBatch:
        lengths = np.array([len(p) for p in parts], np.int64)
        count = len(parts)
        words = np.concatenate(parts)
        parts.clear()
        vocab, at = np.unique(words, return_inverse=True)
        del words
        keys = at.reshape(-1).astype(np.int64)
        del at
        keys *= count
        keys += np.repeat(np.arange(count), lengths)
        keys, tf = np.unique(keys, return_counts=True)
        term, owner = keys // count, keys % count
        del keys
        sizes = np.bincount(term, minlength=len(vocab))
        order = _alike(term, owner, tf, sizes, lengths)
        place = np.empty(count, np.int64)
        place[order] = np.arange(count)
        owner = place[owner]
        by = np.argsort(term * count + owner, kind="stable")
        row = [
            [f"{task}-{made}"], [count], [tokens], [pack(np.array(ids, np.int64)[order])], [pack(lengths[order])], [vocab.tobytes()],
            [pack(sizes.astype(np.uint32))], [pack(owner[by].astype(np.uint32))], [pack(tf[by].astype(np.uint32))],
        ]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in SHARDS.split(", ")])

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(NO_ID if i is None else i)
            parts.append(np.array(word_hashes(text)[:-1], np.uint64))
            tokens += len(parts[-1])
            if tokens >= SHARD_TOKENS or len(ids) >= SHARD_DOCS:
                yield shard()
                made += 1
                ids, parts, tokens = [], [], 0
    if ids:
        yield shard()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            vocab = np.frombuffer(row["vocab"], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(vocab), pa.array(unpack(row["starts"], np.uint32).astype(np.int64))], names=["term", "df"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            terms, n = np.unique(np.array(word_hashes(text)[:-1], np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(terms), i, np.int64)), pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=["query_id", "term", "n"]
            )


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions ``start .. start + size`` of every list, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)


class Shard:
    """One shard in memory: short lists, long lists as columns of impacts with block maxima, forward lists."""

    def __init__(self, row: dict, mean_length: float):
        self.ids = unpack(row["ids"], np.int64)
        n = self.n = len(self.ids)
        lengths = unpack(row["lengths"], np.int64)
        self.vocab = np.frombuffer(row["vocab"], np.uint64)
        sizes = self.sizes = unpack(row["starts"], np.uint32).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        self.owner = unpack(row["owners"], np.uint32).astype(np.int32)
        tf = unpack(row["tfs"], np.uint32).astype(np.float64)
        norm = K1 * (1 - B + B * lengths / max(mean_length, 1e-9))
        impact = tf * (K1 + 1) / (tf + norm[self.owner])
        self.impact = impact.astype(np.float32)  # bounds and candidates; exact scores use the forward lists
        term = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(self.owner, kind="stable")  # forward lists, terms ascending
        self.f_term, self.f_impact = term[order], impact[order]
        self.f_start = np.concatenate(([0], np.cumsum(np.bincount(self.owner, minlength=n))))
        long = np.flatnonzero(sizes * LONG >= max(n, LONG))
        self.column = np.full(len(sizes), -1)
        self.column[long] = np.arange(len(long))
        self.blocks = -(-n // BLOCK)
        self.dense = np.zeros((self.blocks * BLOCK, len(long)), np.float32)
        at = self.column[term] >= 0
        self.dense[self.owner[at], self.column[term[at]]] = impact[at]
        self.block_top = self.dense.reshape(self.blocks, BLOCK, -1).max(axis=1)
        self.weights = np.zeros(len(sizes))  # of the query at hand
        #: (query, block) pairs that were tested and that were scored
        self.tested = self.scored = 0

    def exact(self, docs: np.ndarray) -> np.ndarray:
        """Full scores of ``docs``; every document adds its terms in the same order."""
        sizes = self.f_start[docs + 1] - self.f_start[docs]
        at = _spread(self.f_start[docs], sizes)
        return np.round(np.bincount(np.repeat(np.arange(len(docs)), sizes), self.f_impact[at] * self.weights[self.f_term[at]], len(docs)), 6)

    def search(self, starts: np.ndarray, hashes: np.ndarray, weights: np.ndarray, low: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, scores, document places) of what may be among the ``k`` best of each query.

        Query q has the terms ``starts[q] .. starts[q + 1]``; ``low`` is a lower bound of its k-th score.
        """
        queries = len(starts) - 1
        if not len(self.vocab) or not queries:
            return
        of = np.repeat(np.arange(queries), np.diff(starts))
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        here = self.vocab[at] == hashes
        of, at, weights = of[here], at[here], weights[here]
        cuts = np.searchsorted(of, np.arange(queries + 1))
        column = self.column[at]
        long = column >= 0
        wide = np.zeros((queries, self.dense.shape[1]), np.float32)
        wide[of[long], column[long]] = weights[long]
        short, whose, weight = at[~long], of[~long], weights[~long]
        width = self.blocks * BLOCK
        sizes = self.sizes[short]
        postings = _spread(self.start[short], sizes)
        score = np.bincount(
            np.repeat(whose * width, sizes) + self.owner[postings], self.impact[postings] * np.repeat(weight, sizes), queries * width
        ).astype(np.float64, copy=False).reshape(queries, width)
        bound = (wide @ self.block_top.T) * (1 + SLACK) + score.reshape(queries, self.blocks, BLOCK).max(axis=2)
        done = np.zeros((queries, self.blocks), bool)
        low = low.copy()

        def add_up(need: np.ndarray) -> None:
            for b in np.flatnonzero(need.any(axis=0)).tolist():
                rows, docs = np.flatnonzero(need[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                score[rows, docs] += wide[rows] @ self.dense[docs].T
            done[need] = True

        blank = np.flatnonzero(low <= 0)
        if len(blank) and self.blocks * BLOCK > k:  # no k-th score yet: the blocks of the greatest bounds give one
            few = min(self.blocks, -(-2 * k // BLOCK) + 6)
            best = np.zeros_like(done)
            best[blank[:, None], np.argpartition(-bound[blank], few - 1, axis=1)[:, :few]] = True
            add_up(best & (bound > 0))
            for q in blank.tolist():
                own = score[q].reshape(self.blocks, BLOCK)[done[q]].ravel()
                if len(own) > k:
                    low[q] = max(0.0, float(np.partition(own, len(own) - k)[len(own) - k]) * (1 - 2 * SLACK))
        need = (bound >= low[:, None] - MARGIN) & (bound > 0)
        self.tested += need.size
        self.scored += int((need | done).sum())
        add_up(need & ~done)
        need |= done
        docs = np.repeat(need, BLOCK, axis=1)
        score[~docs] = 0
        docs &= (score > 0) & (score >= (low * (1 - 2 * SLACK) - MARGIN)[:, None])
        for q in np.flatnonzero(docs.any(axis=1)).tolist():
            hits = np.flatnonzero(docs[q])
            if len(hits) > k:
                own = score[q, hits]
                hits = hits[own >= np.partition(own, len(own) - k)[len(own) - k] * (1 - 2 * SLACK) - MARGIN]
            terms = at[cuts[q] : cuts[q + 1]]
            self.weights[terms] = weights[cuts[q] : cuts[q + 1]]
            values = self.exact(hits)
            self.weights[terms] = 0.0
            best = np.lexsort((self.ids[hits], -values))[:k]
            best = best[(values[best] > 0) & (values[best] >= low[q] * (1 - 2 * SLACK) - MARGIN)]
            if len(best):
                yield q, values[best], hits[best]


def _query_blocks(path: str, store: fs.FileSystem) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, starts, term hashes, weights, least scores) of ``QUERIES_AT_ONCE`` queries at a time."""
    held: list[pa.RecordBatch] = []

    def block() -> tuple:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        terms, weights = t.column("terms").combine_chunks(), t.column("weights").combine_chunks()
        starts = np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
        return t.column("query_id").to_numpy(), starts, terms.flatten().to_numpy().view(np.uint64), weights.flatten().to_numpy(), t.column("low").to_numpy()

    for batch in pads.dataset(path, filesystem=store, format="parquet").to_batches(batch_size=QUERIES_AT_ONCE, columns=["query_id", "terms", "weights", "low"]):
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= QUERIES_AT_ONCE:
            yield block()
    if held:
        yield block()


HITS = "query_id bigint, doc_id bigint, score double"


def _search(path: str, mean_length: float, k: int, slots: int, folders: int, low: int, high: int, groups: int):
    """Searches every shard that comes for the queries of the folders that start ``low`` to ``high - 1`` slots before it.

    Folder f starts at slot ``f * slots // folders`` and goes round; of several ``groups`` of folders the shard's is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                due = [f for f in range(row["part"], folders, groups) if low <= (row["slot"] - f * slots // folders) % slots < high]
                due = [at for at in (f"{base}/seed={f}" for f in due) if store.get_file_info(at).type == fs.FileType.Directory]
                if not due:
                    continue
                shard = Shard(row, mean_length)
                row.clear()
                for at in due:
                    for names, starts, hashes, weights, least in _query_blocks(at, store):
                        found = list(shard.search(starts, hashes, weights, least, k))
                        if found:
                            queries = np.repeat(names[[q for q, _, _ in found]], [len(v) for _, v, _ in found])
                            docs = shard.ids[np.concatenate([d for _, _, d in found])]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(queries), pa.array(docs), pa.array(np.concatenate([v for _, v, _ in found]))], names=["query_id", "doc_id", "score"]
                            )

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, doc_id, score: the ``k`` best rows of ``docs (doc_id, text)`` for each row of ``queries (doc_id, text)``."""
    spark = docs.sparkSession
    with arrow_rows(spark, 256):
        shards = written(docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_build, SHARDS), "shards")
        slots, count, tokens = shards.agg(F.count(F.lit(1)), F.sum("docs"), F.sum("tokens")).first()
        if not tokens:
            return spark.createDataFrame([], "query_id bigint, rank int, doc_id bigint, score double")
        mean = tokens / count
        asked = queries.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null")
        folders = max(1, -(-asked.count() // SEED_QUERIES))
        asked = asked.groupBy("doc_id").agg(F.min("text").alias("text"))
        terms = asked.mapInArrow(_terms, "query_id bigint, term bigint, n bigint")
        with arrow_rows(spark, 1):  # a row is a whole shard
            df = shards.select("vocab", "starts").mapInArrow(_frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
            df = written(df, "frequencies")
        weight = F.col("n") * F.log(1 + (F.lit(count) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = (
            terms.join(df, "term")
            .groupBy("query_id")
            .agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("t"))
            .select("query_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), F.pmod(F.xxhash64("query_id"), F.lit(folders)).alias("seed"))
        )
        asked = written(asked, "queries")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    groups = -(-folders // FOLDERS)
    found: list[DataFrame] = []
    met = 0
    while met < slots:
        low = F.lit(0.0)
        waiting = asked
        if found:
            last = reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") == k).select("query_id", "score")
            waiting, low = asked.join(last, "query_id", "left"), F.coalesce("score", F.lit(0.0))
        path = scratch(spark, "queries")
        waiting.select("query_id", "terms", "weights", low.alias("low"), "seed").write.partitionBy("seed").parquet(path)
        until = min(slots, max(1, met * SPREAD))
        with arrow_rows(spark, 1):
            each = [
                shards.withColumn("slot", F.pmod(F.xxhash64("shard"), F.lit(slots))).withColumn("part", F.lit(g))
                .mapInArrow(_search(path, mean, k, slots, folders, met, until, groups), HITS)
                for g in range(groups)
            ]
            found.append(written(reduce(DataFrame.unionByName, each), "hits"))
        met = until
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"
    )


SQL = f"""
WITH t AS (
  SELECT doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS n FROM t WHERE term <> '' GROUP BY ALL),
dl AS (SELECT doc_id, sum(n) AS len FROM tf GROUP BY ALL),
g AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(len) FROM dl) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
s AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(q.n * ln(1 + (docs - df + 0.5) / (df + 0.5)) * d.n * {K1 + 1} / (d.n + {K1} * ({1 - B} + {B} * len / mean))), 6) AS score
  FROM tf q JOIN tf d USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = d.doc_id, g
  WHERE q.doc_id % 50 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM s QUALIFY rank <= {K}
"""
