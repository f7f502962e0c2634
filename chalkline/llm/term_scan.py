"""Ranked lexical search by scanning the documents with an automaton of all items' terms.

No document index is kept.  The items' terms, each between two boundary marks, become one
Aho-Corasick automaton that every task gets by broadcast; a document's text is read with
A-Z lowered and every byte outside terms turned into the boundary mark, so whatever the
automaton reports is a whole term, with its frequency in the text.  Two scans:

1. documents, their terms, and how many documents hold each of the items' terms;
2. frequencies become contributions, which go to the items that hold the term; a task
   keeps the ``k`` best documents of each item and passes only these on.

Items are taken in blocks of bounded size (``BLOCK``, or one item's terms where these are
more), so what is broadcast does not grow with the items; each block scans all documents.

Defined results: a null or empty text has no terms, neither as document nor as item; rows
with the same item id (null is one too) are one item with the terms of all; repeated
documents are documents of their own; equal scores go by ascending ``doc_id``, null last;
items without a match return no rows; an empty table gives no rows; very long texts are
scanned whole; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import LOWER, UPPER, arrow_rows, ascii_lower, written

K = 20
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Size of the terms that are scanned for at once: characters, plus these for a term and an item.
BLOCK, TERM_COST, ITEM_COST = 4_000_000, 16, 2000
#: Contributions to items that are spread out in memory at once.
AT_ONCE = 1_000_000
#: Groups in which an item's hits of all tasks are ranked before they meet.
SALTS = 64
DOCS, TERMS = -1, -2
SCALE, LENGTH_SHARE = 1_000_000_000, 25

MARK = 32
#: Bytes of UTF-8 text: A-Z to a-z, what is in no term to the boundary mark, all others as they are.
AS_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else MARK for b in range(256))


class TermScanner:
    """Counts the terms of one block in texts."""

    def __init__(self, terms: list[str]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(terms):
            self.automaton.add_word(f" {term.encode().decode('latin-1')} ", i)
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, dict[int, int]]:
        """How many terms the text has, and how often each term of the block occurs."""
        if not text:
            return 0, {}
        marked = b" " + text.encode().translate(AS_TERMS) + b" "
        inside = np.frombuffer(marked, np.uint8) != MARK
        n = int(np.count_nonzero(inside[1:] > inside[:-1]))
        return n, Counter(map(itemgetter(1), self.automaton.iter(marked.decode("latin-1")))) if n else {}


_scanners: dict[int, TermScanner] = {}


def scanner(terms: Broadcast) -> TermScanner:
    """The automaton of a broadcast block, built once per worker; only the latest is kept."""
    key = hash(tuple(terms.value[:1000])) ^ len(terms.value)
    found = _scanners.get(key)
    if found is None or found.terms is not terms.value:
        _scanners.clear()
        found = _scanners[key] = TermScanner(terms.value)
        found.terms = terms.value
    return found


def _counted(terms: Broadcast):
    """First scan: (term, n), the documents that hold each term, and totals under DOCS and TERMS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chalkline.llm.term_scan import scanner

        machine = scanner(terms)
        df: Counter[int] = Counter()
        docs = length = 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                n, found = machine.scan(text)
                docs += n > 0
                length += n
                df.update(found.keys())
        keys = [DOCS, TERMS, *df]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([docs, length, *df.values()], pa.int64())], names=["term", "n"])

    return run


class Best:
    """The ``k`` best documents of each item among those seen so far."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.least = np.ones(items, np.int64)  # what a document needs to come in
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """``scores[document, item]``; ids of the documents, and which of them are null."""
        doc, item = np.nonzero(scores >= self.least)
        if len(doc):
            self.parts.append((item, scores[doc, item], ids[doc], null[doc]))
            self.held += len(doc)
            if self.held > 4 * self.items * self.k + 100_000:
                self.trim()

    def trim(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        item, score, ids, null = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        first = np.concatenate(([0], np.flatnonzero(np.diff(item)) + 1))
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.concatenate((first, [len(item)]))))
        order, item, rank = order[rank < self.k], item[rank < self.k], rank[rank < self.k]
        last = rank == self.k - 1
        self.least[item[last]] = score[order[last]]
        self.parts = [(item, score[order], ids[order], null[order])]
        self.held = len(order)
        return self.parts[0]


def _ranked(terms: Broadcast, holders: Broadcast, docs: int, length: int, k: int):
    """Second scan: the best documents of each item in this task, as (item, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chalkline.llm.term_scan import Best, scanner

        machine = scanner(terms)
        weight, starts, item, repeats, items = holders.value
        best = Best(items, k)
        doc, term, part, at_hand = [], [], [], 0
        ids = null = None

        def settle() -> None:
            """Spread the contributions at hand over the items."""
            nonlocal at_hand
            if term:
                t, own = np.concatenate(term), np.unique(np.concatenate(doc), return_inverse=True)
                sizes = starts[t + 1] - starts[t]
                at = np.arange(int(sizes.sum())) + np.repeat(starts[t] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
                scores = np.zeros((len(own[0]), items), np.int64)
                np.add.at(scores.reshape(-1), np.repeat(own[1], sizes) * items + item[at], np.repeat(np.concatenate(part), sizes) * repeats[at])
                best.add(scores, ids[own[0]], null[own[0]])
            doc.clear(), term.clear(), part.clear()
            at_hand = 0

        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for i, text in enumerate(batch.column(1).to_pylist()):
                n, found = machine.scan(text)
                if found:
                    t = np.fromiter(found.keys(), np.int64, len(found))
                    tf = np.fromiter(found.values(), np.int64, len(found))
                    m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * docs // length
                    term.append(t)
                    part.append(weight[t] * (SCALE * tf // (1000 * tf + 12 * m)))
                    doc.append(np.full(len(t), i))
                    at_hand += int((starts[t + 1] - starts[t]).sum()) + items
                    if at_hand >= AT_ONCE:
                        settle()
            settle()
        own, score, ids, null = best.trim()
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(ids, pa.int64(), mask=null), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n) of ``items (item_id, text)``, repeats counted."""
    terms = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0))
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))


def blocks(terms: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(item_id, term, n)`` with a ``block``: none holds more than ``size`` and one item."""
    sizes = terms.groupBy("item_id").agg((F.sum(F.length("term") + TERM_COST) + ITEM_COST).alias("size"))
    groups = max(1, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // size))
    # running sums inside hash groups of about a block each, so no task sees all items
    w = Window.partitionBy("group").orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("group", F.pmod(F.xxhash64("item_id"), F.lit(groups)))
    sizes = sizes.withColumn("part", F.floor(F.coalesce(F.sum("size").over(w), F.lit(0)) / size))
    placed = sizes.select(F.col("item_id").alias("own"), F.concat_ws("-", "group", "part").alias("block"))
    return terms.join(placed, F.col("item_id").eqNullSafe(F.col("own"))).select("block", "item_id", "term", "n")


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best rows of ``docs (doc_id, text)`` for each of ``items (item_id, text)``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = written(blocks(written(item_terms(items), "item-terms"), block), "item-blocks")
    found = []
    for name in sorted(r.block for r in terms.select("block").distinct().collect()):
        rows = terms.where(F.col("block") == name).select("item_id", "term", "n").collect()  # of bounded size
        words = sorted({r.term for r in rows})
        of = {t: i for i, t in enumerate(words)}
        ids = sorted({r.item_id for r in rows}, key=lambda x: (x is None, x))
        place = {x: i for i, x in enumerate(ids)}
        held = sorted((of[r.term], place[r.item_id], r.n) for r in rows)
        term, item, repeats = (np.array(x, np.int64) for x in zip(*held, strict=True))
        starts = np.searchsorted(term, np.arange(len(words) + 1))
        sent = spark.sparkContext.broadcast(words)
        with arrow_rows(spark, 256):
            count = dict(map(tuple, texts.mapInArrow(_counted(sent), "term int, n bigint").groupBy("term").agg(F.sum("n")).collect()))
            total = count.get(DOCS, 0)
            if not total:
                continue
            weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * count.get(i, 0) + 1))) for i in range(len(words))], np.int64)
            holders = spark.sparkContext.broadcast((weight, starts, item, repeats, len(ids)))
            hits = texts.mapInArrow(_ranked(sent, holders, total, count[TERMS], k), "item int, doc_id bigint, score bigint")
            names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id bigint")
            found.append(written(hits.join(names, "item").select("item_id", "doc_id", "score"), "hits"))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    hits = reduce(DataFrame.unionByName, found).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*best))).where(F.col("rank") <= k)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = f"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
dn AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM dn),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
it AS (SELECT item_id, term, count(*) AS r FROM i GROUP BY ALL),
s AS (
  SELECT item_id, doc_id,
         sum(r * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // len))))::BIGINT AS score
  FROM it JOIN tf USING (term) JOIN df USING (term) JOIN dn USING (doc_id), g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {K}
"""
