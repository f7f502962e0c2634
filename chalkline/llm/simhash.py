"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check.

1. Fingerprint: 64 bits, each the majority over the XXH64 hashes of a document's word
   shingles.  Equal fingerprints collapse to one representative before anything is paired.
2. Embedding: a fingerprint becomes 32 counts, one per two-bit segment.  The Manhattan
   distance of two embeddings never exceeds the Hamming distance of the fingerprints.
3. Grid range-join: two fingerprints within ``distance`` (4) bits have embeddings within
   distance 2 in at least one half (16 segments).  Each fingerprint enters, per half, its
   own grid cell and the cells one step away; two points within two steps share a cell.
4. Cell mates are verified exactly on the fingerprints inside the join condition.

A group of many near copies would pair quadratically.  Before the grid join, fingerprints
that agree outside one four-bit segment are merged (any such group has at most 16 members,
all linked with one another); the join then reports only links between different clusters.
The edges of both steps go through connected components.

Defined results: null and empty texts have fingerprint zero and link like any other; a
null id is never a component id (null if a component has no other); repeated rows give
repeated rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import LOWER, UPPER, ascii_lower, numbered, only_last, small_arrow_batches, written
from chalkline.llm.components import components

_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SLICE = 200_000
#: Stand-ins for representatives without any id start here; real ids are below.
_NO_ID = 1 << 62


def shingle_hashes(text: str | None, width: int = 4) -> np.ndarray:
    """Hashes of the word ``width``-shingles of ``text`` in order; one of the whole text where it is shorter."""
    words = (text or "").encode().translate(_TO_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = len(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLICE):
        bits = np.unpackbits(hashes[i : i + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of the word ``width``-shingles of ``text`` as an unsigned 64-bit integer."""
    hashes = shingle_hashes(text, width)
    return int(hashes[0]) if len(hashes) == 1 else majority(hashes)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long with the same bits."""
    small_arrow_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def _unsigned(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def embedding(fp: Column, half: int) -> Column:
    """Sixteen two-bit fields, each the number of ones in that segment of one half of ``fp``."""
    low = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return low - F.shiftrightunsigned(low, 1).bitwiseAND(F.lit(0x55555555).cast("long"))


def cells(fp: Column, half: int) -> Column:
    """The grid cells within one step of the point in one half, as longs tagged with the half."""
    point = embedding(fp, half)
    own = point + F.lit(half << 32).cast("long")
    around = [own]
    for i in range(16):
        field = F.shiftrightunsigned(point, 2 * i).bitwiseAND(F.lit(3).cast("long"))
        around += [F.when(field < 2, own + F.lit(1 << 2 * i)), F.when(field > 0, own - F.lit(1 << 2 * i))]
    return F.array(*around)


def _merge_close(reps: DataFrame) -> DataFrame:
    """Edges between fingerprints that differ inside one four-bit segment only (groups of 16 at most)."""
    keys = F.explode(
        F.array(*[
            F.struct(F.lit(i).alias("segment"), F.col("fp").bitwiseAND(_unsigned((0xF << 4 * i) ^ 0xFFFFFFFFFFFFFFFF)).alias("rest"))
            for i in range(16)
        ])
    )
    groups = (
        reps.select("node", keys.alias("key"))
        .groupBy("key")
        .agg(F.collect_list("node").alias("nodes"))
        .where(F.size("nodes") > 1)
        .select(F.array_min("nodes").alias("b"), F.explode("nodes").alias("a"))
    )
    return groups.where("a <> b").select("a", "b").distinct()


def links(reps: DataFrame, distance: int = 4) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all fingerprint pairs within ``distance`` bits.

    ``reps (fp, node)`` has distinct fingerprints.  The grid is laid out for distances up to 4.
    """
    if distance > 4:
        raise ValueError("the grid join covers distances up to 4")
    close = written(_merge_close(reps), "close") if distance == 4 else None
    points = reps.withColumn("cluster", F.col("node"))
    if close is not None:
        points = (
            reps.join(components(close).withColumnRenamed("component", "cluster"), "node", "left")
            .select("fp", "node", F.coalesce("cluster", "node").alias("cluster"))
        )
    # few small files hold all points: deal them out before each becomes its cells
    spark = reps.sparkSession
    points = written(points, "points").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    spread = F.concat(cells(F.col("fp"), 0), cells(F.col("fp"), 1))
    placed = points.select(F.explode(spread).alias("cell"), "fp", "cluster").where("cell is not null")
    # the engine sizes cells as the points they come from, which are up to 66 times fewer, and would broadcast them by that size
    left = placed.select("cell", F.col("fp").alias("fp_a"), F.col("cluster").alias("a")).hint("merge")
    right = placed.select("cell", F.col("fp").alias("fp_b"), F.col("cluster").alias("b"))
    found = (
        left.join(
            right,
            (left.cell == right.cell)
            & (F.col("a") < F.col("b"))
            & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= distance),
        )
        .select("a", "b")
        .distinct()
    )
    return found if close is None else found.unionByName(close)


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) per row."""
    prints = written(fingerprints(docs), "fingerprints")
    reps = written(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(_NO_ID) + F.shiftrightunsigned("fp", 2)).alias("node")), "reps")
    group = components(links(reps, distance))
    named = reps.join(group, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("component_id") < F.lit(_NO_ID), F.col("component_id")).alias("component_id"),
    )


#: The pipeline's stage: word shingles, least Jaccard similarity, and bands x rows of MinHash values.
WIDTH, SIMILARITY, BANDS, ROWS = 5, 0.8, 16, 5
#: Rounds in which buckets are compared with one of their texts; pairs a text that may be left for the last step without another
#: round; and the share of the pairs that a round may leave if another one is to follow.
ROUNDS, FEW, GAIN = 8, 16, 0.8
#: Buckets of so many texts are compared pair by pair; the texts of larger ones meet at their rarest shingles.
SMALL = 8
_MINHASH = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(fours: np.ndarray) -> np.ndarray:
    """The distinct hashes of five-word shingles, each made of the hashes of its two four-word shingles."""
    if len(fours) < 2:
        return fours
    both = fours[:-1] * np.uint64(0x9E3779B97F4A7C15) + fours[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique(both ^ (both >> np.uint64(31)))


def bands(shingles: np.ndarray) -> list[int]:
    """One hash per band of MinHash values; texts of similarity 0.8 share one with probability 0.998."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        least = np.minimum(least, (_MINHASH[:, None] * shingles[None, i : i + 1024]).min(axis=1))
    return [xxhash.xxh64_intdigest(x.tobytes(), b) - (1 << 63) for b, x in enumerate(least.reshape(BANDS, ROWS))]


SKETCH = "doc_id bigint, sha binary, fp bigint, n int, bands array<bigint>, row bigint"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, sizes, found = [], [], []
        for text in batch.column(2).to_pylist():
            fours = shingle_hashes(text)
            fps.append(int(fours[0]) if len(fours) == 1 else majority(fours))
            own = shingle_set(fours)
            sizes.append(len(own))
            found.append(bands(own))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64())), batch.column(3)],
            names=["doc_id", "sha", "fp", "n", "bands", "row"],
        )


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(shingle_hashes(x)).view(np.int64) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["sha", "shingles"])


def _sets(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, shingles)`` of the texts ``asked (node, sha)``, written."""
    texts = docs.join(asked.select("sha"), "sha", "left_semi").select("sha", "text").mapInArrow(_shingles, "sha binary, shingles array<bigint>")
    return written(texts.dropDuplicates(["sha"]).join(asked, "sha").select("node", "shingles"), "shingles")


def _may_be_similar(texts: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``texts (node, cluster)`` in different clusters, among them all whose sets are similar enough.

    Whatever the order of all shingles, two sets of similarity SIMILARITY share one of the
    first ``n - ceil(SIMILARITY * n) + 1`` in each; the first that they share leaves them
    enough to come to that similarity.  Rare shingles come first, so a common line or
    passage brings no pairs together.
    """
    with only_last(docs.sparkSession):
        sets = _sets(texts.select("node").join(nodes.select("node", "sha"), "node"), docs)
        tokens = sets.select("node", F.explode("shingles").alias("s"))
        held = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
        rare = F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(1)).alias("held"), "s")))
        first = F.expr(f"slice(rare, 1, cast(size(rare) - ceil({SIMILARITY} * size(rare) - 1e-6) + 1 as int))")
        prefixes = tokens.join(held, "s", "left").groupBy("node").agg(rare.alias("rare")).select("node", F.size("rare").alias("n"), F.posexplode(first).alias("at", "x"))
        prefixes = written(prefixes.where("x.held > 1").join(texts, "node").select("node", "cluster", (F.col("n") - F.col("at")).alias("rest"), "n", F.col("x.s").alias("s")), "prefixes")
        side = lambda x: prefixes.select("s", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "cluster", "rest", "n")))
        enough = F.least("rest_a", "rest_b") >= (F.col("n_a") + F.col("n_b")) * SIMILARITY / (1 + SIMILARITY) - 1e-6
        a, b = side("a"), side("b")
        met = a.join(b, (a.s == b.s) & (F.col("cluster_a") < F.col("cluster_b")) & enough)
        return written(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "met")


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs (a, b)`` whose shingle sets have Jaccard similarity SIMILARITY or more."""
    with only_last(docs.sparkSession):
        size = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"))
        # sets of too different sizes can't be similar
        pairs = pairs.join(size("a"), "a").join(size("b"), "b").where(F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= SIMILARITY)
        pairs = written(pairs.select("a", "b"), "pairs")
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "sha"), "node").select("node", "sha")
        sets = _sets(asked, docs)
        both = (
            pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
            .withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
        )
        return written(both.where(F.col("common") / (F.size("of_a") + F.size("of_b") - F.col("common")) >= SIMILARITY).select("a", "b"), "similar")


def keep_documents(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies (the one with the least id), with all its columns.

    Near copies are texts within op2's distance, and texts whose sets of five-word shingles
    have a Jaccard similarity of 0.8 or more: MinHash bands give candidates, the sets decide.
    In each bucket all are compared with the least one first, then, as long as many pairs are
    in different components and rounds lessen them, with another one chosen by hash.  The
    rest is compared pair by pair, so nothing is missed, and a large family of copies doesn't
    pair up.

    Texts are told apart by their digest (A-Z lower-cased), so rows without an id or with a
    repeated one are compared like any other; ids only choose among near copies, nulls last.
    """
    small_arrow_batches(docs.sparkSession)
    rows, row = numbered(docs)
    sha = F.unhex(F.sha2(ascii_lower(F.col("text")).cast("binary"), 256))
    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("sha"), "text", F.col(row).alias("row"))
    sketches = own.mapInArrow(_sketches, SKETCH)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha", "row")).alias("first")
    of_text = [first, *(F.first(c).alias(c) for c in ("fp", "n", "bands"))]
    nodes = written(sketches.groupBy("sha").agg(*of_text).withColumn("node", F.monotonically_increasing_id()), "nodes")
    reps = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "reps")
    same = nodes.select("fp", F.col("node").alias("b")).join(reps.withColumnRenamed("node", "a"), "fp").where("a <> b").select("a", "b")
    edges = written(links(reps).unionByName(same), "links")

    placed = written(nodes.where("n > 0").select("node", F.posexplode("bands").alias("band", "value")), "placed")
    least = placed.groupBy("band", "value").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("held")).where("held > 1")
    stars = placed.join(least, ["band", "value"]).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    edges = written(edges.unionByName(_similar(stars, nodes, own)), "links")

    texts, left_over = nodes.count(), float("inf")
    for turn in range(ROUNDS + 1):
        clusters = components(edges).select("node", F.col("component").alias("cluster"))
        mixed = placed.join(clusters, "node", "left").select("band", "value", "node", F.coalesce("cluster", "node").alias("cluster"))
        several = mixed.groupBy("band", "value").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high").select("band", "value")
        mixed = written(mixed.join(several, ["band", "value"]), "mixed")
        sizes = mixed.groupBy("band", "value", "cluster").count().groupBy("band", "value").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("own"))
        before, left_over = left_over, sizes.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0.0))).first()[0]
        if turn == ROUNDS or left_over <= FEW * texts or left_over > GAIN * before:
            break
        # each bucket is compared with one of its texts, another one in every band and round
        chosen = F.min(F.struct(F.xxhash64("node", "band", F.lit(turn)).alias("by"), "node", "cluster")).alias("c")
        centres = mixed.groupBy("band", "value").agg(chosen).select("band", "value", F.col("c.node").alias("a"), F.col("c.cluster").alias("of_a"))
        stars = mixed.join(centres, ["band", "value"]).where("cluster <> of_a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        edges = written(edges.unionByName(_similar(stars, nodes, own)), "links")
    held = mixed.groupBy("band", "value").count()
    few = mixed.join(held.where(F.col("count") <= SMALL), ["band", "value"])
    many = written(mixed.join(held.where(F.col("count") > SMALL), ["band", "value"]).select("node", "cluster").distinct(), "many")
    left = few.select("band", "value", F.col("node").alias("a"), F.col("cluster").alias("of_a"))
    right = few.select("band", "value", F.col("node").alias("b"), F.col("cluster").alias("of_b"))
    pairs = left.join(right, ["band", "value"]).where("of_a < of_b").select("a", "b")
    edges = edges.unionByName(_similar(pairs.unionByName(_may_be_similar(many, nodes, own)).distinct(), nodes, own))

    kept = (
        nodes.join(components(edges), "node", "left")
        .groupBy(F.coalesce("component", "node").alias("component"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.row").alias(row))
    )
    dropped = rows.select(row).join(kept, row, "left_anti")  # numbers only; these alone meet the texts
    return rows.join(dropped, row, "left_anti").select(*(rows[c] for c in docs.columns))
