"""Mixing overlapping sources to target weights by min-cost flow.

1. Documents are aggregated by membership pattern (the set of sources that hold them):
   the only thing the driver sees is one row per pattern and one per source.
2. Targets: the sources share ``share`` of all words by weight; a source's target stops at
   ``repeat_cap`` times its size and the excess is shared again by weight.
3. Flow: each pattern offers its words once per repetition, every further repetition at a
   higher (convex) cost; successive cheapest augmenting paths route them to the targets.
4. Selection: a seeded hash orders each pattern's documents.  A running total over hash
   buckets finds the one bucket where the quota ends, and only inside that bucket are
   documents ordered, so no source, however large, is gathered into one task.

Defined results: null text has size 0; a null source is a source of its own, last in
order, and a null or empty list of sources is that one; lists are sets, whatever their
order; rows without an id or with a repeated one are placed by their texts too; repeated
rows are separate documents; an empty table gives no rows; extra columns are ignored.
More than ``MOST_PATTERNS`` different memberships are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import numbered, unused, written

WORD = "[^\\x20\\x09-\\x0D]+"
#: Hash buckets that selection cuts a source into at least, and the rows that one is laid out for.
LEAST_BUCKETS, BUCKET_ROWS = 1 << 12, 50_000
#: The driver routes one row per membership pattern.
MOST_PATTERNS = 200_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: Sequence[float], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Split ``share`` x all words by weight; none above ``cap`` x its size, excess reshared until none is."""
    left = share * sum(sizes)
    out = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes))]
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
        left = max(left, 0.0)
    return out


def route(
    patterns: Sequence[Sequence[int]], sizes: Sequence[float], quota: Sequence[float], cap: int, eps: float = 1e-9
) -> list[list[float]]:
    """Words each pattern gives each of its sources, by successive cheapest augmenting paths.

    Repetition r of a pattern's words costs r, so a document is repeated only where no
    unrepeated words can reach the quota.  Returns ``flow[pattern][source position]``.
    """
    import heapq

    flow = [[0.0] * len(p) for p in patterns]
    used, need = [0.0] * len(patterns), list(quota)
    holders: dict[int, list[tuple[int, int]]] = {}
    for p, members in enumerate(patterns):
        for k, s in enumerate(members):
            holders.setdefault(s, []).append((p, k))
    for level in range(1, cap + 1):
        room = [level * n for n in sizes]
        # at this cost level: direct flow first, then paths that move another source's words over
        order = [p for p in range(len(patterns)) if room[p] - used[p] > eps]
        heapq.heapify(heap := [(len(patterns[p]), p) for p in order])
        while heap:
            _, p = heapq.heappop(heap)
            for k, s in enumerate(patterns[p]):
                x = min(room[p] - used[p], need[s])
                if x > eps:
                    flow[p][k] += x
                    used[p] += x
                    need[s] -= x
        for s in range(len(need)):
            while need[s] > eps and (path := _augment(s, patterns, flow, used, room, holders, eps)):
                steps, x = path
                x = min(x, need[s])
                for p, k, sign in steps:
                    flow[p][k] += sign * x
                used[steps[-1][0]] += x
                need[s] -= x
    return flow


def _augment(s, patterns, flow, used, room, holders, eps):
    """The shortest path from source ``s`` to a pattern with room, over words that can change hands."""
    seen, queue = {s}, [(s, [], float("inf"))]
    for at, steps, width in queue:
        for p, k in holders.get(at, ()):
            spare = room[p] - used[p]
            if spare > eps:
                return [*steps, (p, k, 1)], min(width, spare)
            for j, other in enumerate(patterns[p]):
                if other not in seen and flow[p][j] > eps:
                    seen.add(other)
                    queue.append((other, [*steps, (p, k, 1), (p, j, -1)], min(width, flow[p][j])))
    return None


def mix_documents(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    repeat_cap: int = 2,
    sources: Column | None = None,
    seed: int = 0,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of ``docs``.

    ``sources`` is an array column of the sources that hold the document (default: the
    one in ``source``).  Weights go round over the sources in code-point order, null last.
    ``source_size`` and ``target`` belong to the document's first source in that order.
    """
    return _mixed(docs, F.monotonically_increasing_id(), weights, share, repeat_cap, sources, seed).drop("row")


def _mixed(
    docs: DataFrame,
    row: Column,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    repeat_cap: int = 2,
    sources: Column | None = None,
    seed: int = 0,
) -> DataFrame:
    """``mix_documents`` with the number of each row."""
    spark = docs.sparkSession
    members = F.array(F.col("source").cast("string")) if sources is None else sources.cast("array<string>")
    members = F.when(F.size(members) > 0, F.array_sort(F.array_distinct(members))).otherwise(F.array(F.lit(None).cast("string")))
    placed = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))
    sized = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), members.alias("sources"), word_count(F.col("text")).alias("size"), row.alias("row"), placed.alias("place")),
        "sizes",
    )
    count = max(LEAST_BUCKETS, -(-sized.count() // BUCKET_ROWS))
    rows = sized.withColumn("bucket", F.pmod("place", F.lit(count)).cast("int"))
    # one row per pattern and bucket; partial sums before the shuffle
    buckets = written(rows.groupBy("sources", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "buckets")
    whole = buckets.groupBy("sources").agg(F.sum("words").alias("words"))
    if whole.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    patterns = [(list(r["sources"]), float(r["words"])) for r in whole.collect()]
    patterns.sort(key=lambda p: [(x is None, x or "") for x in p[0]])
    names = sorted({s for p, _ in patterns for s in p}, key=lambda x: (x is None, x or ""))
    if not names:
        return rows.selectExpr("row", "doc_id", "size", "0L source_size", "0D target", "0L taken", "0 copies")
    place = {s: i for i, s in enumerate(names)}
    size = [0.0] * len(names)
    for p, n in patterns:
        for s in p:
            size[place[s]] += n
    weight = [float(weights[i % len(weights)]) for i in range(len(names))]
    target = targets(size, weight, share, repeat_cap)
    ids = [[place[s] for s in p] for p, _ in patterns]
    capacity = [n for _, n in patterns]
    flow = route(ids, capacity, target, repeat_cap)

    plan = spark.createDataFrame(
        [
            (p, int(size[ids[i][0]]), float(target[ids[i][0]]), int(sum(flow[i]) // n) if n else 0, float(sum(flow[i]) % n) if n else 0.0)
            for i, (p, n) in enumerate(patterns)
        ],
        "sources array<string>, source_size bigint, target double, whole int, quota double",
    )
    # the bucket in which a pattern's quota of one more repetition ends
    w = Window.partitionBy("sources").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    key = F.col("b.sources").eqNullSafe(F.col("p.sources"))
    ends = (
        buckets.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
        .alias("b").join(plan.alias("p"), key)
        .select("b.sources", "b.bucket", "source_size", "target", "whole", (F.col("quota") - F.col("before")).alias("room"), "words")
    )
    key = F.col("r.sources").eqNullSafe(F.col("e.sources")) & (F.col("r.bucket") == F.col("e.bucket"))
    placed = rows.alias("r").join(ends.alias("e"), key).select("r.*", "source_size", "target", "whole", "room", "words")
    inside = (F.col("room") > 0) & (F.col("room") < F.col("words"))
    clear = placed.where(~inside).withColumn("more", (F.col("room") >= F.col("words")) & (F.col("room") > 0))
    w = Window.partitionBy("sources", "bucket").orderBy("place", "row").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.where(inside).withColumn("run", F.coalesce(F.sum("size").over(w), F.lit(0)))
    cut = cut.withColumn("more", F.col("run") + F.col("size") / 2 <= F.col("room")).drop("run")
    copies = (F.col("whole") + F.col("more").cast("int")).alias("copies")
    return clear.unionByName(cut).select("row", "doc_id", "size", "source_size", "target", copies).select(
        "row", "doc_id", "size", "source_size", "target", (F.col("size") * F.least("copies", F.lit(repeat_cap))).alias("taken"),
        F.least("copies", F.lit(repeat_cap)).alias("copies"),
    )


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns.

    Rows are numbered in a written table, so rows without an id or with a repeated one have
    copies of their own.  A null or empty text has size 0 and is taken as often as its
    source is; columns of any name are carried along.
    """
    rows, row = numbered(docs)
    copies = unused([*docs.columns, row], "_copies")
    taken = _mixed(rows, F.col(row)).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies))
    joined = rows.join(taken, row)
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
