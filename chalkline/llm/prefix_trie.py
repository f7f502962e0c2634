"""The trie of conversation prefixes, from padded matrices of turn ids.

A turn is known by 128 bits of its SHA-256, a conversation by the row of its turns' ids.
Rows are dealt into shards by ranges of (turn ids, conv_id), so the conversations below any
node lie side by side.  In a shard,

1. ids become numbers of their order, and a padded matrix (cut into panels of ``PANEL``
   columns, each for the rows that go on so far) is put in order by lexsort;
2. a mask tells where a row differs from the one above in a column; OR-accumulated along
   the columns it marks the rows at which the nodes of every depth start;
3. reduceat sums up every depth from these starts, and sums of subtrees go from the
   deepest column back to the first.

Only nodes on the path of a shard's first or last row can go on in another shard.  These
boundary nodes carry the sums of what hangs off them, and are recombined: they are dealt by
their first turn, read in order of their paths with the shards' shares of one node side by
side, and closed on a stack, so that sums reach the nodes above.  Their number is bounded
by the shards and their depths, not by the conversations.  Ids of conversations that end
at a node come in order within and across shards, so their digest is taken as they come.

Defined results: a null role or text counts as empty; a null turn comes first, and turns
that tie go by role, then text; rows without a ``conv_id`` belong to no conversation; an
empty table gives no rows (otherwise there is a root); extra columns are ignored.  The
ids of one conversation are held in memory (16 bytes a turn), its texts are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import arrow_rows, written

PANEL = 16
ID = 16
#: Turns that a shard is laid out for.
SHARD_TURNS = 400_000

PARTS = (
    "node binary, path binary, shard int, depth bigint, conv_id bigint, parent_conv_id bigint, parent binary, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, size bigint, ends binary, ends_sha256 string"
)
NODES = "node binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def node_of(path: bytes) -> bytes:
    return hashlib.sha256(path).digest()[:ID]


def decimals(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


class Shard:
    """Conversations in one range: their nodes at every depth."""

    def __init__(self, conv: np.ndarray, paths: list[bytes], sizes: list[np.ndarray]):
        lengths = np.array([len(p) // ID for p in paths], np.int64)
        raw = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((raw[:, 1], raw[:, 0]))
        ranked = raw[order]
        number = np.empty(len(raw), np.int32)
        number[order] = np.cumsum(np.concatenate(([True], (ranked[1:] != ranked[:-1]).any(axis=1)))) if len(raw) else 0
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        self.ids, self.bytes = number, np.concatenate([*sizes, np.zeros(0, np.int64)])
        order = self._order(conv, lengths, starts)
        self.conv, self.lengths, self.starts = conv[order], lengths[order], starts[order]
        self.first, self.last = paths[order[0]], paths[order[-1]]

    def panel(self, rows: np.ndarray, lengths: np.ndarray, starts: np.ndarray, column: int) -> np.ndarray:
        """Ids of ``PANEL`` columns from ``column`` on; 0 pads."""
        out = np.zeros((len(rows), PANEL), np.int32)
        width = np.minimum(lengths[rows] - column, PANEL)
        row = np.repeat(np.arange(len(rows)), width)
        at = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(width)[:-1])), width)
        out[row, at] = self.ids[starts[rows][row] + column + at]
        return out

    def _order(self, conv: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
        order = np.argsort(conv, kind="stable")
        deepest = int(lengths.max(initial=0))
        for column in range((deepest - 1) // PANEL * PANEL if deepest else -1, -1, -PANEL):  # last panel first, each keeps the order so far
            goes = lengths[order] > column
            rows = order[goes]
            matrix = self.panel(rows, lengths, starts, column)
            order = np.concatenate((order[~goes], rows[np.lexsort(matrix.T[::-1])]))
        return order

    def depths(self) -> list[dict[str, np.ndarray]]:
        """For every depth from 0 on: first row, rows, parent, least id, rows that end, and size of the last text of each node."""
        n = len(self.conv)
        zero = np.zeros(1, np.int64)
        out = [{"row": zero, "rows": zero + n, "parent": zero, "least": self.conv.min(keepdims=True), "ends": zero + int((self.lengths == 0).sum()), "size": zero}]
        group = np.zeros(n, np.int64)  # each row's node at the depth reached
        for column in range(0, int(self.lengths.max(initial=0)), PANEL):
            rows = np.flatnonzero(self.lengths > column)
            matrix = self.panel(rows, self.lengths, self.starts, column)
            differs = np.ones((len(rows), PANEL + 1), bool)
            differs[1:, 0] = np.diff(group[rows]) != 0
            differs[1:, 1:] = matrix[1:] != matrix[:-1]
            differs = np.logical_or.accumulate(differs, axis=1)[:, 1:]
            for j in range(PANEL):
                here = matrix[:, j] != 0
                on = rows[here]
                if not len(on):
                    break
                begins = np.flatnonzero(differs[here, j])
                first = on[begins]
                out.append({
                    "row": first, "rows": np.diff(np.append(begins, len(on))), "parent": group[first], "least": np.minimum.reduceat(self.conv[on], begins),
                    "ends": np.add.reduceat((self.lengths[on] == column + j + 1).astype(np.int64), begins), "size": self.bytes[self.starts[first] + column + j],
                })
                group[on] = np.cumsum(differs[here, j]) - 1
        return out

    def parts(self, number: int, root: int) -> Iterator[pa.RecordBatch]:
        """Whole nodes with their results, and the share of each boundary node.

        ``root`` is the least id of all conversations, which the root's children name as parent.
        """
        levels = self.depths()
        for d, x in enumerate(levels):
            count = len(x["row"])
            x["open"] = np.zeros(count, bool)  # nodes that hold the first or the last row
            x["open"][0] |= d <= len(self.first) // ID
            x["open"][-1] |= d <= len(self.last) // ID
            x["children"], x["leaves"], x["saved"] = (np.zeros(count, np.int64) for _ in range(3))
        for d in range(len(levels) - 1, -1, -1):
            x = levels[d]
            whole = ~x["open"]
            x["leaves"][whole & (x["children"] == 0)] = 1
            x["saved"][whole] += ((x["rows"] - 1) * x["size"])[whole]
            if d:
                above = levels[d - 1]
                np.add.at(above["children"], x["parent"][whole], 1)
                np.add.at(above["leaves"], x["parent"][whole], x["leaves"][whole])
                np.add.at(above["saved"], x["parent"][whole], x["saved"][whole])
        path = {0: hashlib.sha256(), -1: hashlib.sha256()}  # of the first and the last row, a turn longer at each depth
        above: dict[int, bytes] = {}
        for d, x in enumerate(levels):
            count = len(x["row"])
            names: dict[int, bytes] = {}
            routes: dict[int, bytes] = {}
            for end, line in ((0, self.first), (-1, self.last)):
                if d <= len(line) // ID:
                    path[end].update(line[(d - 1) * ID : d * ID] if d else b"")
                    names[end % count] = path[end].digest()[:ID]
                    routes[end % count] = line[: d * ID]
            ends: list[bytes | None] = [None] * count
            sums: list[str | None] = [None] * count
            for i, (row, stop) in enumerate(zip(x["row"].tolist(), x["ends"].tolist(), strict=True)):
                text = decimals(self.conv[row : row + stop]) if stop else b""
                if i in names:
                    ends[i] = text
                else:
                    sums[i] = hashlib.sha256(text).hexdigest() if stop else EMPTY
            parents = x["parent"].tolist()
            lost = [above.get(p) if d > 1 else None for p in parents]
            least = levels[d - 1]["least"][x["parent"]].tolist() if d > 1 else [root if d else None] * count
            node = [names.get(i) for i in range(count)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node, pa.binary()), pa.array([routes.get(i) for i in range(count)], pa.binary()), pa.array([number] * count, pa.int32()), pa.array([d] * count, pa.int64()),
                    pa.array(x["least"], pa.int64()), pa.array([None if lost[i] or node[i] else least[i] for i in range(count)], pa.int64()), pa.array(lost, pa.binary()),
                    pa.array(x["rows"], pa.int64()), pa.array(x["children"], pa.int64()), pa.array(x["leaves"], pa.int64()), pa.array(x["saved"], pa.int64()),
                    pa.array(x["size"], pa.int64()), pa.array(ends, pa.binary()), pa.array(sums, pa.string()),
                ],
                names=[c.split()[0] for c in PARTS.split(", ")],
            )
            above = names


EMPTY = hashlib.sha256(b"").hexdigest()


def _sharded(root: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from chalkline.llm.prefix_trie import Shard

        conv, paths, sizes = [], [], []
        for batch in batches:
            conv.append(batch.column(0).to_numpy())
            paths += [x or b"" for x in batch.column(1).to_pylist()]
            sizes += [np.array(x or [], np.int64) for x in batch.column(2).to_pylist()]
        if paths:
            yield from Shard(np.concatenate(conv), paths, sizes).parts(TaskContext.get().partitionId(), root)

    return run


class Open:
    """A boundary node whose subtree is being read."""

    def __init__(self, row: dict, parent: int | None):
        self.node, self.path, self.depth, self.size, self.parent = row["node"], row["path"], row["depth"], row["size"], parent
        self.conv, self.n, self.children, self.leaves, self.saved, self.first = row["conv_id"], 0, 0, 0, 0, True
        self.ends = hashlib.sha256()

    def share(self, row: dict) -> None:
        self.conv = min(self.conv, row["conv_id"])
        self.n += row["n_convs"]
        self.children += row["n_children"]
        self.leaves += row["n_leaves"]
        self.saved += row["saved_tokens"]
        if row["ends"]:
            self.ends.update(row["ends"] if self.first else b"," + row["ends"])
            self.first = False

    def close(self, above: Open | None) -> list:
        """The node's row; its sums go to the node ``above``.  (The root closes elsewhere.)"""
        if self.depth:
            self.leaves += self.children == 0
            self.saved += (self.n - 1) * self.size
        if above:
            above.children += 1
            above.leaves += self.leaves
            above.saved += self.saved
        return [self.node, self.depth, self.conv, above.conv if above else self.parent, self.n, self.children, self.leaves, self.saved, self.ends.hexdigest()]


def _recombined(root: int):
    """Shares of boundary nodes, in order of first turn, path and shard, to whole nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chalkline.llm.prefix_trie import Open

        open_: list[Open] = []
        done: list[list] = []

        def close() -> None:
            node = open_.pop()
            done.append(node.close(open_[-1] if open_ else None))

        def out() -> pa.RecordBatch:
            kinds = [pa.binary(), *[pa.int64()] * 7, pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[c.split()[0] for c in NODES.split(", ")])
            done.clear()
            return made

        for batch in batches:
            for row in batch.to_pylist():
                if open_ and open_[-1].path == row["path"]:
                    open_[-1].share(row)
                    continue
                # a node's least id is whole only when all its shares are in, which come before any path below it
                while open_ and not (row["depth"] > 1 and row["path"].startswith(open_[-1].path)):
                    close()
                open_.append(Open(row, root if row["depth"] == 1 else None))
                open_[-1].share(row)
            if len(done) >= 1000:
                yield out()
        while open_:
            close()
        if done:
            yield out()

    return run


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): per conversation its turns' ids, one after another, and the bytes of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    known = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * ID)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), known.alias("id"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return (
        turns.withColumn("at", F.row_number().over(order))
        .groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", F.octet_length("text").cast("long").alias("size")))).alias("t"))
        .select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))
    )


def rebuilt(rows: DataFrame, group: int = 5, spread: int = 9) -> DataFrame:
    """``turn_ids`` with each conversation's first turns taken from the one whose id heads its group.

    Conversation c takes ``crc32(c) % spread`` turns from c - c % group, then its own after as many.
    """
    heads = rows.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("head"), F.slice("ids", 1, spread - 1).alias("head_ids"), F.slice("sizes", 1, spread - 1).alias("head_sizes")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).cast("int")

    def joined(own: str, other: str, kind: str) -> Column:
        first = F.coalesce(F.slice(other, F.lit(1), h), F.array().cast(kind))
        rest = F.when(F.size(own) > h, F.slice(own, h + 1, F.greatest(F.size(own) - h, F.lit(0)))).otherwise(F.array().cast(kind))
        return F.concat(first, rest)

    both = rows.withColumn("head", F.col("conv_id") - F.col("conv_id") % group).join(heads, "head", "left")
    return both.select("conv_id", joined("ids", "head_ids", "array<string>").alias("ids"), joined("sizes", "head_sizes", "array<bigint>").alias("sizes"))


def trie(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of ``rows (conv_id, ids, sizes)``, one conversation a row: conv_id (least member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = rows.sparkSession
    flat = written(rows.select("conv_id", F.unhex(F.array_join("ids", "")).alias("path"), "sizes"), "conversations")
    root, turns = flat.agg(F.min("conv_id"), F.sum(F.size("sizes") + 1)).first()
    if root is None:
        return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    with arrow_rows(spark, 2000):
        dealt = flat.repartitionByRange(-(-turns // shard_turns), "path", "conv_id")
        parts = written(dealt.mapInArrow(_sharded(root), PARTS), "trie-parts")
        shares = parts.where("node is not null").withColumn("turn", F.substring("path", 1, ID))
        shares = shares.repartition("turn").sortWithinPartitions("turn", "path", "shard").drop("turn")
        shared = written(shares.mapInArrow(_recombined(root), NODES), "trie-boundary")
    whole = parts.where("node is null")
    parents = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    whole = whole.where("parent is null").select(*COLUMNS).unionByName(
        whole.where("parent is not null").drop("parent_conv_id").join(parents, "parent").withColumnRenamed("above", "parent_conv_id").select(*COLUMNS)
    )
    at_top = F.col("depth") == 0
    top = shared.where("depth < 2").agg(
        F.lit(root).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.max(F.when(at_top, F.col("n_convs"))).alias("n_convs"),
        F.sum(F.when(at_top, F.col("n_children")).otherwise(1)).alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max(F.when(at_top, F.col("ends_sha256"))).alias("ends_sha256"),
    )
    top = top.withColumn("n_leaves", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")))
    return whole.unionByName(shared.where("depth > 0").select(*COLUMNS)).unionByName(top.select(*COLUMNS))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``conversations (conv_id, turn, role, text)``."""
    return trie(rebuilt(turn_ids(conversations)))


SQL = """
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM own, crc),
r AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:h], a.turns[h + 1:]) AS seq
  FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
p AS (SELECT conv_id, len(seq) AS n, unnest(range(len(seq) + 1)) AS depth, seq FROM r),
m AS (SELECT conv_id, n, depth, to_json(seq[1:depth])::VARCHAR AS prefix, to_json(seq[1:greatest(depth, 1) - 1])::VARCHAR AS above, seq[greatest(depth, 1)].text AS last FROM p),
node AS (
  SELECT depth, prefix, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * coalesce(any_value(strlen(last)), 0) END AS saved,
         sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256,
         any_value(conv_id) AS some
  FROM m GROUP BY depth, prefix),
kids AS (SELECT depth - 1 AS depth, above AS prefix, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, prefix)),
below AS (  -- every node under each of its prefixes, by a conversation that runs through it
  SELECT m.depth, m.prefix, sum((n_children = 0)::BIGINT) AS n_leaves, sum(f.saved) AS saved_tokens
  FROM full_ f JOIN m ON m.conv_id = f.some AND m.depth <= f.depth GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN below USING (depth, prefix) LEFT JOIN node u ON f.depth > 0 AND u.depth = f.depth - 1 AND u.prefix = f.above
"""
