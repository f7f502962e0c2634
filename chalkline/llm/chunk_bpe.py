"""Byte-level BPE by ranks, with long texts encoded in overlapping chunks.

A text longer than ``CHUNK`` characters is cut into chunks that each reach ``OVERLAP``
characters into the next.  Then

1. all chunks are pre-tokenised on their own, in parallel.  A chunk that begins inside a
   pre-token is wrong there, and so is what stands at its end, where the text goes on;
2. neighbours are stitched where their boundaries resynchronise: the first position inside
   the overlap at which both have a boundary.  From there on both read the same text from
   the same place, so the next chunk is right.  Chunks that share none (one pre-token spans
   the overlap) stay together with their neighbours and are read again as one;
3. every piece between two stitches is encoded: each pre-token by merging the adjacent pair
   of the least rank, leftmost first, until no pair has one.

Shorter texts are one chunk and never leave their task.  Of long texts only chunks, stitch
positions and ids move; a text's ids are read in order by one task that holds one piece at
a time.  Decoding concatenates the raw bytes of the ids.

Defined results: a null text counts as empty (no ids, hash of nothing); there are no
special tokens; repeated rows give repeated rows; an empty table gives no rows; extra
columns are ignored whatever their names; a pre-token of any length is merged as one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import arrow_rows, small_arrow_batches, written

CHUNK, OVERLAP = 16_384, 1024
#: Characters at a chunk's end that its boundaries don't count in: the pattern looks ahead by less.
MARGIN = 8
#: Pre-tokens whose ids a worker keeps, twice (recent ones, and those before), and their greatest length; a bound on memory only.
MEMO, MEMO_LENGTH = 400_000, 48
#: From this length on pairs wait in a heap.
LONG = 100
#: Unicode's white space, as the pattern means it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class RankedBpe:
    """Ranks of byte strings, and the pattern of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no rank for the bytes {missing}")
        self.ranks = ranks
        self.labels = {i: b for b, i in ranks.items()}
        self.names = {i: str(i) for i in self.labels}
        self.split = regex.compile(pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def piece(self, pretoken: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        ids = self.memo.get(pretoken) or self.older.get(pretoken)
        if ids is None:
            raw = pretoken.encode()
            whole = self.ranks.get(raw)
            ids = (whole,) if whole is not None else self._few(raw) if len(raw) < LONG else self._many(raw)
        if len(pretoken) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[pretoken] = ids
        return ids

    def pieces(self, pretokens: list[str]) -> list[int]:
        out = list(map(self.memo.get, pretokens))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = self.piece(pretokens[i])
        return list(chain.from_iterable(out))

    def _few(self, raw: bytes) -> tuple[int, ...]:
        get, none = self.ranks.get, len(self.ranks) + (1 << 40)
        cuts = list(range(len(raw) + 1))
        pairs = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs and (least := min(pairs)) != none:
            i = pairs.index(least)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(raw[cuts[i] : cuts[i + 2]], none)
            if i:
                pairs[i - 1] = get(raw[cuts[i - 1] : cuts[i + 1]], none)
        return tuple([self.ranks[raw[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)])

    def _many(self, raw: bytes) -> tuple[int, ...]:
        get, n = self.ranks.get, len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the next part begins, and the one before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        dead = bytearray(n)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = after[i]
            if dead[i] or middle == n or after[middle] != end:
                continue  # one of the two parts has been merged since
            dead[middle] = 1
            after[i] = end
            if end < n:
                before[end] = i
                if (r := get(raw[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := get(raw[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str, start: int = 0, end: int | None = None) -> list[int]:
        """Ids of the pre-tokens of ``text`` from ``start`` to ``end``, both boundaries of it."""
        if end is None or end == len(text):
            return self.pieces(self.split.findall(text, start))
        if start >= end:
            return []
        read = self.split.findall(text, start)  # what follows the end decides where the last pre-tokens end
        ends = self.ends(text, start, read)
        last = int(np.searchsorted(ends, end))
        if last == len(ends) or ends[last] != end:
            raise ValueError("pre-tokens of neighbouring chunks don't meet")
        return self.pieces(read[: last + 1])

    def ends(self, text: str, start: int = 0, read: list[str] | None = None) -> np.ndarray:
        """Where the pre-tokens from ``start`` on end."""
        read = self.split.findall(text, start) if read is None else read
        ends = start + np.cumsum(np.fromiter(map(len, read), np.int64, len(read)))
        if len(ends) and ends[-1] == len(text):
            return ends
        return np.fromiter((m.end() for m in self.split.finditer(text, start)), np.int64)  # the pattern leaves something out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


_known: dict[tuple[str, str], RankedBpe] = {}


def ranked(path: str, pattern: str) -> RankedBpe:
    """The ranks in a file of lines ``base64 rank``, read once per worker."""
    if (path, pattern) not in _known:
        with open(path, "rb") as f:
            _known[path, pattern] = RankedBpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)
    return _known[path, pattern]


class Digest:
    """What a text's ids and their bytes hash to, piece after piece."""

    def __init__(self) -> None:
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, machine: RankedBpe, ids: list[int]) -> None:
        if ids:
            self.ids.update((" " if self.n else "").encode() + " ".join(map(machine.names.__getitem__, ids)).encode())
            self.text.update(machine.decode(ids))
            self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digests(ids: list, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    )


def _whole(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chalkline.llm.chunk_bpe import Digest, ranked

        machine = ranked(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                digest = Digest()
                digest.add(machine, machine.encode(text or ""))
                rows.append(digest.row())
            yield _digests(batch.column(0).to_pylist(), rows)

    return run


CHUNKS = "row bigint, doc_id bigint, k int, last boolean, body string"


def _cut(chunk: int, overlap: int):
    """Rows (row, doc_id, text) to overlapping chunks, a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count = max(1, -(-len(text) // chunk))
                for low in range(0, count, 64):
                    ks = range(low, min(count, low + 64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(ks), pa.int64()), pa.array([doc] * len(ks), pa.int64()), pa.array(ks, pa.int32()),
                            pa.array([k == count - 1 for k in ks]), pa.array([text[k * chunk : (k + 1) * chunk + overlap] for k in ks]),
                        ],
                        names=["row", "doc_id", "k", "last", "body"],
                    )

    return run


def _ends(path: str, pattern: str, chunk: int, overlap: int):
    """(row, k, head, tail): boundaries of a chunk, as positions in the text, in what it shares with the chunk before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chalkline.llm.chunk_bpe import ranked

        machine = ranked(path, pattern)
        for batch in batches:
            heads, tails = [], []
            rows, ks, bodies = (batch.column(i).to_pylist() for i in range(3))
            for k, body in zip(ks, bodies, strict=True):
                ends = machine.ends(body)
                heads.append(np.concatenate(([0], ends[ends <= overlap])) + k * chunk)
                sure = len(body) - MARGIN if len(body) == chunk + overlap else len(body)
                tails.append(ends[(ends >= chunk) & (ends <= sure)] + k * chunk)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ks, pa.int32()), pa.array(heads, kind), pa.array(tails, kind)], names=["row", "k", "head", "tail"])

    return run


PIECES = "row bigint, doc_id bigint, k int, ids array<int>"


def _pieces(path: str, pattern: str, chunk: int):
    """Chunks with their stitches, in order, to the ids of each piece.  Chunks that share no boundary are read as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chalkline.llm.chunk_bpe import ranked

        machine = ranked(path, pattern)
        held: list[dict] = []

        def piece() -> pa.RecordBatch:
            first, last = held[0], held[-1]
            base = first["k"] * chunk
            text = "".join([*(x["body"][:chunk] for x in held[:-1]), last["body"]])
            ids = machine.encode(text, first["start"] - base, len(text) if last["last"] else last["stop"] - base)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([first["row"]], pa.int64()), pa.array([first["doc_id"]], pa.int64()), pa.array([first["k"]], pa.int32()), pa.array([ids], pa.list_(pa.int32()))],
                names=["row", "doc_id", "k", "ids"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                held.append(batch.slice(i, 1).to_pylist()[0])
                if held[-1]["last"] or held[-1]["stop"] is not None:
                    yield piece()

    return run


def _joined(path: str, pattern: str):
    """Pieces in order to one digest row per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chalkline.llm.chunk_bpe import Digest, ranked

        machine = ranked(path, pattern)
        row = doc = digest = None
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                if digest is None or x["row"] != row:
                    if digest:
                        yield _digests([doc], [digest.row()])
                    row, doc, digest = x["row"], x["doc_id"], Digest()
                digest.add(machine, x["ids"])
        if digest:
            yield _digests([doc], [digest.row()])

    return run


def pieces(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The operator's real output: row, doc_id, k, ids of every piece of every text of ``docs``; k orders the pieces of a row."""
    if not MARGIN < overlap <= chunk:
        raise ValueError(f"the overlap must be over {MARGIN} and not over the chunk's size")
    spark = docs.sparkSession
    small_arrow_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    with arrow_rows(spark, 8):  # a row is a whole long text
        chunks = written(rows.mapInArrow(_cut(chunk, overlap), CHUNKS).repartition("row", "k"), "chunks")
    ends = chunks.select("row", "k", "body").mapInArrow(_ends(path, pattern, chunk, overlap), "row bigint, k int, head array<bigint>, tail array<bigint>")
    w = Window.partitionBy("row").orderBy("k")
    ends = ends.select("row", "k", F.array_min(F.array_intersect("tail", F.lead("head").over(w))).alias("stop"))
    stitched = ends.select(
        "row", "k", "stop", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.lag("stop").over(w)).alias("start")
    ).withColumn("piece", F.count("start").over(w))
    placed = chunks.join(stitched, ["row", "k"]).repartition("row", "piece").sortWithinPartitions("row", "k")
    return placed.select("row", "doc_id", "k", "last", "start", "stop", "body").mapInArrow(_pieces(path, pattern, chunk), PIECES)


def encode_decode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs (doc_id, text)``.

    ``path`` names the file of ranks, which is installed with the workers' Python.
    """
    small_arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = docs.where(F.octet_length("text") <= chunk).mapInArrow(_whole(path, pattern), DIGESTS)
    long = pieces(docs.where(F.octet_length("text") > chunk), path, pattern, chunk, overlap)
    return short.unionByName(long.repartition("row").sortWithinPartitions("row", "k").mapInArrow(_joined(path, pattern), DIGESTS))
