"""WARC archives with a two-level capture index.

Writing: every task writes one archive of gzip members, one member per record, and
reports where each record lies.  Pages with equal payloads of at least ``least`` bytes
become one response (the largest page_id) and revisit records.  Which record is a revisit
is decided on digests and row numbers alone; the verdicts lie in a folder per task of the
scan, and the task that reads a page also writes its record, so no payload is shuffled.

Index: captures sorted by reversed-host URL key go into compressed blocks (level one); a
sparse directory holds each block's first and last key and its place (level two).

Reading: lookups, sorted by the same key, are resolved per task: a binary search in the
slice of the directory that covers them finds the block, a range read fetches it, a
binary search inside finds the capture, and a range read fetches the record alone.

Files are written under a name of their own per task attempt and are only known through
the rows of attempts that succeeded, so retried tasks leave no wrong captures.  They go
to the shared folder through pyarrow's file systems.

Defined results: null html is an empty payload; null urls have the empty key; a null
page_id stays null; pages repeated with one id give repeated records; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm.common import scratch, small_arrow_batches, written

LEAST_REVISIT = 1000
BLOCK_LINES = 1024
LOOKUPS_AT_ONCE = 16_384
READS_IN_TASK = 4096
NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Reversed-host key of a URL: ``com,example,www)/path?query``, blanks escaped."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    tail = F.regexp_extract(rest, r"^[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)
    return F.regexp_replace(key, r"[\x00-\x20]", "%20")


def _record(kind: str, page: int, url: str, payload: bytes, sha1: bytes, refers: int | None, refers_url: str, refers_key: str, date: str) -> bytes:
    safe = lambda x: quote(x, safe="/:?#[]@!$&'()*+,;=%~")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {safe(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"Page-ID: {page}",
        "Content-Type: application/http; msgtype=response",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "revisit":
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers} {refers_url}')}>",
            f"WARC-Refers-To-Target-URI: {safe(refers_url)}",
            f"Refers-To-Page-ID: {refers}",
            f"Refers-To-Key: {quote(refers_key)}",  # the target's own key: quoted URIs don't give back the url it was made of
        ]
        block = http + b"\r\n"
    else:
        block = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        headers[name] = value
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


CAPTURES = "key string, page_id bigint, file string, at bigint, bytes bigint"


def write_archives(pages: DataFrame, root: str, least: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages (page_id, url, html)`` as archives under ``root``; the captures, written as a table."""
    small_arrow_batches(pages.sparkSession)
    own = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )
    numbered = own.withColumn("row", F.monotonically_increasing_id())
    digests = written(
        numbered.where(F.octet_length("payload") >= least).select("row", "page_id", "url", F.unhex(F.sha1("payload")).alias("sha1")), "payload-digests"
    )
    # only payloads that occur more than once; counted before the shuffle, so a hot payload is one row a task
    again = (
        digests.groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("sha1", F.col("first.page_id").alias("refers"), F.col("first.url").alias("refers_url"), url_key(F.col("first.url")).alias("refers_key"))
    )
    verdicts = digests.join(again, "sha1").where("page_id <> refers").withColumn("task", F.shiftright("row", 33).cast("int"))
    told = f"{root}/verdicts"
    verdicts.select("task", "row", "sha1", "refers", "refers_url", "refers_key").repartition("task").write.partitionBy("task").parquet(told)
    rows = numbered.select("row", "page_id", "url", url_key(F.col("url")).alias("key"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        out = None
        at = 0
        revisits: dict[int, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            number, page_ids, urls, payloads = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            if out is None:
                store.create_dir(f"{base}/warc", recursive=True)
                name = f"warc/{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(f"{base}/{name}", compression=None)
                mine = f"{base}/verdicts/task={number[0] >> 33}"
                if store.get_file_info(mine).type == fs.FileType.Directory:
                    t = pads.dataset(mine, filesystem=store, format="parquet").to_table(columns=["row", "sha1", "refers", "refers_url", "refers_key"])
                    revisits = dict(zip(t.column(0).to_pylist(), zip(*(t.column(i).to_pylist() for i in range(1, 5)), strict=True), strict=True))
            places, sizes = [], []
            for row, page, url, payload in zip(number, page_ids, urls, payloads, strict=True):
                sha1 = hashlib.sha1(payload).digest()
                known, refers, refers_url, refers_key = revisits.get(row, (sha1, None, "", ""))
                if known != sha1:
                    raise ValueError(f"page {page} doesn't read as it did before")
                member = gzip.compress(_record("response" if refers is None else "revisit", page, url, payload, sha1, refers, refers_url, refers_key, date), 6, mtime=0)
                out.write(member)
                places.append(at)
                sizes.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), batch.column(1), pa.array([name] * batch.num_rows), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())],
                names=["key", "page_id", "file", "at", "bytes"],
            )
        if out is not None:
            out.close()

    return written(rows.mapInArrow(run, CAPTURES), "captures")


DIRECTORY = "first_key string, first_id bigint, last_key string, file string, at bigint, bytes bigint, lines int"


def build_index(captures: DataFrame, root: str, lines: int = BLOCK_LINES) -> str:
    """Write the capture blocks under ``root`` and the block directory; its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        out, at, held = None, 0, []
        found: list[tuple] = []

        def put(block: list[tuple]) -> None:
            nonlocal out, at, name
            if out is None:
                store.create_dir(f"{base}/index", recursive=True)
                name = f"index/{uuid.uuid4().hex}.gz"
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            data = zlib.compress("\n".join("\t".join(map(str, x)) for x in block).encode(), 6)
            out.write(data)
            found.append((block[0][0], block[0][1], block[-1][0], name, at, len(data), len(block)))
            at += len(data)

        name = ""
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= lines:
                put(held[:lines])
                held = held[lines:]
        if held:
            put(held)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)],
                names=[x.split()[0] for x in DIRECTORY.split(", ")],
            )

    path = f"{root}/directory"
    ordered = captures.select("key", "page_id", "file", "at", "bytes").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    ordered.mapInArrow(run, DIRECTORY).write.parquet(path)
    return path


class _Reader:
    """One task's view of the index and the archives."""

    def __init__(self, root: str, directory: str):
        self.store, self.base = fs.FileSystem.from_uri(root)
        self.directory = fs.FileSystem.from_uri(directory)[1]
        self.files: dict[str, pa.NativeFile] = {}

    def read(self, file: str, at: int, size: int) -> bytes:
        if file not in self.files:
            if len(self.files) > 64:
                self.files.popitem()[1].close()
            self.files[file] = self.store.open_input_file(f"{self.base}/{file}")
        return self.files[file].read_at(size, at)

    def locate(self, wanted: list[tuple[str, int]]) -> list[tuple[str, int, str, int, int]]:
        """Captures of the sorted ``wanted`` (key, page_id) pairs."""
        field = pads.field
        slice_ = pads.dataset(self.directory, filesystem=self.store, format="parquet").to_table(
            filter=(field("last_key") >= wanted[0][0]) & (field("first_key") <= wanted[-1][0])
        )
        blocks = sorted(zip(*(slice_.column(c).to_pylist() for c in ("first_key", "first_id", "file", "at", "bytes")), strict=True))
        firsts = [(b[0], b[1]) for b in blocks]
        out, loaded, entries, keys = [], -1, [], []
        for want in wanted:
            b = max(0, bisect.bisect_left(firsts, want) - 1)  # equal pairs may begin at the end of the block before
            while b < len(blocks) and firsts[b] <= want:
                if b != loaded:
                    data = zlib.decompress(self.read(*blocks[b][2:5])).decode()
                    entries = [x.split("\t") for x in data.split("\n")]
                    keys = [(x[0], int(x[1])) for x in entries]
                    loaded = b
                i = bisect.bisect_left(keys, want)
                while i < len(keys) and keys[i] == want:
                    out.append((*want, entries[i][2], int(entries[i][3]), int(entries[i][4])))
                    i += 1
                b += 1
        return out


RECORDS = "page_id bigint, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, refers_url string, refers_key string"


def fetch(lookups: DataFrame, root: str, directory: str, tasks: int | None = None) -> DataFrame:
    """Read the records of ``lookups (key, page_id)`` through the index; repeated lookups count once.

    Lookups are thin and records are not, so the number of ``tasks`` is set here (the
    session's parallelism at least) and not by the size of the lookups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(root, directory)

        def resolve(wanted: list[tuple[str, int]]) -> pa.RecordBatch:
            rows = []
            for _, page, file, at, size in sorted(reader.locate(wanted), key=lambda x: x[2:4]):
                headers, payload = parse_record(gzip.decompress(reader.read(file, at, size)))
                digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if headers["WARC-Type"] == "response":
                    if hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of page {page} in {file} at {at} doesn't have its digest")
                    rows.append((page, "response", digest, len(payload), None, None, None))
                else:
                    rows.append((page, "revisit", digest, None, int(headers["Refers-To-Page-ID"]), headers["WARC-Refers-To-Target-URI"], unquote(headers["Refers-To-Key"])))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

        held: list[tuple[str, int]] = []
        before = None
        for batch in batches:
            for want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if want != before:
                    held.append(want)
                    before = want
            if len(held) >= LOOKUPS_AT_ONCE:
                yield resolve(held)
                held = []
        if held:
            yield resolve(held)

    tasks = max(tasks or 1, lookups.sparkSession.sparkContext.defaultParallelism)
    ordered = lookups.select("key", "page_id").repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, index them, and read every page back through the index.

    page_id, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to.  A
    revisit's length is that of the response it refers to, fetched through the index.
    """
    spark: SparkSession = pages.sparkSession
    root = root or scratch(spark, "warc")
    captures = write_archives(pages, root)
    directory = build_index(captures, root)
    tasks = -(-captures.count() // READS_IN_TASK)
    lookups = pages.select(url_key(F.col("url")).alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"))
    records = written(fetch(lookups, root, directory, tasks), "records")
    revisits = records.where("record_type = 'revisit'")
    sources = revisits.select(F.col("refers_key").alias("key"), F.col("refers_to").alias("page_id")).distinct()
    # one page_id may stand for several payloads
    lengths = (
        fetch(sources, root, directory, tasks)
        .where("record_type = 'response'")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("payload_bytes").alias("length"))
    )
    missing = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.col("refers_to").cast("string"))).cast("long")
    full = (
        revisits.join(lengths, ["refers_to", "payload_digest"], "left")
        .withColumn("payload_bytes", F.coalesce("length", missing))
        .select(*records.columns)
    )
    page = F.when(F.col("page_id") != NO_ID, F.col("page_id")).alias("page_id")
    return records.where("record_type = 'response'").unionByName(full).select(page, "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= {LEAST_REVISIT}) AS top FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND top <> page_id THEN top END AS refers_to
FROM r
"""
