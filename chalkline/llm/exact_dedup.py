"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest.  A batch of new documents is
reduced to one row per digest (map-side partial aggregation, so a text that holds a
third of all rows is one row per task before the shuffle), sort-merge anti-joined with
the index, and what is new is appended.  Only digests and ids are shuffled, never texts.

Defined results: null text counts as empty; texts are equal when identical after
lower-casing A-Z; of equal texts the row with the largest ``doc_id`` stays (null ids
lose; of rows repeated with one id exactly one stays); an empty table gives no rows;
columns beyond ``doc_id`` and ``text`` are ignored here whatever their names.  A batch has
an id from the caller; the same batch run again, after a failure or not, gives the same
result, whether its digests are in the index not at all, in part or in full.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm.common import ascii_lower, numbered, scratch, written


#: Digests per bucket that a new index is laid out for, and the least number of buckets.
BUCKET_DIGESTS, LEAST_BUCKETS = 4_000_000, 32


class DigestIndex:
    """A bucketed, sorted Parquet table ``(digest, keep_id, batch)`` at ``path``.

    Opening a path that already holds an index continues it: bucket numbers are in the
    file names and their count lies beside the table, so no catalogue has to survive
    between sessions.  A new index is laid out for ``expected`` digests; when a corpus has
    outgrown that, :meth:`copied` lays it out anew.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, expected: int = 0):
        self.spark = spark
        self.path = path or scratch(spark, "digest-index")
        self.buckets = self._layout() if path else None
        if self.buckets is None:
            self.buckets = max(LEAST_BUCKETS, -(-expected // BUCKET_DIGESTS))
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.json(f"{self.path}-layout")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _layout(self) -> int | None:
        try:
            return self.spark.read.schema("buckets int").json(f"{self.path}-layout").first().buckets
        except AnalysisException:  # nothing there yet
            return None

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the digests of ``groups (digest, keep_id)`` that the index doesn't hold."""
        known = self.rows().select("digest")
        self._append(groups.join(known.hint("merge"), "digest", "left_anti").select("digest", "keep_id", F.lit(batch).alias("batch")))

    def copied(self, path: str, expected: int) -> DigestIndex:
        """The same index at another path, laid out for ``expected`` digests."""
        other = DigestIndex(self.spark, path, expected)
        other._append(self.rows())
        return other

    def _append(self, rows: DataFrame) -> None:
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def _decided(docs: DataFrame, row: Column, index: DigestIndex | None, batch: str | None) -> DataFrame:
    """``(row, doc_id, digest, keep_id, group_size, kept)`` for every row of ``docs``."""
    if index is not None and batch is None:
        raise ValueError("a batch for a given index needs an id, the same one whenever it is run again")
    digests = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"),
            F.unhex(F.sha2(ascii_lower(F.col("text")).cast("binary"), 256)).alias("digest"),
        ),
        "digests",
    )
    index = index or DigestIndex(docs.sparkSession, expected=digests.count())
    batch = batch or uuid.uuid4().hex
    groups = written(digests.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    index.add(groups.select("digest", F.col("top.doc_id").alias("keep_id")), batch)
    # the index says which batch brought a text; of this batch's own texts the group says which row stays
    sizes = groups.join(index.rows(), "digest").select("digest", "group_size", "keep_id", F.when(F.col("batch") == batch, F.col("top.row")).alias("stays"))
    kept = F.coalesce(F.col("row") == F.col("stays"), F.lit(False))
    return digests.join(sizes, "digest").select("row", "doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``group_size`` counts the rows of this batch with the same text.  A text that an
    earlier batch brought keeps that batch's ``keep_id`` and no row of this one.  ``batch``
    names the batch where an ``index`` is given.
    """
    decided = _decided(docs, F.monotonically_increasing_id(), index, batch)
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_documents(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns whatever their names.

    Rows are told apart by a number from a written table, so of rows repeated with one id
    and text exactly one stays.  Only numbers of dropped rows meet the texts.
    """
    rows, row = numbered(docs)
    dropped = _decided(rows, F.col(row), index, batch).where("NOT kept").select(F.col("row").alias(row))
    return rows.join(dropped, row, "left_anti").select(*(rows[c] for c in docs.columns))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

#: English documents as a first batch, then all documents against the index that it left.
SECOND_BATCH_SQL = """
WITH d AS (
  SELECT doc_id, lang, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents),
f AS (SELECT h, max(doc_id) AS first_id FROM d WHERE lang = 'en' GROUP BY h)
SELECT doc_id, coalesce(first_id, max(doc_id) OVER (PARTITION BY h)) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       first_id IS NULL AND doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d LEFT JOIN f USING (h)
"""
