"""Shared helpers: the scratch folder all executors see, and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, a temporary one on a local master, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Scratch folders of the step at hand, where one keeps count of them.
_held: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name for one run, inside the shared folder."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _held.append(path)
    return path


def _remove(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def only_last(spark: SparkSession) -> Iterator[None]:
    """Of the scratch tables written inside, only the last one stays."""
    mark = len(_held)
    yield
    _remove(spark, _held[mark:-1])
    del _held[mark:-1]


def forget() -> None:
    """Begin a job of several steps: scratch folders made before are no longer counted among its own."""
    _held.clear()


def release(spark: SparkSession) -> None:
    """Remove the scratch folders of the step before, whose result is written elsewhere by now."""
    _remove(spark, _held)
    _held.clear()


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_arrow_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches small enough that very long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for what is executed inside; the caller's setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores appended until none of ``columns`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for every row, written, so that it is the same whenever it is read; and that column's name."""
    row = unused(docs.columns, "_row")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
