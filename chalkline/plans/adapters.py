"""Deterministic mappings from the star-schema tables to the library's inputs.

Each takes the tables of one folder and gives a table of the shape the operators read, so
that every operator runs over whole tables with results that follow from the columns.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder for files that a query writes and reads again, in the one named in ``spark.checkpoint.dir``.

    Where that is unset a local one will do on a local master only; a cluster has to name it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcripts; every third turn points at the board twice."""
    cue = F.when(F.col("turn") % 3 == 0, " now draw this diagram").otherwise("")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("lecture"), F.col("turn").alias("seq"), (F.col("turn") * 30.0).alias("start"),
        (F.col("turn") * 30.0 + 25.0).alias("end"), F.concat(F.coalesce("text", F.lit("")), cue).alias("text"),
    )


def lectures(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as lectures of a course (the customer), numbered by date."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("course"), F.col("o_orderkey").alias("lecture"), F.row_number().over(w).alias("lecture_num"),
        F.concat(F.lit("Series "), F.col("o_custkey"), F.lit(" - Part "), F.col("o_orderkey") % 7, F.lit(": "), F.col("o_orderpriority")).alias("title"),
        F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("upload_date"),
        F.when(F.col("o_orderstatus") == "F", "en").when(F.col("o_orderstatus") == "O", "la").alias("detected_language"),
    )


def section_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line item, of which a display of its section is made."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")  # noqa: E741
    # rows are narrow and the texts made of them are not: merged by their size they would make few tasks of too many rows
    l = l.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")  # noqa: E741
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") % 10).alias("course"), F.col("l_orderkey").alias("lecture"), "l_linenumber", "l_partkey"
    )


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """``(course, lecture, lecture_num, body)``: the displays of an order, in line order, each with a label and a reference to another display's.

    Numbers are gathered and the text is made of them afterwards.
    """
    text = lambda x: F.concat(
        F.lit("\\begin{equation}\n  x \\label{eq:"), F.col("lecture"), F.lit(":"), x["l_linenumber"],
        F.lit("}\n\\end{equation}\nSee \\cref{eq:"), x["l_partkey"], F.lit(":"), x["l_linenumber"], F.lit("}."),
    )
    rows = section_rows(spark, sf).groupBy("course", "lecture").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    return rows.select("course", "lecture", F.array_join(F.transform("items", text), "\n").alias("body"), F.col("lecture").alias("lecture_num"))


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """Events as tool calls of daily runs."""
    board = F.get_json_object("props", "$.k").cast("int")
    path = F.concat(F.lit('{"file_path": "/out/boards/board-'), F.lpad(board.cast("string"), 3, "0"), F.lit('.png"}'))
    return table(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyyMMdd")).alias("run"),
        F.when(F.col("user_id") % 2 == 0, "write").otherwise("verify").alias("role"), F.col("user_id").cast("string").alias("lecture"),
        F.col("event_id").alias("event_no"), F.col("ts").alias("t"), F.lit("tool").alias("kind"), F.col("event_type").alias("name"),
        F.when(board.isNotNull(), path).alias("input"), F.col("value").alias("seconds"), (F.col("event_type") == "error").alias("error"),
    )


def board_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Events as stretches of a board on screen: value minutes from ts on."""
    lo = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6
    return table(spark, sf, "events").select(
        F.col("user_id").alias("video"), F.col("event_id").alias("board"), lo.alias("lo"), (lo + F.coalesce("value", F.lit(0.0)) * 60).alias("hi")
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 8x8 frames of a video (the label)."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("video"), (F.row_number().over(w) - 1).alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("px")
    )


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as token usage of a model named after the part type."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")  # noqa: E741
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") % 10).alias("course"), F.col("l_orderkey").alias("lecture"), F.col("l_linenumber").alias("section"),
        F.concat_ws("-", F.lower("p_type"), "l_returnflag").alias("model"),
        F.col("l_quantity").cast("bigint").alias("input_tokens"), F.col("l_extendedprice").cast("bigint").alias("output_tokens"),
        (F.col("l_quantity").cast("bigint") * 2).alias("cache_read_tokens"), F.col("l_linenumber").cast("bigint").alias("cache_write_tokens"),
        F.concat(F.lit("note "), F.col("l_returnflag")).alias("note"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as versions of questions: the answer is null, empty or a text by event type."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("lecture"), F.get_json_object("props", "$.k").cast("int").alias("id"),
        F.when(F.col("event_id") % 2 == 0, "clarify").otherwise("ask").alias("kind"),
        F.concat(F.lit("text "), F.col("event_id")).alias("text"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("guess "), F.col("event_id") % 5)).alias("guess"),
        F.when(F.col("event_type") == "click", "").when(F.col("event_type") == "purchase", F.concat(F.lit("guess "), F.col("event_id") % 7)).alias("answer"),
        (F.col("event_type") == "error").alias("deferred"), (F.col("event_id") % 4 == 0).alias("delivered"), F.col("ts").alias("version"), F.col("event_id").alias("event_no"),
    )
