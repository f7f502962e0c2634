"""Sinks: nested documents, partitioned outputs, append-only logs and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_transcripts(segments: DataFrame, lectures: DataFrame, path: str) -> None:
    """Ordered nested documents from flat segments; times keep three decimals, the metadata gets the segment count."""
    item = F.struct("seq", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")
    nested = segments.groupBy("lecture").agg(F.sort_array(F.collect_list(item)).alias("s"))
    plain = F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    docs = nested.select("lecture", plain.alias("segments"), F.size("s").alias("n")).join(lectures, "lecture", "left")
    meta = F.struct("title", "uploader", "detected_language", F.col("n").alias("segment_count"))
    docs.select("lecture", meta.alias("metadata"), "segments").write.json(path)


def write_boards(boards: DataFrame, path: str) -> None:
    """Boards, one a line that names its video; a video's boards stand together and in order.

    Files follow the size of the data, not the number of videos: a folder per video would
    be a file per video and task, each to be listed and opened again.
    """
    boards.hint("rebalance", "video").sortWithinPartitions("video", "lo").write.json(path)


def write_board_documents(boards: DataFrame, summary: DataFrame, path: str) -> None:
    """One document per video: the segmentation's figures of ``summary (video, ...)`` and its ordered ``boards``."""
    items = boards.groupBy("video").agg(F.sort_array(F.collect_list(F.struct(*(c for c in boards.columns if c != "video")))).alias("boards"))
    summary.join(items, "video", "left").withColumn("boards", F.coalesce("boards", F.array())).write.partitionBy("video").json(path)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def named_files(sections: DataFrame) -> DataFrame:
    """Adds ``file``, ``NN-<slug>``; slugs that collide within a course are told apart by ``-b`` repeated."""
    number = F.col("lecture_num").cast("string")
    base = F.concat(F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number), F.lit("-"), F.col("slug"))
    rank = F.row_number().over(Window.partitionBy("course", "_base").orderBy("lecture_num", "lecture")) - 1
    named = sections.withColumn("_base", base).withColumn("_r", rank)
    return named.withColumn("file", F.concat("_base", F.expr("repeat('-b', _r)"))).drop("_base", "_r")


def manifest(named: DataFrame) -> DataFrame:
    """The ordered files of each course."""
    order = F.sort_array(F.collect_list(F.struct("lecture_num", "file")))
    return named.groupBy("course").agg(F.transform(order, lambda x: x["file"]).alias("files"))


def export_course(sections: DataFrame, path: str) -> DataFrame:
    """One text file per lecture (``course, lecture, lecture_num, slug, body``); returns the manifest."""
    named = named_files(sections)
    named.select("course", "file", F.col("body").alias("value")).repartition("course", "file").write.partitionBy("course", "file").text(path)
    return manifest(named)


def write_bib(entries: DataFrame, path: str) -> None:
    """Entries in order, one folder per course, each after its ``% source:`` marker; one without a source has none."""
    marker = F.when(F.col("source_key").isNotNull(), F.concat(F.lit("% source: "), "source_key", F.lit("\n"))).otherwise("")
    text = F.concat(marker, F.col("entry"), F.lit("\n"))
    entries.select("course", "pos", text.alias("value")).repartition("course").sortWithinPartitions("course", "pos").drop("pos").write.partitionBy("course").text(path)


def upsert_sections(state: DataFrame, incoming: DataFrame, on_disk: DataFrame) -> DataFrame:
    """New snapshot of ``(lecture, body)``: a non-blank body on disk wins, then the incoming, then the state's."""
    s, i, d = (x.select("lecture", F.col("body").alias(n)) for x, n in ((state, "s"), (incoming, "i"), (on_disk, "d")))
    disk = F.when(F.trim("d") != "", F.col("d"))
    return s.join(i, "lecture", "full_outer").join(d, "lecture", "left").select("lecture", F.coalesce(disk, "i", "s").alias("body"))
