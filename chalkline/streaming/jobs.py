"""Structured Streaming jobs over append-only logs, questions and board intervals.

Each takes a streaming DataFrame and returns one; how it is started (trigger, sink,
checkpoint) is the caller's choice.  ``drain`` runs one to the end of its files.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from chalkline.functions.text import BOARD_FILE


def tail_json(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def run_summary(trace: DataFrame, late: str = "1 hour", idle: str = "12 hours") -> DataFrame:
    """Events, seconds, errors, boards opened and calls per tool of each run; a run closes when it has been idle for ``idle`` of trace time.

    Runs are session windows that the engine merges, so no run needs a call of its own.  The
    state of an open run is its sums, its distinct board numbers and the names of the tools
    it called, one a call.  A run that goes on after a longer break is a summary of its own;
    a late row counts as long as its run may be open.
    """
    board = F.nullif(F.regexp_extract(F.get_json_object("input", "$.file_path"), BOARD_FILE, 1), F.lit("")).cast("int")
    rows = trace.where("t IS NOT NULL").withWatermark("t", late).select("run", "t", "name", F.when(~F.isnan("seconds"), F.col("seconds")).alias("seconds"), "error", board.alias("board"))
    out = rows.groupBy("run", F.session_window("t", idle)).agg(
        F.min("t").alias("start"), F.max("t").alias("stop"), F.count(F.lit(1)).alias("events"), F.sum("seconds").alias("seconds"), F.count_if("error").alias("errors"),
        F.size(F.collect_set("board")).alias("boards"), F.array_sort(F.collect_list("name")).alias("names"),
    )
    # equal names stand together: where each begins, and how far it is to the next one
    begins = F.filter(F.sequence(F.lit(0), F.size("names")), lambda i: (i == F.size("names")) | (i == 0) | (F.get("names", i) != F.get("names", i - 1)))
    calls = F.zip_with(F.slice("begins", 1, F.size("begins") - 1), F.slice("begins", 2, F.size("begins")), lambda i, j: F.struct(F.get("names", i).alias("key"), (j - i).cast("bigint").alias("value")))
    return out.withColumn("begins", begins).select("run", "start", "stop", "events", "seconds", "errors", "boards", F.map_from_entries(calls).alias("tools"))


def board_sessions(intervals: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Stretches of a board on screen merged into sessions; events exactly one gap apart merge."""
    return intervals.withWatermark("t", late).groupBy("video", F.session_window("t", gap)).agg(F.count(F.lit(1)).alias("n"))


def tool_activity(trace: DataFrame, size: str = "1 hour", slide: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Calls and errors per role in sliding windows of trace time (tumbling where ``slide`` equals ``size``)."""
    w = F.window("t", size, slide)
    return trace.withWatermark("t", late).groupBy("role", w).agg(F.count(F.lit(1)).alias("calls"), F.count_if("error").alias("errors"))


def question_states(questions: DataFrame) -> DataFrame:
    """The changing state of each question ``(lecture, id, seq, answer, delivered, applied)``; the last update of a key counts.

    The first non-null answer stays, ``delivered`` only turns true, an answer that comes
    after delivery is delivered again exactly once, and an answer counts as applied from the
    first update on that says so and finds an answer.  All of it follows from where in the
    order of ``seq`` these come first or last, so the state of a question is a few numbers
    that the engine merges, and no question needs a call of its own.  Run it in update mode.
    """
    first = F.min_by(F.struct("answer", "seq"), F.when(F.col("answer").isNotNull(), F.col("seq")))
    told, done = (f(F.when(F.col(c), F.col("seq"))) for f, c in ((F.min, "delivered"), (F.max, "applied")))
    out = questions.groupBy("lecture", "id").agg(first.alias("f"), told.alias("told"), done.alias("done"), F.count(F.lit(1)).alias("updates"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        "lecture", "id", F.col("f.answer").alias("answer"), F.col("told").isNotNull().alias("delivered"), yes(F.col("told") < F.col("f.seq")).alias("redelivered"),
        yes(F.col("done") >= F.col("f.seq")).alias("applied"), "updates",
    )


def question_states_batch(questions: DataFrame) -> DataFrame:
    """The batch twin of :func:`question_states`."""
    w = Window.partitionBy("lecture", "id").orderBy("seq")
    rows = questions.withColumn("told", F.coalesce(F.max(F.col("delivered").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.min_by(F.struct("answer", "told", "seq"), F.when(F.col("answer").isNotNull(), F.col("seq")))
    out = rows.groupBy("lecture", "id").agg(
        first.alias("f"), F.bool_or("delivered").alias("delivered"), F.max(F.when(F.col("applied"), F.col("seq"))).alias("done"), F.count(F.lit(1)).alias("updates")
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        "lecture", "id", F.col("f.answer").alias("answer"), "delivered", yes(F.col("f.told") == 1).alias("redelivered"), yes(F.col("done") >= F.col("f.seq")).alias("applied"), "updates"
    )


def drain(df: DataFrame, path: str, mode: str = "append") -> str:
    """Run a stream to the end of what is there, into Parquet under ``path``; returns the data's path.

    In update mode a batch has a folder of its own and replaces it.
    """
    if mode == "update":
        add = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        df.writeStream.outputMode(mode).foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return f"{path}/data"
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{path}/data"


class LateRows(StreamingQueryListener):
    """Adds up, for each run of a query, the rows that came behind the watermark and were dropped.

    A query itself remembers its last batches only.  Listen before it starts:
    ``spark.streams.addListener(late)``.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped[str(event.runId)] = 0
        self.ended[str(event.runId)] = threading.Event()

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.dropped[run] = self.dropped.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()

    def count(self, query: StreamingQuery, wait: float = 60.0) -> int:
        """Rows dropped so far; of a query that has ended all of them (progress is told a little later)."""
        run = str(query.runId)
        if not query.isActive and run in self.ended:
            self.ended[run].wait(wait)
        return self.dropped.get(run, 0)


KEY_BUCKETS = 256


def ingest(source: DataFrame, path: str, key: str = "lecture") -> None:
    """Process files not seen before, resumable: each micro-batch adds the rows whose ``key`` no earlier batch brought.

    A batch has a folder of its own under ``path`` and replaces it, so one that is run
    again after a failure leaves nothing twice.  Of rows with one key in a batch one stays;
    rows without a key are never the same and all stay.  Keys are kept in hash buckets, and
    a batch reads those of its own keys only.
    """
    spark = source.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")
    known = T.StructType([source.schema[key], T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    spark.createDataFrame([], known).drop("batch").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys/batch=-1")  # so that there is a table to read
    spark.createDataFrame([], source.schema).write.mode("overwrite").parquet(f"{path}/data/batch=-1")

    def add(batch: DataFrame, number: int) -> None:
        own = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        asked = [r.bucket for r in own.select(bucket.alias("bucket")).distinct().collect()]
        before = batch.sparkSession.read.schema(known).parquet(f"{path}/keys").where(F.col("bucket").isin(asked) & (F.col("batch") < number)).select(key)
        new = own.join(before, key, "left_anti").select(*source.columns).unionByName(batch.where(F.col(key).isNull()))
        new.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        added = batch.sparkSession.read.schema(source.schema).parquet(f"{path}/data/batch={number}").where(F.col(key).isNotNull())
        added.select(key, bucket.alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys/batch={number}")

    q = source.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
