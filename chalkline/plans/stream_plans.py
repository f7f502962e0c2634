"""Queries of the streaming jobs: a real stream over files written from the columns, drained and read back.

Append mode gives a window only once the watermark has passed it, so each source ends with
one event far in the future that closes the windows before it and stays open itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.plans import adapters as A
from chalkline.plans.catalog import query
from chalkline.streaming import jobs as S

TRACE = "run string, role string, t timestamp, name string, input string, seconds double, error boolean"
SLICES, FILES = 4, 2


def _in_time_order(df, path):
    """Write rows with a time ``t`` as slices of time, one after another, so that a stream that reads ``FILES`` files a trigger meets them in order."""
    low, high = df.select(F.min(F.unix_micros("t")), F.max(F.unix_micros("t"))).first()
    if low is None:
        return
    at = F.floor((F.unix_micros("t") - low) * SLICES / (high - low + 1))
    for k in range(SLICES):
        df.where(at == k).repartition(FILES).write.mode("append").json(path)


def _trace_files(spark, sf):
    path = A.folder(spark, "stream-trace")
    t = A.trace(spark, sf).select("run", "role", F.col("t").cast("timestamp").alias("t"), "name", "input", "seconds", "error")
    _in_time_order(t, path)
    last = spark.createDataFrame([("closing", "closing", "2100-01-01 00:00:00", 0.0, False)], "run string, role string, t string, seconds double, error boolean")
    last.withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").json(path)
    return path


@query("stream_run_summary", """WITH e AS (SELECT *, user_id || '-' || strftime(ts, '%Y%m%d') AS run FROM events),
t AS (SELECT run, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS tools FROM (SELECT run, event_type, count(*) AS n FROM e GROUP BY ALL) GROUP BY run)
SELECT run, count(*) AS events, round(sum(value), 2) AS seconds, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT (props::JSON->>'$.k')::INTEGER)::INTEGER AS boards, any_value(tools) AS tools
FROM e JOIN t USING (run) GROUP BY run""")
def stream_run_summary(spark, sf):
    trace = S.tail_json(spark, _trace_files(spark, sf), TRACE, FILES)
    out = spark.read.parquet(S.drain(S.run_summary(trace, idle="30 hours"), A.folder(spark, "stream-runs")))
    tools = F.array_join(F.transform(F.map_entries("tools"), lambda x: F.concat(x["key"], F.lit(":"), x["value"])), ",").alias("tools")
    return out.where("run <> 'closing'").select("run", "events", F.round("seconds", 2).alias("seconds"), "errors", "boards", tools)


@query("tool_activity", """SELECT CASE WHEN user_id % 2 = 0 THEN 'write' ELSE 'verify' END AS role, epoch(time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE)::BIGINT AS start, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors
FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL""")
def tool_activity(spark, sf):
    trace = S.tail_json(spark, _trace_files(spark, sf), TRACE, FILES)
    out = spark.read.parquet(S.drain(S.tool_activity(trace), A.folder(spark, "stream-tools")))
    return out.where("role <> 'closing'").select("role", F.unix_seconds("window.start").alias("start"), "calls", "errors")


@query("board_sessions", """WITH e AS (SELECT user_id AS video, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events),
g AS (SELECT *, sum(opens) OVER (PARTITION BY video ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT video, epoch_us(min(ts)) // 1000000 AS lo, count(*) AS n FROM g GROUP BY video, s""")
def board_sessions(spark, sf):
    path = A.folder(spark, "stream-boards")
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("video"), F.col("ts").cast("timestamp").alias("t"))
    _in_time_order(e, path)
    spark.createDataFrame([(-1, "2100-01-01 00:00:00")], "video bigint, t string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").json(path)
    stream = S.tail_json(spark, path, "video bigint, t timestamp", FILES)
    out = spark.read.parquet(S.drain(S.board_sessions(stream, "2 hours"), A.folder(spark, "stream-sessions")))
    return out.where("video >= 0").select("video", F.floor(F.unix_millis("session_window.start") / 1000).alias("lo"), "n")


STATES = """WITH q AS (SELECT user_id AS lecture, (props::JSON->>'$.k')::INTEGER AS id, event_id AS seq, CASE WHEN event_type = 'click' THEN '' WHEN event_type = 'purchase' THEN 'guess ' || event_id % 7 END AS answer, event_id % 4 = 0 AS delivered, event_id % 5 = 0 AS applied FROM events),
f AS (SELECT lecture, id, min(seq) FILTER (WHERE answer IS NOT NULL) AS at, arg_min(answer, seq) FILTER (WHERE answer IS NOT NULL) AS answer, bool_or(delivered) AS delivered, max(seq) FILTER (WHERE applied) AS done, count(*) AS updates FROM q GROUP BY ALL)
SELECT lecture, id, answer, delivered, EXISTS (SELECT 1 FROM q WHERE q.lecture = f.lecture AND q.id = f.id AND q.delivered AND q.seq < f.at) AS redelivered, coalesce(f.done >= f.at, false) AS applied, updates FROM f"""


def _questions(spark, sf):
    return A.questions(spark, sf).select("lecture", "id", F.col("event_no").alias("seq"), "answer", "delivered", (F.col("event_no") % 5 == 0).alias("applied"))


@query("question_state", STATES)
def question_state(spark, sf):
    return S.question_states_batch(_questions(spark, sf))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("stream_questions", STATES)
def stream_questions(spark, sf):
    path = A.folder(spark, "stream-questions")
    _in_time_order(_questions(spark, sf).withColumn("t", F.timestamp_seconds("seq")), path)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)  # states lie on disk, not on the heap
    try:
        stream = S.tail_json(spark, path, "lecture bigint, id int, seq bigint, answer string, delivered boolean, applied boolean", FILES)
        out = spark.read.parquet(S.drain(S.question_states(stream), A.folder(spark, "stream-states"), "update"))
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    last = F.max_by(F.struct("answer", "delivered", "redelivered", "applied", "updates"), "updates").alias("s")
    return out.groupBy("lecture", "id").agg(last).select("lecture", "id", "s.*")


@query("stream_ingest", "SELECT o_orderkey AS lecture, o_custkey AS course FROM orders")
def stream_ingest(spark, sf):
    """Two runs over files that hold two thirds of the orders each: the second adds what the first didn't bring."""
    path, out = A.folder(spark, "stream-inputs"), A.folder(spark, "stream-ingest")
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("lecture"), F.col("o_custkey").alias("course"))
    source = lambda: S.tail_json(spark, path, "lecture bigint, course bigint", 2)
    for left_out in (0, 1):
        o.where(F.col("lecture") % 3 != left_out).repartition(4).write.mode("append").json(path)
        S.ingest(source(), out)
    return spark.read.schema("lecture bigint, course bigint").parquet(f"{out}/data").select("lecture", "course")
