"""Queries of the join, window and planning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.operators import joins as J
from chalkline.plans import adapters as A
from chalkline.plans.catalog import query

CLOCK = "lpad(({0} // 3600)::VARCHAR, 2, '0') || ':' || lpad(({0} % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({0} % 60)::VARCHAR, 2, '0')"
BOARD = "(props::JSON->>'$.k')::INTEGER"


def _marks(spark, sf):
    lectures = A.table(spark, sf, "conversations").select("conv_id").distinct()
    k = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return lectures.select(F.col("conv_id").cast("string").alias("lecture"), k.alias("n")).select("lecture", "n", (F.col("n") * 45.0).alias("at"), F.concat(F.lit("-- board "), "n").alias("mark"))


@query("transcript_interleave", f"""WITH r AS (SELECT conv_id::VARCHAR AS lecture, turn * 30.0 AS key, 1 AS kind, turn AS n, '[' || {CLOCK.format('(turn * 30)')} || '] ' || coalesce(text, '') || CASE WHEN turn % 3 = 0 THEN ' now draw this diagram' ELSE '' END AS line FROM conversations
UNION ALL SELECT conv_id::VARCHAR, k * 45.0, 0, k, '-- board ' || k FROM (SELECT DISTINCT conv_id FROM conversations), range(5) t(k))
SELECT lecture, (row_number() OVER (PARTITION BY lecture ORDER BY key, kind, n))::INTEGER AS pos, line FROM r""")
def transcript_interleave(spark, sf):
    return J.interleave(A.segments(spark, sf), _marks(spark, sf))


@query("board_at_segment", "SELECT conv_id::VARCHAR AS lecture, turn AS seq, least(turn * 30 // 45, 4)::BIGINT AS board FROM conversations")
def board_at_segment(spark, sf):
    return J.board_at_segment(A.segments(spark, sf), _marks(spark, sf).select("lecture", F.col("at").alias("lo"), F.col("n").alias("board")))


@query("boards_on_screen", """WITH i AS (SELECT user_id AS video, event_id AS board, epoch_us(ts) / 1e6 AS lo, epoch_us(ts) / 1e6 + coalesce(value, 0) * 60 AS hi FROM events)
SELECT p.video, p.board AS at_event, count(*) AS boards, min(i.board) AS oldest FROM i p JOIN i ON p.video = i.video AND i.lo <= p.lo AND p.lo < i.hi GROUP BY ALL""")
def boards_on_screen(spark, sf):
    i = A.board_intervals(spark, sf)
    p = i.select("video", F.col("lo").alias("t"), F.col("board").alias("at_event"))
    return J.boards_on_screen(p, i).groupBy("video", "at_event").agg(F.count(F.lit(1)).alias("boards"), F.min("board").alias("oldest"))


def _quotes(spark, sf):
    return A.table(spark, sf, "benchmark").select(F.col("item_id").alias("quote"), "text")


def _lines(spark, sf):
    d = A.table(spark, sf, "documents").select(F.col("doc_id").alias("lecture"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "text"))
    return d.withColumn("start", F.col("seq") * 30.0)


@query("locate_quotes", """WITH l AS (SELECT doc_id AS lecture, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS seq FROM documents),
x AS (SELECT lecture, seq, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(lower(line), '[a-z0-9]+'), 1) AS i FROM l),
s AS (SELECT lecture, seq, row_number() OVER p AS pos, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4, lead(w, 4) OVER p AS w5, lead(w, 5) OVER p AS w6, lead(w, 6) OVER p AS w7, lead(w, 7) OVER p AS w8 FROM x WINDOW p AS (PARTITION BY lecture ORDER BY seq, i)),
q AS (SELECT item_id AS quote, regexp_extract_all(lower(text), '[a-z0-9]+') AS q FROM benchmark),
h AS (SELECT quote, lecture, pos, seq * 30.0::DOUBLE AS start, CASE WHEN [w4, w5, w6, w7, w8] = q[4:8] THEN 8 WHEN [w4, w5, w6, w7] = q[4:7] THEN 7 WHEN [w4, w5, w6] = q[4:6] THEN 6 WHEN [w4, w5] = q[4:5] THEN 5 WHEN w4 = q[4] THEN 4 ELSE 3 END AS n FROM s JOIN q ON w1 = q[1] AND w2 = q[2] AND w3 = q[3])
SELECT quote, lecture, n::INTEGER AS n, pos::INTEGER AS pos, start FROM h QUALIFY row_number() OVER (PARTITION BY quote, lecture ORDER BY n DESC, pos) = 1""")
def locate_quotes(spark, sf):
    return J.locate_quotes(_quotes(spark, sf), _lines(spark, sf))


@query("correct_timestamps", f"""WITH q AS (SELECT o_custkey AS lecture, o_orderkey AS id, o_orderkey % 4 AS k, (o_orderkey % 3600)::BIGINT AS s FROM orders)
SELECT lecture, id, CASE WHEN k = 3 THEN {CLOCK.format('s')} WHEN k = 0 THEN {CLOCK.format('s')} WHEN k = 1 THEN {CLOCK.format('s')} ELSE {CLOCK.format('(s + 30)')} END AS stamp,
k = 0 AS corrected, CASE WHEN k = 1 THEN false WHEN k = 3 THEN s > 3001 WHEN k = 0 THEN s + 3600 > 3001 ELSE s + 30 > 3001 END AS past_end FROM q""")
def correct_timestamps(spark, sf):
    """k = 0: an hour off; 1: no stated time; 2: half a minute off; 3: nothing located."""
    o = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("lecture"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("k"), (F.col("o_orderkey") % 3600).alias("s"))
    stated = F.when(F.col("k") == 0, F.concat(F.lit("["), F.col("s") + 3600, F.lit("]"))).when(F.col("k") == 2, (F.col("s") + 30).cast("string")).when(F.col("k") == 3, F.concat(F.floor(F.col("s") / 60), F.lit(":"), F.col("s") % 60))
    located = o.where("k < 3").select("lecture", "id", F.col("s").cast("double").alias("start"))
    return J.correct_timestamps(o.withColumn("stated", stated), located, o.select("lecture", F.lit(3000.0).alias("duration")).distinct())


@query("verify_originals", "SELECT doc_id AS source, doc_id % 3 <> 0 AS verified, CASE WHEN doc_id % 3 = 0 THEN 'not in the source' END AS note FROM documents")
def verify_originals(spark, sf):
    d = A.table(spark, sf, "documents").select(F.col("doc_id").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    # a passage from anywhere in the text, by a hash of its id
    at = F.pmod(F.xxhash64("source"), F.greatest(F.length("text") - 200, F.lit(1))).cast("int") + 1
    cut = F.regexp_replace(F.trim(F.substring("text", at, F.lit(200))), " ", "\n  ")
    return J.verify_originals(d.select("source", F.when(F.col("source") % 3 == 0, F.concat(cut, F.lit("☃"))).otherwise(cut).alias("original")), d).select("source", "verified", "note")


@query("ingest_plan", """SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 0 THEN '/in/' || o_orderkey || '.mov' ELSE 'https://x/' || o_orderkey END AS source, CASE o_orderkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'resume' ELSE 'new' END AS state,
CASE WHEN o_orderkey % 4 = 0 THEN 'video.mp4' WHEN o_orderkey % 4 = 1 THEN 'video.webm' WHEN o_orderkey % 5 = 0 THEN '/in/' || o_orderkey || '.mov' END AS video FROM orders""")
def ingest_plan(spark, sf):
    k = F.col("lecture")
    source = F.when(k % 5 == 0, F.concat(F.lit("/in/"), k, F.lit(".mov"))).otherwise(F.concat(F.lit("https://x/"), k))
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("lecture")).withColumn("source", source)
    names = F.array_compact(F.array(F.when(k % 3 == 0, "transcript.json"), F.when(k % 3 < 2, "audio.wav"), F.when(k % 4 < 2, "video.webm"), F.when(k % 4 == 0, "video.mp4")))
    return J.ingest_plan(o.select(k.alias("pos"), "source"), o, o.select("lecture", F.explode(names).alias("name")))


@query("unread_boards", f"""SELECT user_id::VARCHAR AS lecture, b AS id FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0 AND {BOARD} IS NOT NULL), (SELECT unnest(range(0, 110))::INTEGER AS b)
EXCEPT SELECT user_id::VARCHAR, {BOARD} FROM events""")
def unread_boards(spark, sf):
    users = A.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("lecture")).distinct()
    return J.unread_boards(users.select("lecture", F.explode(F.sequence(F.lit(0), F.lit(109))).alias("id")), A.trace(spark, sf)).select("lecture", "id")


NUM = "(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INTEGER"


@query("propagation_plan", f"""WITH s AS (SELECT o_custkey AS course, {NUM} AS lecture_num, o_orderkey, o_orderstatus FROM orders)
SELECT a.course, a.lecture_num, list('change ' || b.o_orderkey ORDER BY b.lecture_num) AS changes FROM s a JOIN s b ON a.course = b.course AND b.lecture_num < a.lecture_num AND b.o_orderstatus = 'P' GROUP BY ALL""")
def propagation_plan(spark, sf):
    s = A.lectures(spark, sf)
    r = s.where("detected_language IS NULL").select("course", "lecture_num", F.concat(F.lit("change "), "lecture").alias("change"))
    return J.propagation_plan(r, s)


@query("prior_context", f"""WITH s AS (SELECT o_custkey AS course, {NUM} AS lecture_num, o_orderkey AS l FROM orders)
SELECT a.course, a.lecture_num AS k, b.lecture_num, CASE WHEN a.lecture_num - b.lecture_num <= 2 OR b.l % 3 = 0 THEN 'full' ELSE 'summary' END AS form,
CASE WHEN a.lecture_num - b.lecture_num <= 2 OR b.l % 3 = 0 THEN 'body ' || b.l ELSE 'sum ' || b.l END AS text FROM s a JOIN s b ON a.course = b.course AND b.lecture_num < a.lecture_num""")
def prior_context(spark, sf):
    s = A.lectures(spark, sf)
    return J.prior_context(s.select("course", "lecture_num", F.concat(F.lit("body "), "lecture").alias("body"), F.when(F.col("lecture") % 3 > 0, F.concat(F.lit("sum "), "lecture")).alias("summary")))


@query("order_mismatch", f"SELECT * FROM (SELECT o_custkey AS course, o_orderkey AS lecture, (o_orderkey % 5)::INTEGER AS pos, {NUM} AS lecture_num FROM orders) WHERE pos <> lecture_num")
def order_mismatch(spark, sf):
    s = A.lectures(spark, sf).select("course", "lecture", "lecture_num")
    return J.order_mismatch(s.select("course", "lecture", (F.col("lecture") % 5).cast("int").alias("pos")), s)


@query("other_lectures", f"""WITH s AS (SELECT o_custkey AS course, {NUM} AS lecture_num, o_orderkey AS l FROM orders)
SELECT a.course, a.lecture_num, list('Lecture ' || b.lecture_num || ': On ' || b.l ORDER BY b.lecture_num) FILTER (WHERE a.lecture_num <> b.lecture_num) AS others FROM s a JOIN s b USING (course) GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT course, lecture_num, [] FROM s QUALIFY count(*) OVER (PARTITION BY course) = 1""")
def other_lectures(spark, sf):
    s = A.lectures(spark, sf)
    return J.other_lectures(s.select("course", "lecture_num", F.concat(F.lit("Lecture "), "lecture_num", F.lit(" - On "), "lecture").alias("title")))


@query("merge_intervals", """WITH i AS (SELECT user_id AS video, epoch_us(ts) / 1e6 AS lo, epoch_us(ts) / 1e6 + coalesce(value, 0) * 60 AS hi FROM events),
b AS (SELECT *, max(hi) OVER (PARTITION BY video ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR lo - before > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT video, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY video, island""")
def merge_intervals(spark, sf):
    return J.merge_intervals(A.board_intervals(spark, sf), 600.0)


@query("renumber_boards", f"""WITH t AS (SELECT user_id AS video, {BOARD} AS old_id, sum(event_id % 50 * 1.0::DOUBLE) AS seconds, count(*) - 1 AS revisits, min(event_id) AS first FROM events GROUP BY ALL)
SELECT video, old_id, (row_number() OVER (PARTITION BY video ORDER BY first, old_id))::INTEGER AS id, seconds, revisits FROM t WHERE seconds >= 20""")
def renumber_boards(spark, sf):
    e = A.table(spark, sf, "events")
    lo = F.col("event_id").cast("double")
    return J.renumber_boards(e.select(F.col("user_id").alias("video"), F.get_json_object("props", "$.k").cast("int").alias("id"), lo.alias("lo"), (lo + F.col("event_id") % 50).alias("hi")))


@query("unique_names", """SELECT o_custkey AS grp, o_orderkey AS pos, o_orderpriority || CASE WHEN row_number() OVER w > 1 THEN '-' || row_number() OVER w ELSE '' END AS "unique" FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey)""")
def unique_names(spark, sf):
    return J.unique_names(A.table(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("name"))).select("grp", "pos", "unique")


@query("unique_folders", """WITH x AS (SELECT o_custkey AS grp, o_orderkey AS pos, lower(o_orderstatus) AS slug, 'https://x/' || o_orderkey % 3 AS source FROM orders)
SELECT grp, pos, CASE WHEN source <> first_value(source) OVER (PARTITION BY grp, slug ORDER BY pos) THEN slug || '-' || left(sha1(source), 8) ELSE slug END AS folder FROM x""")
def unique_folders(spark, sf):
    k = F.col("o_orderkey")
    o = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), k.alias("pos"), F.lower("o_orderstatus").alias("slug"), F.concat(F.lit("https://x/"), k % 3).alias("source"))
    return J.unique_folders(o).select("grp", "pos", "folder")


@query("available_prefix", f"""WITH s AS (SELECT o_custkey AS course, {NUM} AS pos, o_orderkey % 4 > 0 AS ready FROM orders), t AS (SELECT *, min(CASE WHEN NOT ready THEN pos END) OVER (PARTITION BY course) AS stop FROM s)
SELECT course, count(*) FILTER (WHERE stop IS NULL OR pos < stop) AS prefix, count(*) FILTER (WHERE ready AND pos > stop) AS held FROM t GROUP BY course""")
def available_prefix(spark, sf):
    return J.available_prefix(A.lectures(spark, sf).select("course", F.col("lecture_num").alias("pos"), (F.col("lecture") % 4 > 0).alias("ready")))


@query("context_search", """WITH l AS (SELECT doc_id AS file, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
h AS (SELECT file, line_no FROM l WHERE regexp_matches(line, '(?i)licen[sc]e|idiot') ORDER BY file, line_no LIMIT 30)
SELECT l.file, l.line_no::INTEGER AS line_no, l.line, bool_or(l.line_no = h.line_no) AS is_hit FROM l JOIN h ON l.file = h.file AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 GROUP BY ALL""")
def context_search(spark, sf):
    l = _lines(spark, sf).select(F.col("lecture").alias("file"), (F.col("seq") + 1).alias("line_no"), F.col("text").alias("line"))  # noqa: E741
    return J.context_search(l, "licen[sc]e|idiot")


@query("topk_candidates", """SELECT l_suppkey AS video, l_orderkey AS i, l_partkey AS board, l_discount * 10 AS score, (row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_discount DESC, l_partkey))::INTEGER AS rank
FROM (SELECT l_suppkey % 3 AS l_suppkey, l_orderkey % 200 AS l_orderkey, l_partkey, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL) WHERE l_discount * 10 >= 0.45 QUALIFY rank <= 3""")
def topk_candidates(spark, sf):
    l = A.table(spark, sf, "lineitem")  # noqa: E741
    s = l.groupBy((F.col("l_suppkey") % 3).alias("video"), (F.col("l_orderkey") % 200).alias("i"), F.col("l_partkey").alias("board")).agg((F.max("l_discount") * 10).alias("score"))
    return J.topk_candidates(s)


@query("answers_block", """WITH q AS (SELECT user_id AS lecture, (props::JSON->>'$.k')::INTEGER AS id, event_id, event_id % 2 = 0 AS clarify, event_type = 'error' AS deferred, CASE WHEN event_id % 3 > 0 THEN 'guess ' || event_id % 5 ELSE '' END AS guess,
CASE WHEN event_type = 'purchase' THEN 'guess ' || event_id % 7 ELSE '' END AS answer FROM events WHERE event_id % 4 = 0), f AS (SELECT *, CASE WHEN answer <> '' THEN answer ELSE guess END AS final FROM q)
SELECT lecture, list('#' || id || ' ' || CASE WHEN deferred THEN 'DEFERRED' WHEN clarify AND final = guess THEN 'CONFIRMED' WHEN clarify THEN 'CORRECTED' ELSE 'answer' END || ': ' || final ORDER BY id, event_id) AS answers FROM f GROUP BY lecture""")
def answers_block(spark, sf):
    return J.answers_block(A.questions(spark, sf))


@query("board_listing", f"""WITH i AS (SELECT o_custkey AS lecture, (o_orderkey % 3)::INTEGER AS id, o_orderkey FROM orders),
b AS (SELECT lecture, id, string_agg({CLOCK.format('o_orderkey')} || '-' || {CLOCK.format('(o_orderkey + 90)')}, ', ' ORDER BY o_orderkey) AS spans, count(*) AS n FROM i GROUP BY ALL)
SELECT lecture, list('board ' || id || ': ' || spans || CASE WHEN n > 1 THEN ' (' || n || ' visits)' ELSE '' END ORDER BY id) AS boards FROM b GROUP BY lecture""")
def board_listing(spark, sf):
    lo = F.col("o_orderkey").cast("double")
    o = A.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("lecture"), (F.col("o_orderkey") % 3).cast("int").alias("id")).agg(F.array_sort(F.collect_list(F.struct(lo.alias("lo"), (lo + 90).alias("hi")))).alias("intervals"))
    return J.board_listing(o)


@query("crop_plan", """SELECT p_partkey AS board, CASE WHEN p_partkey % 7 = 0 THEN 'unknown board' WHEN p_size % 5 = 0 THEN 'blurred' WHEN p_size % 5 = 1 THEN 'no box' WHEN p_size % 5 = 2 THEN 'too small' END AS reason,
CASE WHEN p_partkey % 7 > 0 AND p_size % 5 > 2 THEN 960 END AS out_w, CASE WHEN p_partkey % 7 > 0 AND p_size % 5 > 2 THEN CASE WHEN p_size % 5 = 3 THEN 540 ELSE 1080 END END AS out_h,
CASE WHEN p_partkey % 7 > 0 AND p_size % 5 > 2 THEN 1.2245::DOUBLE END AS gain FROM part""")
def crop_plan(spark, sf):
    k = F.col("p_size") % 5
    reply = (F.when(k == 0, 'sorry {"error": "blurred"}').when(k == 1, "no idea").when(k == 2, '{"left": 0.5, "top": 0, "right": 0.51, "bottom": 1}')
             .when(k == 3, 'here: ```json\n{"left": -0.2, "top": 0.25, "right": 0.5, "bottom": 0.75}\n```').otherwise('{"left": 0.5, "top": 0, "right": 1.7, "bottom": 1}'))
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("board"), reply.alias("reply"))
    stills = p.where("board % 7 > 0").select("board", F.lit(1920).alias("w"), F.lit(1080).alias("h"))
    return J.crop_plan(p, stills)
