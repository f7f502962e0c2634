"""Queries of the audit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.operators import audit as O
from chalkline.plans import adapters as A
from chalkline.plans.catalog import query

NUM = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
LANG = "CASE o_orderstatus WHEN 'F' THEN 'en' WHEN 'O' THEN 'la' END"
CUE = "(?i)\\bdraw(?:ing|s|n)?\\b|\\b(?:this|the|that|following|a)\\s+diagram\\b|\\bdiagram\\s+chase\\b|\\bpicture\\b|\\bsketch\\b|\\b(?:this|the)\\s+square\\b"
# the cues that the adapter adds, and any in the words themselves
CUES = f"sum(CASE WHEN turn % 3 = 0 THEN 2 ELSE 0 END + len(regexp_extract_all(coalesce(text, ''), '{CUE}')))::BIGINT"
BOARD = "(props::JSON->>'$.k')::INTEGER"


@query("cue_counts", f"SELECT conv_id::VARCHAR AS lecture, {CUES} AS cues FROM conversations GROUP BY conv_id")
def cue_counts(spark, sf):
    return O.cue_counts(A.segments(spark, sf))


@query("transcript_head", """WITH s AS (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 3 = 0 THEN ' now draw this diagram' ELSE '' END AS text FROM conversations WHERE turn < 60)
SELECT conv_id::VARCHAR AS lecture, left(trim(regexp_replace(string_agg(text, ' ' ORDER BY turn), '\\s+', ' ', 'g')), 700) AS head FROM s GROUP BY conv_id""")
def transcript_head(spark, sf):
    return O.transcript_head(A.segments(spark, sf))


@query("durations", "SELECT conv_id::VARCHAR AS lecture, arg_max(turn * 30.0::DOUBLE + 25, turn) AS duration FROM conversations GROUP BY conv_id")
def durations(spark, sf):
    return O.durations(A.segments(spark, sf))


@query("language_mismatch", f"SELECT o_custkey AS course, o_orderkey AS lecture, {LANG} AS detected_language FROM orders WHERE {LANG} <> 'en'")
def language_mismatch(spark, sf):
    return O.language_mismatch(A.lectures(spark, sf), "en").select("course", "lecture", "detected_language")


@query("provenance", f"""SELECT o_orderkey AS lecture, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS recorded, coalesce({LANG} <> 'en', false) AS warn_language FROM orders""")
def provenance(spark, sf):
    return O.provenance(A.lectures(spark, sf)).select("lecture", "recorded", "warn_language")


@query("title_phrases", """WITH t AS (SELECT o_custkey AS course, o_orderkey, unnest(list_distinct(['Series ' || o_custkey, 'Part ' || o_orderkey % 7, o_orderpriority])) AS phrase FROM orders)
SELECT course, phrase, count(*) AS titles, total, CASE WHEN count(*) = total THEN 'series' ELSE 'speaker' END AS role
FROM t JOIN (SELECT o_custkey AS course, count(*) AS total FROM orders GROUP BY 1) USING (course) GROUP BY course, phrase, total""")
def title_phrases(spark, sf):
    return O.title_phrases(A.lectures(spark, sf)).select("course", "phrase", "titles", "total", "role")


@query("section_guard", """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'empty' WHEN doc_id % 7 = 0 THEN 'narration' WHEN doc_id % 5 = 0 THEN 'no heading'
WHEN length(rtrim(coalesce(text, ''), ' ' || chr(10) || chr(9))) + length('\\section{S}') + 1 + 17 * (doc_id % 4) < 4000 THEN 'too short' WHEN doc_id % 4 < 3 THEN 'few environments' END AS reason FROM documents""")
def section_guard(spark, sf):
    k = F.col("doc_id")
    body = (F.when(k % 11 == 0, "  \n").when(k % 7 == 0, F.concat(F.lit("\nLet me write "), "text")).when(k % 5 == 0, F.col("text"))
            .otherwise(F.concat(F.lit("\\section{S}"), F.repeat(F.lit("\\begin{theorem} x"), (k % 4).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))))
    return O.section_guard(A.table(spark, sf, "documents").withColumn("body", body)).select("doc_id", "reason")


@query("placeholder_scan", """SELECT l_orderkey AS lecture, CASE l_linenumber % 3 WHEN 0 THEN '% DIAGRAM_HERE ' || l_linenumber ELSE '% insert figure ' || l_linenumber || ' later' END AS line
FROM lineitem WHERE l_linenumber % 3 < 2 GROUP BY ALL""")
def placeholder_scan(spark, sf):
    n = F.col("l_linenumber")
    line = F.when(n % 3 == 0, F.concat(F.lit("  % DIAGRAM_HERE "), n)).when(n % 3 == 1, F.concat(F.lit("% insert figure "), n, F.lit(" later"))).otherwise("% Additions by hand")
    s = A.table(spark, sf, "lineitem").groupBy(F.lit(0).alias("course"), F.col("l_orderkey").alias("lecture")).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    return O.placeholder_scan(s).select("lecture", "line")


@query("retranscribe_plan", "SELECT o_orderkey AS lecture FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def retranscribe_plan(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("lecture"))
    files = o.where("lecture % 2 = 0").withColumn("kind", F.lit("audio")).unionByName(o.where("lecture % 3 = 0").withColumn("kind", F.lit("transcript")))
    return O.retranscribe_plan(o, files)


@query("speaker_answers", f"""WITH x AS (SELECT user_id AS course, event_id AS line_no, {BOARD} % 12 AS n, CASE WHEN event_type = 'error' THEN 'Unknown' WHEN event_type = 'view' THEN repeat('x', 61) ELSE 'Name ' || event_id % 9 END AS name FROM events)
SELECT course, n, arg_max(name, line_no) AS name FROM x WHERE n BETWEEN 1 AND 8 AND name LIKE 'Name %' GROUP BY course, n""")
def speaker_answers(spark, sf):
    e = A.table(spark, sf, "events")
    name = F.when(F.col("event_type") == "error", "Unknown").when(F.col("event_type") == "view", F.repeat(F.lit("x"), F.lit(61))).otherwise(F.concat(F.lit("Name "), F.col("event_id") % 9))
    line = F.concat(F.lit(" "), F.get_json_object("props", "$.k").cast("int") % 12, F.lit(": "), name)
    lines = e.select(F.col("user_id").alias("course"), F.col("event_id").alias("line_no"), line.alias("line"))
    return O.speaker_answers(lines, e.select(F.col("user_id").alias("course"), F.lit(8).alias("count")).distinct())


RUN = "user_id || '-' || strftime(ts, '%Y%m%d')"


@query("run_summary", f"""WITH t AS (SELECT {RUN} AS run, event_type AS name, count(*) AS n, sum(value) AS s FROM events GROUP BY ALL),
b AS (SELECT {RUN} AS run, list_sort(list(DISTINCT {BOARD}) FILTER (WHERE {BOARD} IS NOT NULL)) AS boards_read FROM events GROUP BY ALL)
SELECT run, sum(n)::BIGINT AS events, round(sum(s), 2) AS seconds, list(name || '=' || n ORDER BY n DESC, name) AS tools, any_value(boards_read) AS boards_read FROM t JOIN b USING (run) GROUP BY run""")
def run_summary(spark, sf):
    return O.run_summary(A.trace(spark, sf)).select("run", "events", F.round("seconds", 2).alias("seconds"), "tools", "boards_read")


@query("boards_opened", f"""SELECT user_id AS lecture, CASE WHEN user_id % 2 = 0 THEN 'write' ELSE 'verify' END AS role,
max(CASE WHEN event_type <> 'error' THEN CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'click' THEN {BOARD} ELSE 1 END END)::INTEGER AS opened FROM events GROUP BY ALL""")
def boards_opened(spark, sf):
    e = A.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    boards = F.when(F.col("event_type") == "click", F.when(k > 0, F.array(F.concat(F.lit("… [+"), k, F.lit(" more]")))).otherwise(F.array().cast("array<string>"))).when(F.col("event_type") != "view", F.array(F.lit("3")))
    runs = e.select(F.col("user_id").alias("lecture"), F.when(F.col("user_id") % 2 == 0, "write").otherwise("verify").alias("role"), (F.col("event_type") != "error").alias("closed"), boards.alias("boards"))
    return O.boards_opened(runs)


@query("runs_by_role", f"""WITH r AS (SELECT {RUN} AS run, CASE WHEN user_id % 2 = 0 THEN 'write' ELSE 'verify' END AS role, count(*) AS calls, sum(value) AS seconds FROM events GROUP BY ALL)
SELECT role, count(*) AS runs, round(sum(seconds) / 60, 6) AS minutes, sum(calls)::BIGINT AS calls FROM r GROUP BY role""")
def runs_by_role(spark, sf):
    runs = O.run_summary(A.trace(spark, sf)).withColumnRenamed("events", "calls")
    return O.runs_by_role(runs).withColumn("minutes", F.round("minutes", 6))


@query("recent_runs", "SELECT event_id AS event_no, event_type AS name FROM events ORDER BY event_id DESC LIMIT 40")
def recent_runs(spark, sf):
    return O.recent_runs(A.trace(spark, sf)).select("event_no", "name")


PRICES = [(1, "promo-A", 5.0, 25.0), (2, "promo", 3.0, 15.0), (3, "economy", 1.0, 5.0), (4, "small", 5.0, 25.0), (5, "large", 2.0, 8.0)]
USAGE = """(SELECT l_orderkey % 10 AS course, l_orderkey AS lecture, l_returnflag, lower(p_type) AS kind, trunc(l_quantity)::BIGINT AS i, trunc(l_extendedprice)::BIGINT AS o, l_linenumber::BIGINT AS w,
CASE p_type WHEN 'PROMO' THEN CASE l_returnflag WHEN 'A' THEN 5.0 ELSE 3.0 END WHEN 'ECONOMY' THEN 1.0 WHEN 'SMALL' THEN 5.0 WHEN 'LARGE' THEN 2.0 END::DOUBLE AS pin,
CASE p_type WHEN 'PROMO' THEN CASE l_returnflag WHEN 'A' THEN 25.0 ELSE 15.0 END WHEN 'ECONOMY' THEN 5.0 WHEN 'SMALL' THEN 25.0 WHEN 'LARGE' THEN 8.0 END::DOUBLE AS pout FROM lineitem JOIN part ON l_partkey = p_partkey)"""
COST = "(i * pin + o * pout + 2 * i * pin * 0.1::DOUBLE + w * pin * 1.25::DOUBLE) / 1e6"


def _prices(spark):
    return spark.createDataFrame(PRICES, "ord int, prefix string, price_in double, price_out double")


@query("usage_cost", f"SELECT kind || '-' || l_returnflag AS model, count(*) AS n, round(sum({COST}), 8) AS cost FROM {USAGE} GROUP BY ALL")
def usage_cost(spark, sf):
    return O.usage_cost(A.usage(spark, sf), _prices(spark)).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 8).alias("cost"))


@query("usage_rollup", f"""SELECT course, lecture, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(2 * i)::BIGINT AS cache_read_tokens, sum(w)::BIGINT AS cache_write_tokens,
round(sum({COST}), 8) AS cost, string_agg(DISTINCT 'note ' || l_returnflag, '; ' ORDER BY 'note ' || l_returnflag) AS notes, grouping(course, lecture)::BIGINT AS level FROM {USAGE} GROUP BY ROLLUP (course, lecture)""")
def usage_rollup(spark, sf):
    return O.usage_totals(O.usage_cost(A.usage(spark, sf), _prices(spark))).withColumn("cost", F.round("cost", 8))


@query("cost_lines", f"""WITH u AS (SELECT course, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o, sum({COST}) AS cost FROM {USAGE} GROUP BY course),
t AS (SELECT *, CASE WHEN i >= 1000000 THEN printf('%.2fM', i / 1e6) WHEN i >= 1000 THEN printf('%.1fk', i / 1e3) ELSE i::VARCHAR END AS si, CASE WHEN o >= 1000000 THEN printf('%.2fM', o / 1e6) WHEN o >= 1000 THEN printf('%.1fk', o / 1e3) ELSE o::VARCHAR END AS so FROM u)
SELECT course, si || ' in, ' || so || ' out, ' || CASE WHEN cost IS NULL THEN '?' ELSE printf('$%.2f', cost) END AS line FROM t""")
def cost_lines(spark, sf):
    totals = O.usage_totals(O.usage_cost(A.usage(spark, sf), _prices(spark)))
    return O.cost_lines(totals.where("level = 1")).select("course", "line")


@query("pending_work", """WITH t AS (SELECT o_orderkey % 100 AS lecture, sum(o_orderkey % 3)::BIGINT AS todos FROM orders GROUP BY 1),
q AS (SELECT user_id AS lecture, count(*) AS open FROM events WHERE event_type NOT IN ('click', 'purchase') GROUP BY 1)
SELECT lecture, coalesce(todos, 0) AS todos, coalesce(open, 0) AS open FROM t FULL JOIN q USING (lecture) WHERE coalesce(todos, 0) > 0 OR coalesce(open, 0) > 0""")
def pending_work(spark, sf):
    s = A.table(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("lecture"), F.repeat(F.lit("\\todo[inline]{x} \\todos "), (F.col("o_orderkey") % 3).cast("int")).alias("body"))
    return O.pending_work(s, A.questions(spark, sf))


@query("corrections", """SELECT l_orderkey AS course, 'w' || l_linenumber AS wrong, max_by(CASE WHEN l_quantity < 5 THEN 'w' || l_linenumber WHEN l_quantity < 8 THEN ' ' ELSE 'r' || l_quantity::BIGINT END, l_extendedprice) AS "right"
FROM lineitem GROUP BY ALL HAVING "right" <> wrong AND trim("right") <> ''""")
def corrections(spark, sf):
    q = F.col("l_quantity")
    right = F.when(q < 5, F.concat(F.lit("w"), "l_linenumber")).when(q < 8, " ").otherwise(F.concat(F.lit("r"), q.cast("bigint")))
    return O.corrections(A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("course"), F.concat(F.lit("w"), "l_linenumber").alias("wrong"), right.alias("right"), F.col("l_extendedprice").alias("seq")))


def _audit(spark, sf):
    n = F.col("o_orderkey")
    body = F.concat(F.repeat(F.lit("\\begin{tikzcd}"), (n % 3).cast("int")), F.repeat(F.lit("% board 12\n"), (n % 4).cast("int")), F.repeat(F.lit("\\begin{equation}\\begin{equation*}"), (n % 5).cast("int")), F.repeat(F.lit("\\todo{x}\\todo[inline]{y}"), (n % 2).cast("int")))
    s = A.table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("course"), n.cast("string").alias("lecture"), n.alias("lecture_num"), body.alias("body"))
    e = A.table(spark, sf, "events").withColumn("lecture", F.col("user_id").cast("string"))
    runs = e.select("lecture", F.when(F.col("event_id") % 2 == 0, "write").otherwise("verify").alias("role"), (F.col("event_type") != "error").alias("closed"),
                    F.sequence(F.lit(1), (F.col("event_id") % 9 + 1).cast("int")).cast("array<string>").alias("boards"))
    return O.course_audit(s, A.segments(spark, sf), e.where("event_type = 'view'"), O.boards_opened(runs), A.questions(spark, sf).withColumn("lecture", F.col("lecture").cast("string")))


AUDIT = f"""WITH c AS (SELECT conv_id AS k, {CUES} AS cues FROM conversations GROUP BY 1),
e AS (SELECT user_id AS k, count(*) FILTER (WHERE event_type = 'view') AS boards, max(CASE WHEN event_id % 2 = 0 AND event_type <> 'error' THEN event_id % 9 + 1 END)::INTEGER AS written,
  max(CASE WHEN event_id % 2 = 1 AND event_type <> 'error' THEN event_id % 9 + 1 END)::INTEGER AS verified, count(*) FILTER (WHERE event_type <> 'purchase') AS open_questions FROM events GROUP BY 1),
a AS (SELECT o_custkey % 10 AS course, o_orderkey::VARCHAR AS lecture, o_orderkey AS lecture_num, (14 * (o_orderkey % 3) + 11 * (o_orderkey % 4) + 33 * (o_orderkey % 5) + 24 * (o_orderkey % 2))::BIGINT AS chars,
  o_orderkey % 3 AS diagrams, o_orderkey % 4 AS provenance, o_orderkey % 5 AS equations, o_orderkey % 2 AS todos, coalesce(cues, 0) AS cues, coalesce(boards, 0) AS boards, written, verified,
  coalesce(open_questions, 0) AS open_questions, coalesce(cues, 0) >= 3 AND o_orderkey % 3 = 0 AS lost_diagrams, coalesce(coalesce(boards, 0) > 0 AND written < boards, false) AS short_read
  FROM orders LEFT JOIN c ON c.k = o_orderkey LEFT JOIN e ON e.k = o_orderkey)
"""


@query("course_audit", AUDIT + "SELECT * FROM a")
def course_audit(spark, sf):
    return _audit(spark, sf)


@query("audit_totals", AUDIT + """SELECT course, count(*) AS lectures, sum(diagrams)::BIGINT AS diagrams, sum(provenance)::BIGINT AS provenance, sum(equations)::BIGINT AS equations, sum(todos)::BIGINT AS todos,
sum(cues)::BIGINT AS cues, sum(open_questions)::BIGINT AS open_questions, count(*) FILTER (WHERE lost_diagrams) AS lost, count(*) FILTER (WHERE short_read) AS short FROM a GROUP BY ROLLUP (course)""")
def audit_totals(spark, sf):
    return O.audit_totals(_audit(spark, sf))


@query("flagged_lectures", AUDIT + """, f AS (SELECT course, 'lost diagrams' AS flag, lecture_num, lecture, cues || ' cues' AS detail FROM a WHERE lost_diagrams
UNION ALL SELECT course, 'short read', lecture_num, lecture, written || '/' || boards FROM a WHERE short_read)
SELECT course, flag, (row_number() OVER (PARTITION BY course, flag ORDER BY lecture_num))::INTEGER AS pos, lecture, detail FROM f""")
def flagged_lectures(spark, sf):
    return O.flagged_lectures(_audit(spark, sf))


@query("clip_lists", """SELECT l_orderkey, CASE WHEN count(*) > 3 THEN list_slice(list(l_linenumber::VARCHAR ORDER BY l_linenumber), 1, 3) || ['… [+' || (count(*) - 3) || ' more]'] ELSE list(l_linenumber::VARCHAR ORDER BY l_linenumber) END AS items
FROM lineitem GROUP BY l_orderkey""")
def clip_lists(spark, sf):
    l = A.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).cast("array<string>").alias("items"))  # noqa: E741
    return O.clip_lists(l, "items", 3)


@query("clip_strings", "SELECT doc_id, CASE WHEN length(text) > 4000 THEN left(text, 4000) || '… [+' || (length(text) - 4000) || ' chars]' ELSE text END AS text FROM documents")
def clip_strings(spark, sf):
    return O.clip_strings(A.table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("context_budget", """SELECT doc_id, least(length(coalesce(text, '')), 5000)::BIGINT AS shown, length(coalesce(text, ''))::BIGINT AS total,
CASE WHEN length(coalesce(text, '')) > 0 THEN floor(least(length(text), 5000) * 100 / length(text))::BIGINT ELSE 100 END AS percent FROM documents""")
def context_budget(spark, sf):
    return O.context_budget(A.table(spark, sf, "documents"), "text", 5000).select("doc_id", "shown", "total", "percent")
