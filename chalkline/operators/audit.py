"""Filters, audits and usage totals over lectures, traces, sections and questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import text as T

# What a section must hold, what counts as a placeholder, thresholds.
NARRATION = r"(?i)^\s*(?:I'll|I will|Let me|I'm going to|First,? I|I need to|I've|I have launched|Now I)"
ENVIRONMENTS = (
    r"\\begin\{(?:theorem|lemma|proposition|corollary|definition|example|exercise|remark|notation|proof|equation|align|tikzcd)\}"
)
PLACEHOLDER_TOKEN = r"^[ \t]*%+[ \t]*(?:[A-Z][A-Z0-9_]{3,}\b|TODO|FIXME|XXX).*$"
PLACEHOLDER_WORDS = r"(?i)^[ \t]*%+[ \t]*(?:insert|fill|add|paste|put|draw)\b.*\b(?:here|later|below|to follow|goes)\b.*$"
MIN_SECTION_CHARS = 4000
MIN_ENVIRONMENTS = 3
HEDGES = ("unknown", "unclear", "not stated", "none", "n/a", "anonymous")


def language_mismatch(lectures: DataFrame, requested: str | None) -> DataFrame:
    """Lectures whose detected language isn't the requested one; unknown languages aren't reported, ``auto`` reports none."""
    known = F.coalesce(F.trim("detected_language"), F.lit(""))
    wanted = T.requested_language(F.lit(requested).cast("string"))
    return lectures.where(wanted.isNotNull() & (known != "") & (F.lower(known) != F.lower(wanted)))


def section_guard(sections: DataFrame, min_chars: int = MIN_SECTION_CHARS, min_environments: int = MIN_ENVIRONMENTS) -> DataFrame:
    """Adds ``reason``: the first check that a section's body fails, or null."""
    body = T.strip(F.coalesce("body", F.lit("")))
    reason = (
        F.when(body == "", "empty")
        .when(body.rlike(NARRATION), "narration")
        .when(~body.contains("\\section{"), "no heading")
        .when(F.length(body) < min_chars, "too short")
        .when(F.regexp_count(body, F.lit(ENVIRONMENTS)) < min_environments, "few environments")
    )
    return sections.withColumn("reason", reason)


def section_lines(sections: DataFrame) -> DataFrame:
    return sections.select("course", "lecture", F.posexplode(F.split("body", "\n")).alias("pos", "line"))


def placeholder_scan(sections: DataFrame) -> DataFrame:
    """Comment lines that stand in for content, once per section, at their first line."""
    lines = section_lines(sections).where(F.col("line").rlike(PLACEHOLDER_TOKEN) | F.col("line").rlike(PLACEHOLDER_WORDS))
    return lines.groupBy("course", "lecture", T.strip(F.col("line")).alias("line")).agg((F.min("pos") + 1).alias("line_no"))


def retranscribe_plan(lectures: DataFrame, files: DataFrame, mode: str = "missing", named: Sequence[str] | None = None) -> DataFrame:
    """Lectures to transcribe again: those with audio, and in ``missing`` mode without a transcript unless named; ``force`` takes all."""
    audio = files.where("kind = 'audio'").select("lecture")
    done = files.where("kind = 'transcript'").select("lecture")
    with_audio = lectures.join(audio, "lecture", "left_semi")
    if mode == "force":
        return with_audio
    left = with_audio.join(done, "lecture", "left_anti")
    return left.unionByName(with_audio.where(F.col("lecture").isin(*named))).distinct() if named else left


def speaker_answers(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """Last usable answer ``n: name`` per number; out-of-range numbers, hedges and over-long names are dropped."""
    rows = lines.select("course", "line_no", F.regexp_extract("line", r"^\s*(\d+)\s*[:.)]\s*(.*?)\s*$", 1).alias("n"), F.regexp_extract("line", r"^\s*(\d+)\s*[:.)]\s*(.*?)\s*$", 2).alias("name"))
    rows = rows.where("n <> ''").withColumn("n", F.col("n").try_cast("int")).join(counts, "course")
    good = (F.col("n") >= 1) & (F.col("n") <= F.col("count")) & (F.col("name") != "") & ~F.lower("name").isin(*HEDGES)
    good = good & (F.length("name") <= 60) & (F.size(F.split("name", r"\s+")) <= 5)
    return rows.where(good).groupBy("course", "n").agg(F.max_by("name", "line_no").alias("name"))


def provenance(lectures: DataFrame, expected: str = "en") -> DataFrame:
    """Recording date (only eight digits that are a date) and whether the language is another than expected."""
    day = F.when(F.col("upload_date").rlike(r"^\d{8}$"), F.try_to_timestamp("upload_date", F.lit("yyyyMMdd")).cast("date"))
    return lectures.withColumn("recorded", day).withColumn("warn_language", F.coalesce(F.col("detected_language") != expected, F.lit(False)))


def lecture_text(segments: DataFrame, extra: Column | None = None) -> DataFrame:
    """The text of each lecture, segments in order."""
    item = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return segments.groupBy("lecture").agg(F.array_join(F.transform(item, lambda x: x["text"]), " ").alias("text"))


def cue_counts(segments: DataFrame) -> DataFrame:
    """How often each lecture points at the board."""
    return lecture_text(segments).select("lecture", F.regexp_count("text", F.lit(T.CUES)).cast("bigint").alias("cues"))


def transcript_head(segments: DataFrame, most: int = 60, chars: int = 700) -> DataFrame:
    """Opening words: the first segments joined, white space squeezed, cut."""
    head = lecture_text(segments.where(F.col("seq") < most))
    return head.select("lecture", F.left(T.squeeze(F.col("text")), F.lit(chars)).alias("head"))


def durations(segments: DataFrame) -> DataFrame:
    """End of the last segment by position."""
    return segments.groupBy("lecture").agg(F.max_by("end", "seq").alias("duration"))


def run_summary(trace: DataFrame) -> DataFrame:
    """Per run: events, seconds, calls, tool counts (most first) and the boards opened (null when none)."""
    board = F.nullif(F.regexp_extract(F.get_json_object("input", "$.file_path"), T.BOARD_FILE, 1), F.lit("")).cast("int")
    keys = ["run", "role", "lecture"]
    tools = trace.withColumn("board", board).groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("s"), F.collect_set("board").alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("name"), F.col("n"))))
    return tools.groupBy(*keys).agg(
        F.sum("n").alias("events"), F.sum("s").alias("seconds"), F.transform(ordered, lambda x: F.concat_ws("=", x["name"], x["n"])).alias("tools"),
        F.nullif(F.array_sort(F.array_distinct(F.flatten(F.collect_list("b")))), F.array().cast("array<int>")).alias("boards_read"),
    )


def boards_opened(runs: DataFrame) -> DataFrame:
    """Most boards a run of each (lecture, role) opened: null without a closed run, 0 if closed with none.

    ``runs (lecture, role, closed, boards ARRAY<STRING>)``; a clipped list's ``+N more`` counts.
    """
    more = F.aggregate(F.transform("boards", lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"\+(\d+) more", 1), F.lit("")).cast("int"), F.lit(1))), F.lit(0), lambda a, x: a + x)
    opened = F.when(F.col("closed"), F.coalesce(more, F.lit(0)))
    return runs.groupBy("lecture", "role").agg(F.max(opened).alias("opened"))


def runs_by_role(runs: DataFrame) -> DataFrame:
    return runs.groupBy("role").agg(F.count(F.lit(1)).alias("runs"), (F.sum("seconds") / 60).alias("minutes"), F.sum("calls").alias("calls"))


def recent_runs(runs: DataFrame, most: int = 40) -> DataFrame:
    """The last runs, in log order."""
    return runs.orderBy(F.desc("event_no")).limit(most).orderBy("event_no")


#: A price list is short; it becomes part of the expression.
MOST_PRICES = 1000


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``cost``: the price of the first model prefix in table order, per million tokens; null for unknown models.

    ``prices (ord, prefix, price_in, price_out)`` is a fixed list, read once, so a row finds
    its price without a join.
    """
    listed = prices.select("ord", "prefix", "price_in", "price_out").orderBy("ord").limit(MOST_PRICES + 1).collect()
    if len(listed) > MOST_PRICES:
        raise ValueError(f"more than {MOST_PRICES} prices")
    fee = F.lit(None).cast("struct<i:double,o:double>")
    for p in reversed(listed):
        fee = F.when(F.col("model").startswith(F.lit(p.prefix)), F.struct(F.lit(p.price_in).cast("double").alias("i"), F.lit(p.price_out).cast("double").alias("o"))).otherwise(fee)
    rows = usage.withColumn("_fee", fee)
    pay = F.col("input_tokens") * F.col("_fee.i") + F.col("output_tokens") * F.col("_fee.o")
    pay = pay + F.col("cache_read_tokens") * F.col("_fee.i") * 0.1 + F.col("cache_write_tokens") * F.col("_fee.i") * 1.25
    return rows.withColumn("cost", pay / 1e6).drop("_fee")


def usage_totals(usage: DataFrame) -> DataFrame:
    """Totals per lecture, course and overall; cost is null only if all are; distinct notes joined.

    Lectures are added up first, so the roll-up expands one row per lecture, not every usage row.
    """
    columns = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cost")
    each = usage.groupBy("course", "lecture").agg(*(F.sum(c).alias(c) for c in columns), F.collect_set("note").alias("notes"))
    notes = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("notes")))), "; ").alias("notes")
    return each.rollup("course", "lecture").agg(*(F.sum(c).alias(c) for c in columns), notes, F.grouping_id().alias("level"))


def cost_lines(totals: DataFrame) -> DataFrame:
    """Adds ``line``: the tokens in short form and the cost of a row of totals, ``?`` where no price is known."""
    tokens = F.concat(T.short_tokens(F.col("input_tokens")), F.lit(" in, "), T.short_tokens(F.col("output_tokens")), F.lit(" out"))
    return totals.withColumn("line", F.concat(tokens, F.lit(", "), F.coalesce(F.concat(F.lit("$"), F.format_string("%.2f", F.col("cost").cast("double"))), F.lit("?"))))


def pending_work(sections: DataFrame, questions: DataFrame) -> DataFrame:
    """Open questions and todos per lecture, only lectures with either."""
    todo = sections.select("lecture", F.regexp_count("body", F.lit(r"\\todo\b")).cast("bigint").alias("todos")).groupBy("lecture").agg(F.sum("todos").alias("todos"))
    open_ = questions.where(F.col("answer").isNull() | F.coalesce("deferred", F.lit(False))).groupBy("lecture").agg(F.count(F.lit(1)).alias("open"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return todo.join(open_, "lecture", "full_outer").select("lecture", zero("todos"), zero("open")).where("todos > 0 OR open > 0")


def corrections(rows: DataFrame) -> DataFrame:
    """Last recorded value per mishearing; identity and blank pairs are dropped."""
    return rows.groupBy("course", "wrong").agg(F.max_by("right", "seq").alias("right")).where("wrong <> right AND trim(wrong) <> '' AND trim(right) <> ''")


def title_phrases(lectures: DataFrame) -> DataFrame:
    """Phrases of a series' titles: in all titles the series' name, in some a speaker candidate."""
    phrase = F.explode(F.array_distinct(F.filter(F.transform(F.split("title", r"\s-\s|[|:()]"), lambda x: F.trim(x)), lambda x: x != "")))
    n = F.count(F.lit(1)).alias("titles")
    whole = lectures.groupBy("course").agg(F.count(F.lit(1)).alias("total"))
    found = lectures.select("course", phrase.alias("phrase")).groupBy("course", "phrase").agg(n).join(whole, "course")
    return found.withColumn("role", F.when(F.col("titles") == F.col("total"), "series").otherwise("speaker"))


def course_audit(sections: DataFrame, segments: DataFrame, boards: DataFrame, opened: DataFrame, questions: DataFrame) -> DataFrame:
    """Per lecture: sizes, cues, diagrams, provenance, equations, todos, boards read, open questions and the two flags.

    Every input is reduced to one row per lecture before it is joined, so nothing fans out.
    """
    count = lambda p: F.regexp_count("body", F.lit(p)).cast("bigint")
    base = sections.select(
        "course", "lecture", "lecture_num", F.length("body").cast("bigint").alias("chars"), count(r"\\begin\{tikzcd\}").alias("diagrams"),
        count(r"%\s*board\s+\d+").alias("provenance"), count(r"\\begin\{equation\}").alias("equations"), count(r"\\todo\{").alias("todos"),
    )
    by_role = opened.groupBy("lecture").agg(F.max(F.when(F.col("role") == "write", F.col("opened"))).alias("written"), F.max(F.when(F.col("role") == "verify", F.col("opened"))).alias("verified"))
    falsy = F.coalesce("answer", F.lit("")) == ""
    asked = questions.groupBy("lecture").agg(F.count_if(falsy).alias("open_questions"))
    total = boards.groupBy("lecture").agg(F.count(F.lit(1)).alias("boards"))
    out = base.join(cue_counts(segments), "lecture", "left").join(total, "lecture", "left").join(by_role, "lecture", "left").join(asked, "lecture", "left")
    out = out.na.fill(0, ["cues", "boards", "open_questions"])
    lost = (F.col("cues") >= 3) & (F.col("diagrams") == 0)
    short = F.coalesce((F.col("boards") > 0) & (F.col("written") < F.col("boards")), F.lit(False))
    return out.withColumn("lost_diagrams", lost).withColumn("short_read", short)


def audit_totals(audit: DataFrame) -> DataFrame:
    """Grand totals of the audit and how many lectures each flag has, per course and overall; :func:`flagged_lectures` names them."""
    sums = [F.sum(c).alias(c) for c in ("diagrams", "provenance", "equations", "todos", "cues", "open_questions")]
    return audit.rollup("course").agg(F.count(F.lit(1)).alias("lectures"), *sums, F.count_if("lost_diagrams").alias("lost"), F.count_if("short_read").alias("short"))


def flagged_lectures(audit: DataFrame) -> DataFrame:
    """The lectures behind the totals: one row ``(course, flag, pos, lecture, detail)`` per flag, in lecture order within its course and flag."""
    lost = F.when(F.col("lost_diagrams"), F.struct(F.lit("lost diagrams").alias("flag"), F.concat("cues", F.lit(" cues")).alias("detail")))
    short = F.when(F.col("short_read"), F.struct(F.lit("short read").alias("flag"), F.concat_ws("/", "written", "boards").alias("detail")))
    rows = audit.select("course", "lecture_num", "lecture", F.explode(F.array_compact(F.array(lost, short))).alias("x"))
    w = Window.partitionBy("course", "x.flag").orderBy("lecture_num", "lecture")
    return rows.select("course", "x.flag", F.row_number().over(w).alias("pos"), "lecture", "x.detail")


def clip_lists(rows: DataFrame, column: str, most: int = 20) -> DataFrame:
    """Arrays of strings cut to ``most`` items and a ``+N more`` marker."""
    c = F.col(column)
    marker = F.array(F.concat(F.lit("… [+"), F.size(c) - most, F.lit(" more]")))
    return rows.withColumn(column, F.when(F.size(c) > most, F.concat(F.slice(c, 1, most), marker)).otherwise(c))


def clip_strings(rows: DataFrame, column: str, most: int = 4000) -> DataFrame:
    c = F.col(column)
    return rows.withColumn(column, F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("… [+"), F.length(c) - most, F.lit(" chars]"))).otherwise(c))


def context_budget(docs: DataFrame, column: str = "text", most: int = 150_000) -> DataFrame:
    """The shown part of each document with shown, total and percent columns."""
    total = F.length(F.coalesce(column, F.lit(""))).cast("bigint")
    shown = F.least(total, F.lit(most).cast("bigint"))
    percent = F.when(total > 0, F.floor(shown * 100 / total)).otherwise(F.lit(100).cast("bigint"))
    return docs.withColumn("shown_text", F.left(F.col(column), F.lit(most))).withColumn("shown", shown).withColumn("total", total).withColumn("percent", percent)
