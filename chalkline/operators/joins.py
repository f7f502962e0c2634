"""Joins over transcripts, boards, inputs and courses."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import text as T

# Prefix lengths, tolerances, precedence of video files.
LONGEST, SHORTEST = 8, 3
TOLERANCE = 60
END_SLACK = 1
FULL_CONTEXT = 2
VIDEO_ORDER = ("mp4", "mkv", "webm", "mov")


def interleave(segments: DataFrame, marks: DataFrame) -> DataFrame:
    """Board marks ``(lecture, at, mark)`` spliced into the transcript: each before the first segment that starts at or after it."""
    w = Window.partitionBy("lecture").orderBy("seq")
    s = segments.select("lecture", F.max("start").over(w).alias("key"), F.lit(1).alias("kind"), F.col("seq").cast("bigint").alias("n"), F.concat(F.lit("["), T.clock(F.col("start")), F.lit("] "), "text").alias("line"))
    m = marks.select("lecture", F.col("at").alias("key"), F.lit(0).alias("kind"), F.col("n").cast("bigint").alias("n"), F.col("mark").alias("line"))
    order = Window.partitionBy("lecture").orderBy("key", "kind", "n")
    return s.unionByName(m).select("lecture", F.row_number().over(order).alias("pos"), "line")


def board_at_segment(segments: DataFrame, intervals: DataFrame) -> DataFrame:
    """As-of: the board that last came on screen when each segment starts; ``intervals (lecture, lo, board)``."""
    s = segments.select("lecture", F.col("start").alias("t"), F.lit(1).alias("kind"), "seq", F.lit(None).cast("bigint").alias("board"))
    b = intervals.select("lecture", F.col("lo").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("seq"), F.col("board").cast("bigint").alias("board"))
    w = Window.partitionBy("lecture").orderBy("t", "kind", F.col("board")).rowsBetween(Window.unboundedPreceding, 0)
    return s.unionByName(b).withColumn("board", F.last("board", True).over(w)).where("kind = 1").select("lecture", "seq", "board")


def boards_on_screen(points: DataFrame, intervals: DataFrame, bucket: float = 3600.0) -> DataFrame:
    """Range join ``lo <= t < hi`` of ``points (video, t, ...)`` with ``intervals (video, lo, hi, board)``.

    Intervals are laid over time buckets, so the join is an equi-join on video and bucket.
    """
    spread = F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket)))
    i = intervals.select("video", "lo", "hi", "board", spread.alias("bucket"))
    p = points.withColumn("bucket", F.floor(F.col("t") / bucket))
    return p.join(i, ["video", "bucket"]).where("lo <= t AND t < hi").drop("bucket")


def heavy_runs(segments: DataFrame, sampled: float = 0.1, most: int = 256, share: int = 1000) -> list[int]:
    """Hashes of the three-word runs that hold more than one in ``share`` places, by a sketch of bounded size over some segments.

    They only say which keys to deal out, so exact counts don't matter.
    """
    words = F.transform(F.array(T.word_stream(F.col("text"))), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.when(F.size(w) > 2, F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))))
    runs = segments.sample(fraction=sampled, seed=7).select(F.explode(F.get(words, F.lit(0))).alias("run")).where("run IS NOT NULL")
    top, total = runs.agg(F.expr(f"approx_top_k(run, {most}, {16 * most})"), F.count(F.lit(1))).first()
    return [x["item"] for x in top or [] if x["count"] * share > total]


def locate_quotes(quotes: DataFrame, segments: DataFrame, salts: int = 64) -> DataFrame:
    """Where each quote ``(quote, text)`` was said in each lecture: the longest prefix of 8..3 words, then the earliest position.

    Words run on across segments.  Candidates come from an equi-join on the first three
    words; longer prefixes are compared only there.  Runs that are very frequent among the
    segments are dealt over ``salts`` partitions, the few quotes that begin with one to
    each of these; and a quote's places in a lecture are reduced before they meet.
    """
    words = segments.select("lecture", "seq", "start", F.posexplode(T.word_stream(F.col("text"))).alias("i", "w"))
    order = Window.partitionBy("lecture").orderBy("seq", "i")
    stream = words.withColumn("pos", F.row_number().over(order)).select(
        "lecture", "start", "pos", F.col("w").alias("w1"), *(F.lead("w", k).over(order).alias(f"w{k + 1}") for k in range(1, LONGEST))
    )
    stream = stream.where("w3 IS NOT NULL").withColumn("run", F.xxhash64("w1", "w2", "w3"))
    q = quotes.withColumn("q", F.slice(T.word_stream(F.col("text")), 1, LONGEST)).where(F.size("q") >= SHORTEST)
    q = q.select("quote", "q", *(F.col("q")[k].alias(f"w{k + 1}") for k in range(SHORTEST))).withColumn("run", F.xxhash64("w1", "w2", "w3"))
    heavy = F.col("run").isin(heavy_runs(segments))
    stream = stream.withColumn("salt", F.when(heavy, F.pmod(F.hash("lecture", "pos"), F.lit(salts))).otherwise(0))
    q = q.withColumn("salt", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    hits = stream.join(q, ["run", "salt", "w1", "w2", "w3"])
    said = F.array(*(F.col(f"w{k + 1}") for k in range(LONGEST)))
    n = F.lit(0)
    for k in range(SHORTEST, LONGEST + 1):
        n = F.when((F.size("q") >= k) & (F.slice(said, 1, k) == F.slice("q", 1, k)), k).otherwise(n)
    best = F.max(F.struct(n.alias("n"), (-F.col("pos")).alias("back"), "start")).alias("b")
    return hits.groupBy("quote", "lecture").agg(best).select("quote", "lecture", F.col("b.n").alias("n"), (-F.col("b.back")).alias("pos"), F.col("b.start").alias("start"))


def correct_timestamps(questions: DataFrame, located: DataFrame, ends: DataFrame) -> DataFrame:
    """Stated times ``(lecture, id, stated)`` replaced where absent or over a minute off the located one; times past the end flagged."""
    rows = questions.join(located.select("lecture", "id", F.col("start").alias("found")), ["lecture", "id"], "left").join(ends, "lecture", "left")
    given = T.seconds(F.col("stated"))
    wrong = F.col("found").isNotNull() & (given.isNull() | (F.abs(given - F.col("found")) > TOLERANCE))
    late = F.coalesce(given > F.col("duration") + END_SLACK, F.lit(False))
    return rows.select("lecture", "id", T.clock(F.when(wrong, F.col("found")).otherwise(given)).alias("stamp"), (wrong & given.isNotNull()).alias("corrected"), late.alias("past_end"))


# Runs of words that sources are indexed by, how many neighbours the least one is kept of, words in a piece of a source.
RUN, NEIGHBOURS, PIECE = 3, 4, 128
#: Words from which a passage surely meets the index: its first and last may be cut off.
INDEXED = RUN + NEIGHBOURS - 1 + 2


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it in functions over arrays."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _hashes(words: Column) -> Column:
    """The hash of every run of RUN words, in order."""
    run = lambda w: lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(RUN)))
    return _once(words, lambda w: F.when(F.size(w) >= RUN, F.transform(F.sequence(F.lit(0), F.size(w) - RUN), run(w))).otherwise(F.array().cast("array<bigint>")))


def _placed(hashes: Column, places: Callable[[Column], Column]) -> Column:
    """``(h, at)`` of the hashes at some places."""
    return _once(hashes, lambda r: F.transform(places(r), lambda i: F.named_struct(F.lit("h"), F.get(r, i), F.lit("at"), i)))


def _runs(words: Column) -> Column:
    """``(h, at)`` of every run of RUN words, by its first word's place."""
    none = F.array().cast("array<int>")
    return _placed(_hashes(words), lambda r: F.when(F.size(r) > 0, F.sequence(F.lit(0), F.size(r) - 1)).otherwise(none))


def _least_runs(hashes: Column) -> Column:
    """Places of the hashes that are the least of some NEIGHBOURS side by side, all of them where some are equal."""
    none = F.array().cast("array<int>")
    least = lambda r: lambda i: F.least(*(F.get(r, i + k) for k in range(NEIGHBOURS)))
    mins = lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - NEIGHBOURS), least(r))
    held = lambda r, m: lambda i: reduce(or_, (F.get(r, i) == F.get(m, i - k) for k in range(NEIGHBOURS)))
    return F.when(F.size(hashes) >= NEIGHBOURS, _once(mins(hashes), lambda m: F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), held(hashes, m)))).otherwise(none)


def source_index(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(postings, pieces)`` of ``sources (source, text)``, to be written as tables where sources stay the same.

    ``postings (source, h, at)``: of every NEIGHBOURS word runs side by side the one of least
    hash (winnowing), so a passage of some length has one of them wherever it stands.
    ``pieces (source, piece, words)``: the words, PIECE a row.
    """
    words = F.split(T.squeeze(F.col("text")), " ")
    # numbers are compared place by place: slices and records made for every word took most of the time
    kept = _placed(_hashes(words), _least_runs)
    piece = lambda w: lambda k: F.slice(w, k * PIECE + 1, F.lit(PIECE))
    cut = _once(words, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / PIECE).cast("int")), piece(w)))
    rows = sources.where("text IS NOT NULL")
    return rows.select("source", F.inline(kept)), rows.select("source", F.posexplode(cut).alias("piece", "words"))


def verify_originals(passages: DataFrame, sources: DataFrame, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Adds ``verified``: whether the passage occurs in its source, white space aside; ``sources (source, text)``.

    A passage meets the postings of its source at its run of least hash, and only the pieces
    around these places are compared with it, word by word (its first and last words may be
    parts).  Passages of fewer than INDEXED words are looked up in the text, many at a time.
    """
    postings, pieces = index or source_index(sources)
    key = F.sha2(T.squeeze(F.col("original")), 256)
    asked = passages.select("source", T.squeeze(F.col("original")).alias("p"), key.alias("_key")).where("p IS NOT NULL").dropDuplicates(["source", "_key"])
    asked = asked.withColumn("q", F.split("p", " "))
    long = asked.where(F.size("q") >= INDEXED).withColumn("m", F.size("q"))
    first = F.array_min(_runs(F.slice("q", F.lit(2), F.greatest(F.col("m") - 2, F.lit(0)))))
    placed = long.withColumn("r", first).select("source", "_key", "q", "m", F.col("r.h").alias("h"), F.col("r.at").alias("off")).join(postings, ["source", "h"])
    placed = placed.withColumn("start", F.col("at") - F.col("off") - 1).where("start >= 0")
    spread = placed.select("source", "_key", "q", "m", "start", F.explode(F.sequence(F.floor(F.col("start") / PIECE).cast("int"), F.floor((F.col("start") + F.col("m") - 1) / PIECE).cast("int"))).alias("piece"))
    met = spread.join(pieces, ["source", "piece"])
    low, high = F.greatest(F.lit(0), F.col("piece") * PIECE - F.col("start")), F.least(F.col("m"), (F.col("piece") + 1) * PIECE - F.col("start"))
    word = lambda i: F.get("words", F.col("start") + i - F.col("piece") * PIECE)
    same = lambda i: F.when(i == 0, word(i).endswith(F.get("q", i))).when(i == F.col("m") - 1, word(i).startswith(F.get("q", i))).otherwise(word(i) == F.get("q", i))
    agree = F.forall(F.sequence(low, high - 1), lambda i: F.coalesce(same(i), F.lit(False)))
    whole = met.select("source", "_key", "start", agree.alias("ok"), (high - low).alias("n"), "m").groupBy("source", "_key", "start").agg(F.bool_and("ok").alias("ok"), F.sum("n").alias("n"), F.max("m").alias("m"))
    found = whole.where("ok AND n = m").select("source", "_key")
    few = asked.where(F.size("q") < INDEXED).groupBy("source", F.pmod(F.xxhash64("_key"), F.lit(64)).alias("lot")).agg(F.collect_list(F.struct("_key", "p")).alias("ps"))
    texts = few.join(sources.select("source", T.squeeze(F.col("text")).alias("t")), "source")
    held = texts.select("source", F.explode(F.filter("ps", lambda x: F.col("t").contains(x["p"]))).alias("x")).select("source", "x._key")
    known = found.unionByName(held).distinct().withColumn("_found", F.lit(True))
    rows = passages.withColumn("_key", key).join(known, ["source", "_key"], "left").withColumn("verified", F.coalesce("_found", F.lit(False)))
    return rows.withColumn("note", F.when(~F.col("verified"), "not in the source")).select(*passages.columns, "verified", "note")


def ingest_plan(inputs: DataFrame, infos: DataFrame, files: DataFrame) -> DataFrame:
    """Per input ``(pos, source)``: done, resume or new, and the video file by precedence, else the recorded source.

    ``infos (source, lecture)``, ``files (lecture, name)``.
    """
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    rank = F.array_position(F.array(*(F.lit(x) for x in VIDEO_ORDER)), suffix)
    f = files.groupBy("lecture").agg(
        F.bool_or(F.col("name") == "transcript.json").alias("t"), F.bool_or(F.col("name").startswith("audio.")).alias("a"),
        F.min_by(F.when(rank > 0, F.col("name")), F.when(rank > 0, rank)).alias("video"),
    )
    state = F.when(F.coalesce("t", F.lit(False)), "done").when(F.coalesce("a", F.lit(False)), "resume").otherwise("new")
    return inputs.join(infos, "source", "left").join(f, "lecture", "left").select("pos", "source", state.alias("state"), F.coalesce("video", F.when(T.source_type(F.col("source")) == "file", F.col("source"))).alias("video"))


def unread_boards(boards: DataFrame, trace: DataFrame, role: str = "write") -> DataFrame:
    """Boards a lecture's runs of ``role`` never opened; nothing where they opened none at all."""
    board = F.nullif(F.regexp_extract(F.get_json_object("input", "$.file_path"), T.BOARD_FILE, 1), F.lit("")).cast("int")
    seen = trace.where(F.col("role") == role).select("lecture", board.alias("id")).where("id IS NOT NULL").distinct()
    return boards.join(seen.select("lecture").distinct(), "lecture", "left_semi").join(seen, ["lecture", "id"], "left_anti")


def propagation_plan(revisions: DataFrame, sections: DataFrame) -> DataFrame:
    """Every lecture after the first revised one, with the ordered changes of all earlier revised lectures, per course.

    A running list along the lectures of a course; nothing is paired.
    """
    r = revisions.groupBy("course", "lecture_num").agg(F.array_sort(F.collect_list("change")).alias("own"))
    rows = sections.select("course", "lecture_num", F.lit(True).alias("is_section")).distinct().join(r, ["course", "lecture_num"], "full_outer")
    w = Window.partitionBy("course").orderBy("lecture_num").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("changes", F.flatten(F.collect_list("own").over(w)))
    return rows.where(F.col("is_section") & (F.size("changes") > 0)).select("course", "lecture_num", "changes")


def numbered_lectures(sections: DataFrame) -> DataFrame:
    """``sections`` with ``n``, the position of each lecture in its course from 1; positions are what slices refer to."""
    return sections.withColumn("n", F.row_number().over(Window.partitionBy("course").orderBy("lecture_num")))


def context_slices(sections: DataFrame, full: int = FULL_CONTEXT) -> DataFrame:
    """``(course, k, near, older)``, one row per lecture k: the last ``full`` lectures with their bodies, and how many
    older ones there are.  The older ones are the positions 1..``older`` of :func:`numbered_lectures`; nothing of them is copied."""
    w = Window.partitionBy("course").orderBy("lecture_num")
    rows = numbered_lectures(sections.select("course", "lecture_num", "body"))
    near = F.array(*(F.struct(F.lag("lecture_num", d).over(w).alias("lecture_num"), F.lag("body", d).over(w).alias("text")) for d in range(1, full + 1)))
    return rows.select("course", F.col("lecture_num").alias("k"), F.filter(near, lambda x: x["lecture_num"].isNotNull()).alias("near"), F.greatest(F.col("n") - 1 - full, F.lit(0)).alias("older"))


def prior_context(sections: DataFrame, full: int = FULL_CONTEXT) -> DataFrame:
    """For each lecture its earlier ones: the last ``full`` in full, older by summary, in full without one.

    The full listing of :func:`context_slices`, which it resolves by equi-joins on course
    and position.
    """
    slices = context_slices(sections, full)
    last = slices.select("course", "k", F.explode("near").alias("x")).select("course", "k", "x.lecture_num", F.lit("full").alias("form"), "x.text")
    brief = F.coalesce("summary", F.lit("")) != ""
    texts = numbered_lectures(sections).select("course", "n", "lecture_num", F.when(brief, "summary").otherwise("full").alias("form"), F.when(brief, F.col("summary")).otherwise(F.col("body")).alias("text"))
    older = slices.where("older > 0").select("course", "k", F.explode(F.sequence(F.lit(1), F.col("older"))).alias("n")).join(texts, ["course", "n"])
    return last.unionByName(older.select("course", "k", "lecture_num", "form", "text"))


def order_mismatch(inputs: DataFrame, sections: DataFrame) -> DataFrame:
    """Lectures whose cached number isn't their present position."""
    return inputs.join(sections, ["course", "lecture"]).where("pos <> lecture_num").select("course", "lecture", "pos", "lecture_num")


def lecture_index(sections: DataFrame) -> DataFrame:
    """``(course, n, lecture_num, line)``: the ordered index of each course, titles without ``Lecture N:``.

    The others of a lecture are all positions of its course but its own ``n``, so this is
    all that has to be kept of them.
    """
    title = F.regexp_replace("title", r"^Lecture\s+\d+\s*[:.-]\s*", "")
    line = F.concat(F.lit("Lecture "), "lecture_num", F.lit(": "), title)
    return numbered_lectures(sections).select("course", "n", "lecture_num", line.alias("line"))


def other_lectures(sections: DataFrame) -> DataFrame:
    """Per lecture the ordered index of all others: :func:`lecture_index` written out for everyone, quadratic within a course."""
    index = lecture_index(sections)
    all_ = index.groupBy("course").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("all"))
    mine = index.select("course", "lecture_num", "n").join(all_, "course")
    return mine.select("course", "lecture_num", F.concat(F.slice("all", F.lit(1), F.col("n") - 1), F.slice("all", F.col("n") + 1, F.size("all"))).alias("others"))


# -- windows ------------------------------------------------------------------------------


def merge_intervals(intervals: DataFrame, gap: float, key: str = "video") -> DataFrame:
    """Gaps and islands: intervals at most ``gap`` apart become one."""
    w = Window.partitionBy(key).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("starts", F.when(before.isNull() | (F.col("lo") - before > gap), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("starts").over(w))
    return rows.groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n")).drop("island")


def renumber_boards(boards: DataFrame, least: float = 20.0) -> DataFrame:
    """Boards ``(video, id, lo, hi)`` with at least ``least`` seconds in all, renumbered from 1 in order of discovery."""
    totals = boards.groupBy("video", "id").agg(F.sum(F.col("hi") - F.col("lo")).alias("seconds"), (F.count(F.lit(1)) - 1).alias("revisits"), F.min("lo").alias("first"))
    kept = totals.where(F.col("seconds") >= least)
    return kept.select("video", F.col("id").alias("old_id"), F.row_number().over(Window.partitionBy("video").orderBy("first", "id")).alias("id"), "seconds", "revisits")


def _suffixed(rule: str) -> tuple[Callable[[Column], Column], Column]:
    """How ``rule`` writes number n behind a name, and what ``name`` may be so written: an array of ``(base, n)``."""
    length, left = F.length("name"), lambda n: F.substring("name", F.lit(1), F.length("name") - n)
    if rule == "dash":
        number = F.regexp_extract("name", r"-([1-9]\d{0,17})$", 1)
        read = F.when(number != "", F.array(F.struct(left(F.length(number) + 1).alias("base"), number.cast("long").alias("n"))))
        return lambda n: F.concat(F.lit("-"), n), read
    run = F.length(F.regexp_extract("name", r"((?:-b)+)$" if rule == "letters" else r"(\d{1,18})$", 1))
    if rule == "letters":
        split = lambda k: F.named_struct(F.lit("base"), left(2 * k), F.lit("n"), (k + 1).cast("long"))
        return lambda n: F.expr("repeat('-b', cast(n - 1 as int))"), F.when(run > 0, F.transform(F.sequence(F.lit(1), (run / 2).cast("int")), split))
    if rule == "digits":
        split = lambda k: F.named_struct(F.lit("base"), left(k), F.lit("n"), F.substring("name", length - k + 1, k).cast("long"))
        plain = lambda k: F.substring("name", length - k + 1, F.lit(1)) != "0"
        return lambda n: n.cast("string"), F.when(run > 0, F.transform(F.filter(F.sequence(F.lit(1), run), plain), split))
    raise ValueError(f"no such rule: {rule}")


def unique_names(rows: DataFrame, rule: str = "dash") -> DataFrame:
    """Names ``(grp, pos, name)`` made unique within their group by a suffix.

    ``letters``: ``-b`` repeated; ``digits``: 2, 3, ...; ``dash``: -2, -3, ...  Numbers whose
    suffixed name another row has of its own are passed over: every name is read as such a
    one, and only these meet the names that repeat, so no row holds a whole group.
    """
    write, read = _suffixed(rule)
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("grp", "name").orderBy("pos")) - 1)
    repeated = rows.groupBy("grp", "name").count().where("count > 1").select("grp", F.col("name").alias("base"))
    taken = rows.select("grp", "name").distinct().select("grp", F.inline(read)).where("n > 1").join(repeated, ["grp", "base"], "left_semi")
    taken = taken.groupBy("grp", "base").agg(F.array_sort(F.collect_set("n")).alias("taken")).withColumnRenamed("base", "name")
    number = F.aggregate(F.coalesce("taken", F.array().cast("array<bigint>")), (F.col("r") + 1).cast("long"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    named = ranked.join(taken, ["grp", "name"], "left").withColumn("n", number)
    return named.withColumn("unique", F.when(F.col("r") == 0, F.col("name")).otherwise(F.concat("name", write(F.col("n"))))).drop("r", "n", "taken")


def unique_folders(lectures: DataFrame) -> DataFrame:
    """Folder of each ``(grp, pos, slug, source)``: the slug for its first source, ``<slug>-<hash of the source>`` for other sources.

    The same source comes back to its own folder.
    """
    w = Window.partitionBy("grp", "slug").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.col("source") != F.first("source").over(w)
    return lectures.withColumn("folder", F.when(other, F.concat_ws("-", "slug", F.left(F.sha1("source"), F.lit(8)))).otherwise(F.col("slug")))


def available_prefix(inputs: DataFrame) -> DataFrame:
    """Per course: the leading run of ready inputs ``(course, pos, ready)``, and how many ready ones are held behind it."""
    missing = F.min(F.when(~F.col("ready"), F.col("pos"))).over(Window.partitionBy("course"))
    rows = inputs.withColumn("stop", missing)
    ahead = F.col("stop").isNull() | (F.col("pos") < F.col("stop"))
    return rows.groupBy("course").agg(F.count_if(ahead).alias("prefix"), F.count_if(~ahead & F.col("ready")).alias("held"))


def context_search(lines: DataFrame, pattern: str, context: int = 2, most: int = 30) -> DataFrame:
    """Grep with context over ``(file, line_no, line)``: the first ``most`` hits in file and line order, hits marked.

    Only hits are ordered globally (a top-k), and their context comes by an equi-join on
    the line numbers around them.
    """
    context, most = min(max(context, 0), 20), min(max(most, 1), 200)
    hits = lines.where(F.col("line").rlike("(?i)" + pattern)).orderBy("file", "line_no").limit(most)
    around = hits.select("file", F.col("line_no").alias("hit"), F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)).alias("line_no"))
    return lines.join(around.groupBy("file", "line_no").agg(F.bool_or(F.col("hit") == F.col("line_no")).alias("is_hit")), ["file", "line_no"])


def topk_candidates(scores: DataFrame, k: int = 3, least: float = 0.45) -> DataFrame:
    """The best ``k`` earlier boards of each frame ``(video, i, board, score)``, none below ``least``."""
    w = Window.partitionBy("video", "i").orderBy(F.desc("score"), "board")
    return scores.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def answers_block(questions: DataFrame) -> DataFrame:
    """Per lecture its delivered answers in order of id, classified."""
    final = F.when(F.coalesce("answer", F.lit("")) != "", F.col("answer")).otherwise(F.coalesce("guess", F.lit("")))
    kind = (F.when(F.coalesce("deferred", F.lit(False)), "DEFERRED").when((F.col("kind") == "clarify") & (final == F.coalesce("guess", F.lit(""))), "CONFIRMED")
            .when(F.col("kind") == "clarify", "CORRECTED").otherwise("answer"))
    rows = questions.where("delivered").withColumn("line", F.concat(F.lit("#"), "id", F.lit(" "), kind, F.lit(": "), final))
    return rows.groupBy("lecture").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "event_no", "line"))), lambda x: x["line"]).alias("answers"))


def board_listing(boards: DataFrame) -> DataFrame:
    """Per lecture each board ``(lecture, id, intervals)`` with its spans and, if revisited, the number of visits."""
    span = lambda x: F.concat_ws("-", T.clock(x["lo"]), T.clock(x["hi"]))
    visits = F.when(F.size("intervals") > 1, F.concat(F.lit(" ("), F.size("intervals"), F.lit(" visits)"))).otherwise("")
    line = F.concat(F.lit("board "), "id", F.lit(": "), F.array_join(F.transform("intervals", span), ", "), visits)
    return boards.groupBy("lecture").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]).alias("boards"))


def crop_plan(boxes: DataFrame, stills: DataFrame, most: int = 1568, least: float = 0.04) -> DataFrame:
    """Fractional boxes out of replies ``(board, reply)`` clamped to the still: output size (never upscaled) and gain, or a reason."""
    blob = F.regexp_extract("reply", r"(?s)(\{[^{}]*\})", 1)
    box = F.from_json(blob, "left DOUBLE, top DOUBLE, right DOUBLE, bottom DOUBLE, error STRING")
    rows = boxes.join(stills, "board", "left").withColumn("b", box)
    clamp = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    rows = rows.withColumn("l", clamp(F.col("b.left"))).withColumn("t", clamp(F.col("b.top"))).withColumn("r", clamp(F.col("b.right"))).withColumn("d", clamp(F.col("b.bottom")))
    reason = (F.when(F.col("w").isNull(), "unknown board").when(F.col("b.error").isNotNull(), F.col("b.error")).when(F.col("l").isNull() | F.col("t").isNull() | F.col("r").isNull() | F.col("d").isNull(), "no box")
              .when((F.col("r") - F.col("l") < least) | (F.col("d") - F.col("t") < least), "too small"))
    cw, ch = F.greatest(F.bround((F.col("r") - F.col("l")) * F.col("w")), F.lit(1)), F.greatest(F.bround((F.col("d") - F.col("t")) * F.col("h")), F.lit(1))
    scale = F.least(F.lit(1.0), most / F.greatest(cw, ch))
    whole = F.least(F.lit(1.0), most / F.greatest("w", "h"))
    ok = reason.isNull()
    return rows.select("board", reason.alias("reason"), F.when(ok, F.bround(cw * scale).cast("int")).alias("out_w"), F.when(ok, F.bround(ch * scale).cast("int")).alias("out_h"), F.when(ok, F.round(scale / whole, 4)).alias("gain"))
