"""Files in the shapes that other tools write: indented documents, broken lines, bytes that are no text."""

import difflib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from chalkline.functions import udf
from chalkline.operators import audit, bib, joins, latex, pages
from chalkline.sources import readers, sinks
from chalkline.streaming import jobs


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_indented_transcripts(spark, tmp_path):
    doc = {"metadata": {"title": "T 1", "uploader": "u", "segment_count": 2}, "segments": [{"start": 0.0, "end": 2.5, "text": "a"}, {"start": 2.5, "end": 4.0, "text": "b"}]}
    put(tmp_path, "01 intro+x/transcript.json", json.dumps(doc, indent=2))
    put(tmp_path, "02/transcript.json", '{"metadata": {"title": "cut')
    put(tmp_path, "02/notes.txt", "no document")
    lectures, segments = readers.read_transcripts(spark, str(tmp_path))
    assert rows(lectures, "lecture", "title", "corrupt") == [("01 intro+x", "T 1", False), ("02", None, True)]
    assert rows(segments, "lecture", "seq", "start", "text") == [("01 intro+x", 0, 0.0, "a"), ("01 intro+x", 1, 2.5, "b")]
    assert lectures.where("corrupt").count() == 1


def test_indented_state_boards_and_questions(spark, tmp_path):
    put(tmp_path, "s/course a/state.json", json.dumps({"title": "T", "sections": {"l1": {"lecture_num": 1, "body": "b\n1", "summary": None}}}, indent=2))
    assert rows(readers.read_state(spark, str(tmp_path / "s"))[1], "course", "lecture", "lecture_num", "body") == [("course a", "l1", 1, "b\n1")]
    put(tmp_path, "b/l1/boards.json", json.dumps({"video": "v.mp4", "boards": [{"id": 1, "image": "board-01.jpg"}, {"id": 2, "image": None}, {"id": 3, "image": "gone.jpg"}]}, indent=2))
    stills = spark.createDataFrame([("board-01.jpg",)], "image string")
    assert rows(readers.read_boards(spark, str(tmp_path / "b"), stills)[1], "lecture", "id") == [("l1", 1)]
    put(tmp_path, "q/l1/questions.json", json.dumps({"questions": [{"id": 1, "text": "why", "answer": ""}], "question_seq": 2}, indent=2))
    put(tmp_path, "q/l2/questions.json", json.dumps([{"id": 7, "text": "how", "deferred": True}], indent=2))
    assert rows(readers.read_questions(spark, str(tmp_path / "q"))[1], "lecture", "id", "answer", "deferred") == [("l1", 1, "", None), ("l2", 7, None, True)]


def test_boards_as_the_segmentation_writes_them(spark, tmp_path):
    boards = [
        {"id": 1, "intervals": [[0.0, 12.5], [40, 61.5]], "seconds": 34.0, "revisits": 1, "best_at": 10.5, "ink": 0.0312, "image": "board-01.jpg"},
        {"id": 2, "intervals": [{"lo": 3, "hi": 4.5}], "seconds": 1.5, "image": "board-02.jpg"}, {"id": 3, "intervals": [], "image": "board-03.jpg"},
    ]
    put(tmp_path, "01 intro/boards/boards.json", json.dumps({"video": "v.mp4", "boards": boards}, indent=2))
    put(tmp_path, "02/boards/boards.json", json.dumps({"boards": boards})[:70])
    put(tmp_path, "03/boards/boards.json", json.dumps({"boards": {"id": 1}}))
    put(tmp_path, "04/boards/boards.json", json.dumps({"video": "no boards"}))
    stills = spark.createDataFrame([("01 intro", "board-01.jpg"), ("01 intro", "board-02.jpg"), ("02", "board-03.jpg")], "lecture string, image string")
    docs, found = readers.read_boards(spark, str(tmp_path), stills)
    assert rows(docs, "lecture", "corrupt") == [("01 intro", False), ("02", True), ("03", True), ("04", False)]
    assert rows(found, "lecture", "id", "intervals", "seconds", "revisits", "best_at", "ink") == [
        ("01 intro", 1, [(0.0, 12.5), (40.0, 61.5)], 34.0, 1, 10.5, 0.0312), ("01 intro", 2, [(3.0, 4.5)], 1.5, None, None, None),
    ]


def test_questions_keep_every_field_and_broken_files_count(spark, tmp_path):
    first = {"id": 1, "kind": "clarify", "text": "why", "context": "line 3", "guess": "so", "timestamp": "00:01:02", "answer": "", "delivered": True, "deferred": False, "applied": True}
    put(tmp_path, "out/01-a.tex.questions.json", json.dumps({"questions": [first, "no question", {"id": 2, "answer": None}], "question_seq": 3}, indent=2))
    put(tmp_path, "out/02-b.tex.questions.json", json.dumps([{"id": 7, "timestamp": None, "applied": False}]))
    put(tmp_path, "out/03-c.tex.questions.json", '{"questions": [{"id": 1')
    put(tmp_path, "out/04-d.tex.questions.json", json.dumps({"question_seq": 1}))
    put(tmp_path, "out/05-e.tex.questions.json", json.dumps({"questions": "none"}))
    docs, found = readers.read_questions(spark, str(tmp_path))
    assert rows(docs, "lecture", "corrupt") == [("01-a.tex", False), ("02-b.tex", False), ("03-c.tex", True), ("04-d.tex", False), ("05-e.tex", True)]
    assert rows(found.where("id = 1"), *readers.QUESTION) == [(1, "clarify", "why", "line 3", "so", "00:01:02", "", False, True, True)]
    assert rows(found, "lecture", "id", "answer", "applied") == [("01-a.tex", 1, "", True), ("01-a.tex", 2, None, None), ("02-b.tex", 7, None, False)]


def test_broken_states_count(spark, tmp_path):
    put(tmp_path, "a/state.json", json.dumps({"title": "T", "sections": {"l1": {"lecture_num": 1, "body": "b"}}}))
    put(tmp_path, "b/state.json", '{"title": "T", "sections": {"l1"')
    docs, sections = readers.read_state(spark, str(tmp_path))
    assert rows(docs, "course", "corrupt") == [("a", False), ("b", True)] and rows(sections, "course", "lecture") == [("a", "l1")]


def test_broken_trace_lines_can_be_counted(spark, tmp_path):
    put(tmp_path, "write-l1.jsonl", '{"run": "r", "event_no": 1, "seconds": 2.5}\n\n{broken\n{"run": "r", "event_no": "x"}\n')
    trace = readers.read_traces(spark, str(tmp_path))
    assert trace.where("corrupt").count() == 2
    assert rows(trace.where("NOT corrupt"), "file", "run", "event_no", "seconds") == [("write-l1.jsonl", "r", 1, 2.5)]


def test_undecodable_bytes_are_replaced(spark, tmp_path):
    put(tmp_path, "a.txt", b"caf\xe9\nwhole \xc3\xa9\n")
    assert rows(readers.read_text_lines(spark, str(tmp_path)), "line_no", "line") == [(1, "caf�"), (2, "whole é")]


def test_bibliography_with_every_field_and_without_marker(spark, tmp_path):
    entry = '@book{k1,\n  title = {A {B} of, url = {no}},\n  Publisher = "P, Q",\n  note={x}, year = 1999\n}'
    assert udf.every_field(entry) == {"title": "A {B} of, url = {no}", "publisher": "P, Q", "note": "x", "year": "1999"}
    entries = spark.createDataFrame([("c", 1, None, entry), ("c", 2, "doi:10.1/x", "@misc{k2,\n  title = {T}\n}")], "course string, pos int, source_key string, entry string")
    sinks.write_bib(entries, str(tmp_path / "bib"))
    back = bib.read_bib(spark, str(tmp_path / "bib"))
    assert rows(back, "cite_key", "source_key", F.size("fields")) == [("k1", None, 4), ("k2", "doi:10.1/x", 1)]
    assert rows(back.where("cite_key = 'k1'"), "entry") == [(entry,)]


def test_exported_course_files_and_manifest(spark, tmp_path):
    s = spark.createDataFrame([("c", "x", 1, "intro", "one\ntwo"), ("c", "y", 1, "intro", "other"), ("c", "z", 12, "end", "last")], "course string, lecture string, lecture_num int, slug string, body string")
    names = sinks.export_course(s, str(tmp_path / "out")).first().files
    assert names == ["01-intro", "01-intro-b", "12-end"]
    text = {n: "".join(p.read_text() for p in sorted((tmp_path / "out" / "course=c" / f"file={n}").glob("part-*"))).strip() for n in names}
    assert text == {"01-intro": "one\ntwo", "01-intro-b": "other", "12-end": "last"}


def test_board_documents_hold_the_figures_of_the_segmentation(spark, tmp_path):
    boards = spark.createDataFrame([("v", 2, 30.0), ("v", 1, 0.0)], "video string, board int, lo double")
    summary = spark.createDataFrame([("v", 2, 1), ("w", 0, 0)], "video string, boards_found int, revisits int")
    sinks.write_board_documents(boards, summary, str(tmp_path / "b"))
    back = spark.read.json(str(tmp_path / "b"))
    assert rows(back, "video", "boards_found", F.col("boards.board")) == [("v", 2, [1, 2]), ("w", 0, [])]


def test_ingest_adds_nothing_twice(spark, tmp_path):
    source = lambda: jobs.tail_json(spark, str(tmp_path / "in"), "lecture int, course int", 1)
    put(tmp_path, "in/a.json", '{"lecture": 1, "course": 1}\n{"lecture": 2, "course": 1}\n{"lecture": 2, "course": 9}\n')
    jobs.ingest(source(), str(tmp_path / "out"))
    put(tmp_path, "in/b.json", '{"lecture": 2, "course": 5}\n{"lecture": 3, "course": 1}\n')
    jobs.ingest(source(), str(tmp_path / "out"))
    jobs.ingest(source(), str(tmp_path / "out"))
    back = spark.read.schema("lecture int, course int").parquet(str(tmp_path / "out/data"))
    assert [x for (x,) in rows(back, "lecture")] == [1, 2, 3]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """A row counts as late once the watermark of an earlier trigger has passed its window."""
    path = tmp_path / "in"
    for n, lines in enumerate((["2024-01-01 10:00:00"], ["2024-01-01 20:00:00"], ["2024-01-01 20:05:00"], ["2024-01-01 10:30:00", "2024-01-01 20:10:00"])):
        put(path, f"{n}.json", "".join(json.dumps({"role": "write", "t": t, "error": False}) + "\n" for t in lines))
        os.utime(path / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    trace = jobs.tail_json(spark, str(path), "role string, t timestamp, error boolean", 1)
    late = jobs.LateRows()
    spark.streams.addListener(late)
    q = jobs.tool_activity(trace, slide="1 hour").writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert late.count(q) == 1
    spark.streams.removeListener(late)
    assert rows(spark.table("late"), "role", "calls") == [("write", 1)]


def test_late_rows_of_more_batches_than_a_query_remembers(spark, tmp_path):
    """Every second of 24 batches brings a row that is late by then; the query remembers the last four."""
    path = tmp_path / "in"
    for n in range(24):
        times = [f"2024-01-{n + 1:02d} 10:00:00"] + ["2024-01-01 00:00:00"] * (n > 2 and n % 2)
        put(path, f"{n}.json", "".join(json.dumps({"role": "write", "t": t, "error": False}) + "\n" for t in times))
        os.utime(path / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "4")
    late = jobs.LateRows()
    spark.streams.addListener(late)
    trace = jobs.tail_json(spark, str(path), "role string, t timestamp, error boolean", 1)
    q = jobs.tool_activity(trace, slide="1 hour").writeStream.outputMode("append").format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert late.count(q) == 11 and len(q.recentProgress) <= 4
    spark.streams.removeListener(late)
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_rows_without_a_key_are_all_ingested(spark, tmp_path):
    source = lambda: jobs.tail_json(spark, str(tmp_path / "in"), "lecture int, course int", 1)
    put(tmp_path, "in/a.json", '{"course": 1}\n{"course": 2}\n{"lecture": 2, "course": 9}\n')
    jobs.ingest(source(), str(tmp_path / "out"))
    put(tmp_path, "in/b.json", '{"course": 3}\n{"lecture": 2, "course": 5}\n')
    jobs.ingest(source(), str(tmp_path / "out"))
    back = spark.read.schema("lecture int, course int").parquet(str(tmp_path / "out/data"))
    assert rows(back, "lecture", "course") == [(2, 9), (None, 1), (None, 2), (None, 3)]


def test_runs_close_when_idle_and_keep_counts_only(spark, tmp_path):
    path = tmp_path / "in"
    line = lambda run, t, name, k=None, s=None, e=False: json.dumps({"run": run, "t": t, "name": name, "input": k and json.dumps({"file_path": f"/out/boards/board-{k:03d}.png"}), "seconds": s, "error": e}) + "\n"
    put(path, "0.json", line("a", "2024-01-01 10:00:00", "Read", 1, 1.5) + line("a", "2024-01-01 10:01:00", "Read", 1, 2.0, True) + line("b", "2024-01-01 10:00:00", None))
    put(path, "1.json", line("a", "2024-01-01 12:00:00", "Grep") + line("a", "2024-01-01 11:00:00", "Read", 2))
    put(path, "2.json", line("z", "2024-02-01 00:00:00", "end"))
    put(path, "3.json", line("a", "2024-02-01 00:00:00", "Read"))  # long after: a summary of its own, still open
    for n in range(4):
        os.utime(path / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    out = spark.read.parquet(jobs.drain(jobs.run_summary(jobs.tail_json(spark, str(path), "run string, t timestamp, name string, input string, seconds double, error boolean", 1)), str(tmp_path / "out")))
    assert rows(out, "run", "events", "seconds", "errors", "boards", "tools") == [("a", 4, 3.5, 1, 2, {"Grep": 1, "Read": 3}), ("b", 1, None, 0, 0, {})]
    assert rows(out, "run", F.date_format("start", "HH:mm").alias("s"), F.date_format("stop", "HH:mm").alias("e")) == [("a", "10:00", "12:00"), ("b", "10:00", "10:00")]


def test_names_that_meet_their_own_suffix(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "a-b"), (1, 4, "a")], "grp int, pos int, name string")
    assert rows(joins.unique_names(df, "letters"), "pos", "unique") == [(1, "a"), (2, "a-b-b"), (3, "a-b"), (4, "a-b-b-b")]
    many = spark.createDataFrame([(1, n, x) for n, x in enumerate(["a", "a", "a-2", "a-2", "a", "a-03", "a-4", "b", "a"])] + [(2, 1, "a"), (2, 2, "a")], "grp int, pos int, name string")
    assert rows(joins.unique_names(many, "dash"), "grp", "pos", "unique") == [
        (1, 0, "a"), (1, 1, "a-3"), (1, 2, "a-2"), (1, 3, "a-2-2"), (1, 4, "a-5"), (1, 5, "a-03"), (1, 6, "a-4"), (1, 7, "b"), (1, 8, "a-6"), (2, 1, "a"), (2, 2, "a-2"),
    ]
    keys = spark.createDataFrame([(1, n, x) for n, x in enumerate(["k", "k", "k2", "k12", "k1", "k1", "k"])], "grp int, pos int, name string")
    assert [x for _, x in rows(joins.unique_names(keys, "digits"), "pos", "unique")] == ["k", "k3", "k2", "k12", "k1", "k13", "k4"]
    lectures = spark.createDataFrame([(1, 1, "s", "u1"), (1, 2, "s", "u2"), (1, 3, "s", "u1")], "grp int, pos int, slug string, source string")
    got = rows(joins.unique_folders(lectures), "pos", "folder")
    assert [got[0][1], got[2][1]] == ["s", "s"] and got[1][1].startswith("s-") and len(got[1][1]) == 10


def test_passage_files(spark):
    text = "%%% ORIGINAL-START\n one \n%%% ORIGINAL-END\n%%% REWRITTEN-START\nuno\n%%% REWRITTEN-END\n%%% ORIGINAL-START\nx\n%%% ORIGINAL-END\n%%% PACKAGES: tikz-cd, , mathtools\nrest"
    f = spark.createDataFrame([("f", text), ("g", "nothing"), ("h", None)], "file string, text string")
    assert rows(pages.passage_blocks(f), "file", "pos", "original", "rewritten") == [("f", 0, "one", "uno")]
    assert rows(pages.requested_packages(f), "file", "pos", "package") == [("f", 0, "tikz-cd"), ("f", 1, "mathtools")]


def agreement(a, b):
    return 2 * (udf.matching(a, b) - 1) / (len(a) + len(b))


def test_agreement_keeps_order_at_any_length():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(2000)]
    for n in (200, 400, 1500):
        words = rng.choices(vocabulary, k=n)
        shuffled = rng.sample(words, n)
        assert agreement(" ".join(words), " ".join(shuffled)) < 0.4
        assert agreement(" ".join(words), " ".join(words[n // 2 :] + words[: n // 2])) < 0.75


@pytest.mark.parametrize("rate", [0.01, 0.05, 0.2])
def test_agreement_of_long_rewrites_against_a_plain_matcher(rate):
    """Texts of about 10,000 letters whose words are replaced, left out and put in."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(2000)]
    words = rng.choices(vocabulary, k=1450)
    rewritten = [rng.choice(vocabulary) if rng.random() < rate else w for w in words if rng.random() > rate / 3]
    a, b = " ".join(words), " ".join(rewritten)
    assert len(a) > 9500
    assert abs(agreement(a, b) - difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()) < 0.02


def test_common_letters_against_the_plain_table():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 12))) for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *row[1:]]
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], max(row[j], row[j - 1]) if x != y else before + 1
        assert udf.common_letters(a, b) == row[-1]


def test_passages_are_found_where_they_stand(spark):
    rng = random.Random(8)
    source = " ".join("".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(900)) + "  end of\n it"
    flat = " ".join(source.split())
    cuts = [flat[a : a + n] for a, n in ((0, 60), (3, 200), (700, 900), (len(flat) - 80, 80), (5, 1), (100, 9), (0, len(flat)))]
    wrong = [cuts[1][:50] + "X" + cuts[1][51:], "X" + cuts[0], cuts[3] + "s", flat + " more words", "zzz", cuts[2].replace(" ", "", 1)]
    texts = [(1, c.replace(" ", " \n ")) for c in cuts] + [(1, w) for w in wrong] + [(2, cuts[0]), (3, cuts[0]), (1, None), (1, ""), (1, cuts[0])]
    passages = spark.createDataFrame(texts, "source int, original string").withColumn("q", F.lit("x"))
    sources = spark.createDataFrame([(1, source), (2, "other"), (4, None)], "source int, text string")
    got = joins.verify_originals(passages, sources)
    assert got.columns == ["source", "original", "q", "verified", "note"] and got.count() == len(texts)
    held = lambda r: r.source == 1 and r.original is not None and " ".join(r.original.split()) in flat
    assert [(r.source, r.original) for r in got.collect() if r.verified != bool(held(r)) or (r.note is None) != r.verified] == []
    right = got.where("verified").count()
    assert len(cuts) + 2 <= right < len(texts) - 5
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = joins.source_index(sources)
        assert joins.verify_originals(passages, sources, index).where("verified").count() == right
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_phrase_in_a_third_of_all_segments(spark):
    said = [(n % 40, n, 30.0 * n, "so now we see the point" if n % 3 == 0 else f"word{n} is said and word{n % 7}") for n in range(900)]
    segments = spark.createDataFrame(said, "lecture int, seq int, start double, text string")
    quotes = spark.createDataFrame([("hot", "So now we see the end"), ("rare", "word8 is said and word1"), ("short", "so now")], "quote string, text string")
    hot = spark.range(1).select(F.xxhash64(F.lit("so"), F.lit("now"), F.lit("we"))).first()[0]
    assert hot in joins.heavy_runs(segments) and joins.heavy_runs(segments.limit(0)) == []
    got = {(r.quote, r.lecture): (r.n, r.start) for r in joins.locate_quotes(quotes, segments, 8).collect()}
    first = {}
    for lecture, _, start, text in said:
        if text.startswith("so"):
            first.setdefault(lecture, start)
    assert {k[1]: v for k, v in got.items() if k[0] == "hot"} == {lecture: (5, start) for lecture, start in first.items()}
    assert got["rare", 8] == (5, 240.0) and not any(k[0] == "short" for k in got)


def test_contexts_are_slices_of_a_course(spark):
    s = spark.createDataFrame([(c, n, f"body {n}", None if n % 2 else f"sum {n}", f"Lecture {n}: T{n}") for c in (1, 2) for n in (2, 3, 5, 8, 9)], "course int, lecture_num int, body string, summary string, title string")
    slices = joins.context_slices(s)
    assert slices.count() == 10
    last = slices.where("course = 1 AND k = 9").first()
    assert last.older == 2 and [(x.lecture_num, x.text) for x in last.near] == [(8, "body 8"), (5, "body 5")]
    got = rows(joins.prior_context(s).where("course = 1 AND k = 9"), "lecture_num", "form", "text")
    assert got == [(2, "summary", "sum 2"), (3, "full", "body 3"), (5, "full", "body 5"), (8, "full", "body 8")]
    assert joins.lecture_index(s).count() == 10
    assert joins.other_lectures(s).where("course = 2 AND lecture_num = 3").first().others == ["Lecture 2: T2", "Lecture 5: T5", "Lecture 8: T8", "Lecture 9: T9"]


def test_errors_by_a_piece_of_a_word(spark):
    """An identifier counts inside a longer word too, and the first section that holds it is to blame."""
    errors = spark.createDataFrame([(1, 1, None, "Undefined control sequence `abc:def'", None), (1, 2, None, "Missing `zzz' or `def.x'", None), (1, 3, None, "nothing named", None), (1, 4, None, "c", ["k", "no"])], "doc int, error int, line int, message string, citations array<string>")
    sections = spark.createDataFrame([(1, 1, "l1", "xx \\label{eq:abc:def.x}"), (1, 2, "l2", "abc:def \\cite{k}"), (1, 3, "l3", "\\cite{j, k}")], "doc int, pos int, lecture string, body string")
    preamble = spark.createDataFrame([(1, "  ")], "doc int, additions string")
    got = latex.attribute_errors(errors, latex.line_spans(sections), sections, preamble)
    assert rows(got, "error", "lecture") == [(1, "l1"), (2, "l1"), (3, None), (4, "l2"), (4, "l3")]


def test_lines_on_the_edges_of_spans(spark):
    spans = spark.createDataFrame([(1, "a", 1, 64), (1, "b", 66, 200)], "doc int, lecture string, lo long, hi long")
    asked = spark.createDataFrame([(1, n) for n in (0, 1, 63, 64, 65, 66, 128, 200, 201)] + [(2, 5), (1, None)], "doc int, line int")
    got = dict(((d, n), x) for d, n, x in latex.at_line(asked, spans).select("doc", "line", "lecture").collect())
    assert got == {(1, 0): None, (1, 1): "a", (1, 63): "a", (1, 64): "a", (1, 65): None, (1, 66): "b", (1, 128): "b", (1, 200): "b", (1, 201): None, (2, 5): None, (1, None): None}


@pytest.mark.parametrize("count", [1, 4])
def test_context_of_earlier_lectures(spark, count):
    s = spark.createDataFrame([(1, n, f"b{n}", f"s{n}" if n != 1 else "") for n in range(1, count + 1)], "course int, lecture_num int, body string, summary string")
    got = rows(joins.prior_context(s).where(f"k = {count}"), "lecture_num", "form", "text")
    assert got == ([] if count == 1 else [(1, "full", "b1"), (2, "full", "b2"), (3, "full", "b3")])


def test_flagged_lectures_are_named(spark):
    a = spark.createDataFrame([(1, "x", 1, 4, 5, 2, True, True), (1, "y", 2, 0, 5, 5, False, False)], "course int, lecture string, lecture_num int, cues int, boards int, written int, lost_diagrams boolean, short_read boolean")
    assert rows(audit.flagged_lectures(a), "flag", "pos", "lecture", "detail") == [("lost diagrams", 1, "x", "4 cues"), ("short read", 1, "x", "2/5")]


def test_agreement_of_passages(spark):
    """Small changes in long texts, moved and missing parts; equal texts and those of too different length need no comparison."""
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8))) for _ in range(400))
    words = text.split()
    cases = {
        "same": (text, text.replace(" ", "\n  ")),
        "one more": (text, text + " x"),
        "one changed": (text, " ".join([*words[:200], "zzzz", *words[201:]])),
        "a stretch changed": (text, " ".join([*words[:100], *("q" * len(w) for w in words[100:140]), *words[140:]])),
        "moved": (text, " ".join([*words[200:], *words[:200]])),
        "half": (text, " ".join(words[:200])),
        "short": ("a cat sat", "a cat sit"),
        "empty": ("", ""),
    }
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], "source string, original string, rewritten string")
    got = {r.source: r for r in pages.passage_agreement(df).collect()}
    assert got["same"].agreement == 1.0 and got["empty"].agreement == 1.0 and got["half"].verified is False
    for k in ("one more", "one changed", "a stretch changed", "short"):
        a, b = (" ".join(x.split()) for x in cases[k])
        assert got[k].agreement == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), abs=0.005), k
    assert [got[k].verified for k in ("one more", "one changed", "a stretch changed", "short")] == [True, True, False, False]
    assert got["moved"].agreement < 0.7
