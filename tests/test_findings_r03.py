"""Small cases of the findings of round 3."""

import glob
import re

from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_boards_of_many_videos_share_files(spark, tmp_path):
    from chalkline.sources import sinks

    path = f"{tmp_path}/boards"
    sinks.write_boards(spark.range(400).select((F.col("id") % 200).alias("video"), F.col("id").alias("board"), F.lit(1.0).alias("lo"), F.lit(2.0).alias("hi")), path)
    assert len(glob.glob(f"{path}/**/*.json", recursive=True)) < 20
    back = spark.read.schema("video bigint, board bigint, lo double, hi double").json(path)
    assert sorted((r.video, r.board) for r in back.collect()) == sorted((k % 200, k) for k in range(400))


def test_macros_are_read_from_their_own_opener(spark):
    from chalkline.operators import latex

    text = "".join(f"\\newcommand{{\\m{'xyz'[k % 3]}}}[{k % 3}]{{é{{{k}}}}}\n" for k in range(300))
    table = latex.macro_table(spark.createDataFrame([(1, text + "\\begin{document}\\newcommand{\\no}{}")], "course int, text string"))
    assert sorted((r.name, r.arity, r.body) for r in table.collect()) == [("mx", 0, "é{297}"), ("my", 1, "é{298}"), ("mz", 2, "é{299}")]
    assert "substring(text" not in plan(table)  # which would read the whole text once for every macro


def test_lines_are_numbered_before_their_playlists_come_in(spark):
    from chalkline.sources import readers

    lines = [(1, 1, "a"), (1, 2, "https://x/?list=L"), (1, 3, "https://x/?list=E"), (1, 4, "https://x/?list=none"), (1, 5, "# no"), (1, 6, "abcdefghijk"), (2, 1, "https://x/?list=L")]
    entries = [f"e{k}" for k in range(2047)] + [None, "ABCDEFGHIJK"]
    out = readers.read_inputs(spark.createDataFrame(lines, "course int, line_no int, line string"), spark.createDataFrame([("L", entries), ("E", [])], "playlist string, entries array<string>"))
    watch = "https://www.youtube.com/watch?v="
    whole = [*entries[:2047], "https://x/?list=L", watch + "ABCDEFGHIJK"]
    one = ["a", *whole, "https://x/?list=E", "https://x/?list=none", watch + "abcdefghijk"]
    assert sorted(map(tuple, out.collect())) == sorted([(1, i + 1, x) for i, x in enumerate(one)] + [(2, i + 1, x) for i, x in enumerate(whole)])
    text = plan(out)
    assert text.index("Generate posexplode") < text.rindex("Window")  # rows are made above the numbering, not below it


def test_boards_are_compared_at_once_as_one_by_one(spark):
    import time

    import numpy as np

    from chalkline.operators import frames

    rng = np.random.default_rng(5)
    old = rng.random((300, 9, 7)) < rng.random((300, 1, 1)) * 0.3
    new = [rng.random((9, 7)) < 0.2, np.zeros((9, 7), bool), np.roll(old[3], (2, -3), axis=(0, 1))]
    for mask in new:
        assert frames.aligned_containments(old, mask).tolist() == [frames.aligned_containment(b, mask) for b in old]
    masks = np.eye(64 * 64, dtype=bool).reshape(-1, 64, 64)[:1500]
    start = time.process_time()
    frames.aligned_containments(masks[:600], masks[700])
    assert frames.STACKED < masks[:600].size and time.process_time() - start < 10


def test_every_video_may_have_a_task(spark):
    from chalkline.operators import frames

    rows = spark.range(40).select(F.concat(F.lit("v"), F.col("id") % 10).alias("video"), (F.col("id") / 10).cast("int").alias("i"))
    masks = rows.withColumn("mask", F.array(*(F.lit(k == 0) for k in range(64))))
    boards = frames.segment_boards(masks, 8, 8)
    assert boards.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert boards.count() == 10


def test_merging_finds_the_boards_once(spark):
    from chalkline.operators import frames

    boards = spark.createDataFrame([("a", 1, 0.0, 1.0, 0.0, 0.5, bytearray(b"\1" * 64)), ("a", 2, 1.0, 2.0, 1.0, 0.6, bytearray(b"\1" * 64)), ("b", 1, 0.0, 1.0, 0.0, 0.5, bytearray(b"\1" * 64)), ("b", 2, 1.0, 2.0, 1.0, 0.5, bytearray(b"\1" * 64))], frames.BOARDS)
    found = boards.mapInPandas(lambda x: x, frames.BOARDS)
    out = frames.merge_zoomed(found, spark.createDataFrame([("a", 0.5), ("b", 0.0)], "video string, motion double"), 8, 8)
    assert plan(out).count("MapInPandas") == 1
    assert sorted((r.video, r.board) for r in out.collect()) == [("a", 1), ("a", 1), ("b", 1), ("b", 2)]


def test_question_states_merge_in_the_engine(spark, tmp_path):
    import json
    import os

    from chalkline.streaming import jobs

    path = tmp_path / "in"
    path.mkdir()
    line = lambda seq, answer=None, told=False, used=False: json.dumps({"lecture": 1, "id": 1, "seq": seq, "answer": answer, "delivered": told, "applied": used}) + "\n"
    for n, text in enumerate((line(1, used=True) + line(5, "late"), line(2, told=True) + line(3, ""), line(7, used=True))):
        (path / f"{n}.json").write_text(text)
        os.utime(path / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = jobs.tail_json(spark, str(path), "lecture long, id int, seq long, answer string, delivered boolean, applied boolean", 1)
    out = spark.read.parquet(jobs.drain(jobs.question_states(stream), str(tmp_path / "out"), "update"))
    states = sorted(tuple(r) for r in out.select("updates", "answer", "delivered", "redelivered", "applied").collect())
    assert states == [(2, "late", False, False, False), (4, "", True, True, False), (5, "", True, True, True)]


def test_runs_are_merged_in_the_engine(spark, tmp_path):
    import json
    import os

    from chalkline.streaming import jobs

    path = tmp_path / "in"
    path.mkdir()
    line = lambda t, name, k=None, s=None: json.dumps({"run": "a", "t": t, "name": name, "input": k and json.dumps({"file_path": f"/out/boards/board-{k:03d}.png"}), "seconds": s, "error": k == 2}) + "\n"
    first = line("2024-01-01 10:00:00", "b", 1, 1.0) + line("2024-01-01 12:00:00", "a", 2) + line("2024-01-01 22:00:01", "a", 1, 2.0)
    # one exactly idle after the last, one that closes the gap before it, and one that begins anew
    for n, text in enumerate((first, line("2024-01-01 20:00:00", "b", 2, 0.5) + line("2024-01-02 10:00:01", "c"), line("2024-01-02 22:00:02", "c"), line("2024-03-01 00:00:00", "z"))):
        (path / f"{n}.json").write_text(text)
        os.utime(path / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    summary = jobs.run_summary(jobs.tail_json(spark, str(path), "run string, t timestamp, name string, input string, seconds double, error boolean", 1))
    assert "InPandas" not in summary._jdf.queryExecution().analyzed().toString()
    out = spark.read.parquet(jobs.drain(summary, str(tmp_path / "out")))
    rows = sorted((r.events, r.seconds, r.errors, r.boards, r.tools) for r in out.collect())
    assert rows == [(1, None, 0, 0, {"c": 1}), (5, 3.5, 2, 2, {"a": 2, "b": 2, "c": 1})]


def test_errors_of_one_key_meet_its_sections_without_another_shuffle(spark):
    from chalkline.operators import latex

    n = 300  # as many errors as sections, all of one key: the pairs are the result and should not be dealt out again
    sections = spark.range(n).select(F.lit(1).alias("doc"), F.col("id").cast("int").alias("pos"), F.col("id").cast("string").alias("lecture"), F.lit("\\cite{k, j}").alias("body"))
    errors = spark.range(n).select(F.lit(1).alias("doc"), "id", F.lit(None).cast("int").alias("line"), F.lit("m").alias("message"), F.array_compact(F.array(F.lit("k"), F.lit(None).cast("string"))).alias("citations")).withColumnRenamed("id", "error")
    more = spark.createDataFrame([(1, 1000, None, "m", ["j", "k", None]), (1, 1001, None, "m", []), (1, 1002, None, "m", ["no"]), (1, 1003, None, "m", ["no", "never"]), (1, 1004, None, "m", [None])], "doc int, error bigint, line int, message string, citations array<string>")
    spans = sections.select("doc", "pos", "lecture", F.lit(1).alias("lo"), F.lit(1).alias("hi"))
    preamble = spark.createDataFrame([], "doc int, additions string")
    out = latex.attribute_errors(errors.unionByName(more), spans, sections, preamble)
    rows = [tuple(r) for r in out.select("error", "lecture").collect()]
    assert sorted(x for x in rows if x[1] is None) == [(k, None) for k in (1001, 1002, 1003, 1004)]
    assert len(rows) == len(set(rows)) == (n + 1) * n + 4
    assert re.search(r"size\(keys#\d+, \w+\) < 2", plan(out))  # errors of one key need no gathering of their sections


def test_passages_are_judged_inside_their_rows(spark):
    from chalkline.operators import pages

    text = " ".join(f"w{k}  v" for k in range(100))
    rows = [(1, text, text + " x"), (2, text, "other"), (3, None, text), (4, text, text.replace(" ", "\n")), (5, text, text + " x")]
    out = pages.passage_agreement(spark.createDataFrame(rows, "source int, original string, rewritten string"))
    assert not {"Join", "Aggregate", "Window"} & set(re.findall(r"[A-Z][a-z]+", plan(out)))
    got = {r.source: r.agreement for r in out.collect()}
    n = len(" ".join(text.split()))
    assert got[1] == got[5] == 2 * n / (2 * n + 2) and got[4] == 1.0 and got[2] < 0.1 and got[3] == 0.0


def test_attempts_meet_their_case_once(spark):
    from chalkline.operators import diagrams

    truth_nodes = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, None), (2, "a")], "case int, name string")
    truth_arrows = spark.createDataFrame([(1, "a", "b", ""), (1, "b", "c", "epi"), (1, "b", "c", ""), (3, "x", "y", "")], "case int, s string, t string, style string")
    nodes = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 1, None), (1, 1, "z"), (1, 2, "b"), (3, 1, "x"), (4, 1, None), (None, 1, "q")], "case int, attempt int, name string")
    arrows = spark.createDataFrame([(1, 1, "b", "a", ""), (1, 1, "b", "c", "epi"), (1, 1, "b", "c", None), (1, 2, None, "b", ""), (5, 1, "a", "b", ""), (None, 1, "a", "b", "")], "case int, attempt int, s string, t string, style string")
    out = diagrams.score_diagrams(truth_nodes, truth_arrows, nodes, arrows)
    assert plan(out).count("Join") == 3
    names = ("case", "attempt", "nodes", "nodes_missing", "nodes_extra", "arrows_missing", "arrows_extra", "style_mismatch", "reversed", "wrong")
    got = sorted((tuple(r) for r in out.select(*names).collect()), key=lambda r: (r[0] is None, r))
    assert got == [(1, 1, 4, 3, 2, 1, 1, 1, 1, 8), (1, 2, 4, 2, 0, 3, 1, 0, 0, 6), (3, 1, 0, 0, 1, 1, 0, 0, 0, 2), (4, 1, 0, 0, 1, 0, 0, 0, 0, 1), (None, 1, 0, 0, 1, 0, 0, 0, 0, 1)]


def test_error_records_follow_from_one_order_of_the_log(spark):
    from chalkline.operators import latex

    lines = ["l.1 early", "! First.", "  ", "seen", "l.7 \\foo", "after", "not this", "l.9 nor this", "./a.tex:12: Second", *["more"] * 20, "! Third.", "l.3 x", " ", "late", "! Emergency stop."]
    out = latex.error_blocks(spark.createDataFrame([(1, n, x) for n, x in enumerate(lines)] + [(2, 0, "! Emergency stop."), (2, 1, None)], "doc int, line_no int, line string"))
    got = sorted((r.doc, r.message, r.line, r.detail) for r in out.collect())
    assert got == [(1, "First.", 7, "seen\nl.7 \\foo\nafter"), (1, "Second", 12, "\n".join(["more"] * 14)), (1, "Third.", 3, "l.3 x"), (2, "Emergency stop.", None, "")]
    assert not re.search(r"Window .*\[doc#\d+L?, block#\d+L?\]", plan(out))  # no other order for each record


def test_labels_and_references_of_a_course_meet_in_one_grouping(spark):
    from chalkline.operators import latex

    bodies = [(1, r"\label{a} \label{b} \ref{b, x}"), (1, r"\cref{a} \label{a}"), (2, r"\label{a}"), (2, None), (None, r"\label{a} \ref{a}"), (None, r"\ref{y}")]
    s = spark.createDataFrame([(c, n, b) for n, (c, b) in enumerate(bodies)], "course int, lecture int, body string")
    cited, uncited = latex.cited_labels(s), latex.uncited_labels(s)
    assert sorted(map(tuple, cited.collect())) == [(1, "a"), (1, "b")]
    assert sorted(map(tuple, uncited.collect()), key=str) == [(2, "a"), (None, "a")]
    assert "Join" not in plan(cited) + plan(uncited)  # sections made twice, and both sides hashed and sorted


def test_texts_of_sections_are_made_after_their_numbers_are_gathered(spark):
    from chalkline.plans import adapters

    above, below = plan(adapters.sections(spark, "/root/testdata/sf0.001")).split("Join", 1)
    assert "label{eq:" in above and "label{eq:" not in below


def test_no_task_gathers_all_missing_keys_of_a_course(spark):
    from chalkline.operators import latex

    bodies = [(1, " ".join(rf"\cite[p.~3]{{k{n} , k{n + 1},}}" for n in range(3000))), (2, r"\citep{a,b}"), (3, r"\cite{a}"), (None, r"\cite{n}"), (4, None)]
    s = spark.createDataFrame([(c, n, b) for n, (c, b) in enumerate(bodies)], "course int, lecture int, body string")
    bib = spark.createDataFrame([(1, "k0"), (1, "k10"), (1, "k10"), (2, "b"), (3, "a"), (None, "n"), (1, None)], "course int, cite_key string")
    got = latex.undefined_citations(s, bib)
    every = sorted(f"k{n}" for n in range(3001) if n not in (0, 10))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, every[:8], 2991), (2, ["a"], 0), (None, ["n"], 0)]
    assert "collect_set(cite_key" not in plan(got) and "Join" not in plan(got)
    assert "pmod(xxhash64(cite_key" in plan(got)  # a second key beside the course


def test_numbering_makes_sections_twice_and_cuts_odd_displays_as_the_reference_does(spark):
    import re

    from chalkline.operators import latex

    def expected(body, cited):
        def rewrite(m):
            if re.search(r"\\tag\*?\s*\{", m.group(2)):
                return m.group(0)
            want = "" if {x.strip() for x in re.findall(r"\\label\s*\{([^{}]*)\}", m.group(2))} & cited else "*"
            return f"\\begin{{equation{want}}}{m.group(2)}\\end{{equation{want}}}"

        return re.sub(r"(?s)\\begin\{equation(\*?)\}(.*?)\\end\{equation\1\}", rewrite, body)

    b, e, bs, es = "\\begin{equation}", "\\end{equation}", "\\begin{equation*}", "\\end{equation*}"
    bodies = ["", "text", f"{b}{e}", f"{b}é\\label{{ x }}{e}\n{bs}\\label{{y}}\n{es}", f"{bs}\\label {{x}}{es}{b}z{e}", f"{b}\\tags{{}}{e}{bs}\\tag* {{1}}\\label{{x}}{es}", f"{e}a{b}", "\\begin{equations}" + b + "\\begin{equationx}\\label{y}" + e]
    bodies += [x.replace("text", "te\0xt").replace("z", "\0") + "\0" for x in bodies] + ["\\cref{x} \\ref{q}"]
    s = spark.createDataFrame([(1, n, x) for n, x in enumerate([*bodies, None])] + [(None, 99, f"{b}\\label{{x}}{e}\\ref{{x}}")], "course int, lecture int, body string")
    once = latex.normalize_numbering(s)
    got = {r.lecture: r for r in once.collect()}
    assert [got[n].body for n in range(len(bodies))] == [expected(x, {"x", "q"}) for x in bodies]
    assert got[99].body == f"{bs}\\label{{x}}{es}\\ref{{x}}" and (got[3].unnumbered, got[3].numbered) == (0, 0) and (got[4].unnumbered, got[4].numbered) == (1, 1)
    changes = {(r.course, r.lecture): (r.unnumbered, r.numbered) for r in latex.numbering_changes(s).where("lecture IS NOT NULL").collect()}
    assert changes == {(r.course, r.lecture): (r.unnumbered, r.numbered) for r in got.values()}
    assert plan(once).count("LogicalRDD") == plan(latex.numbering_changes(s)).count("LogicalRDD") == 2


def test_a_review_makes_sections_once(spark):
    from chalkline.operators import latex

    al = lambda x: f"\\begin{{align*}}{x}\\end{{align*}}"
    bodies = [(1, al("\\label{a}\\label{a}") + al("\\label{b}") + "\\ref{c} \\ref{c,d}"), (1, al("\\label{c} \\tag{1}") + "\\begin{gather*}\\label{e}\\tags\\end{gather*}\\cref{a,e}"), (2, "\\ref{a}"), (2, None), (None, al("\\label{z}") + "\\ref{z}")]
    s = spark.createDataFrame([(c, n, b) for n, (c, b) in enumerate(bodies)], "course int, lecture int, body string")
    got = latex.numbering_review(s)
    none = "no label in the course"
    want = [(1, "a", 0, "align*", "unnumbered")] * 2 + [(1, "e", 1, "gather*", "unnumbered"), (1, "d", 0, none, "dangling"), (2, "a", 2, none, "dangling"), (None, "z", 4, none, "dangling")]
    assert sorted((tuple(r) for r in got.select("course", "label", "lecture", "context", "kind").collect()), key=str) == sorted(want, key=str)
    assert plan(got).count("LogicalRDD") == 1 and "Join" not in plan(got)


def test_an_index_holds_the_least_runs_without_slices(spark):
    from chalkline.operators import joins

    texts = [" ".join(str(n * n % k) for n in range(m)) for k, m in ((7, 40), (1, 30), (101, 300), (5, 6), (5, 5), (5, 2))] + ["", None]
    postings, _ = joins.source_index(spark.createDataFrame(list(enumerate(texts)), "source int, text string"))
    got = sorted((r.source, r.at, r.h) for r in postings.collect())
    want = []
    for n, text in enumerate(texts[:-1]):
        w = text.split(" ")
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(runs)], "i int, a string, b string, c string")
        h = [r.h for r in df.orderBy("i").select(F.xxhash64("a", "b", "c").alias("h")).collect()]
        want += sorted({(n, i, h[i]) for j in range(len(h) - 3) for i in range(j, j + 4) if h[i] == min(h[j : j + 4])})
    assert got == want
    assert "array_min(slice(" not in plan(postings)
