"""Small cases with known outcomes: what the operators must and must not do."""

import numpy as np
from pyspark.sql import functions as F

from chalkline.functions import text as T
from chalkline.functions import udf
from chalkline.operators import audit, bib, diagrams, frames, joins, latex


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_reference_spellings_and_wrapped_lists(spark):
    body = r"\ref{a} \cref{b,\n c} \Cref*{d} \eqref{e} \labelcref{f} \autoref{g} \pageref{h} \label{no}".replace(r"\n", "\n")
    assert one(spark, T.references(F.col("b")), b=body) == list("abcdefgh")


def test_numbering_is_idempotent_and_reversible(spark):
    body = (
        "\\begin{equation}a\\label{x}\\end{equation} \\begin{equation}b\\label{y}\\end{equation}"
        " \\begin{equation}c\\tag{1}\\end{equation} \\begin{equation*}d\\label{z}\\end{equation*} \\cref{x} \\eqref{z}"
    )
    s = spark.createDataFrame([(1, 1, body)], "course int, lecture int, body string")
    once = latex.normalize_numbering(s)
    first = once.first()
    assert (first.unnumbered, first.numbered) == (1, 1)
    assert "\\begin{equation*}b" in first.body and "\\begin{equation}d" in first.body and "\\tag{1}\\end{equation}" in first.body
    again = latex.normalize_numbering(once.select("course", "lecture", "body")).first()
    assert (again.unnumbered, again.numbered, again.body) == (0, 0, first.body)


def test_section_guard_reasons(spark):
    real = "\\section{S}" + "\\begin{lemma}x\\end{lemma}" * 3 + "y" * 4000
    bodies = ["", "  I'll wait for it", "plain", "\\section{S} short", "\\section{S}" + "z" * 5000, real, None]
    s = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    got = [r.reason for r in audit.section_guard(s).orderBy("n").collect()]
    assert got == ["empty", "narration", "no heading", "too short", "few environments", None, "empty"]


def test_clock_rounds_half_to_even_and_seconds_reads_back(spark):
    assert [one(spark, T.clock(F.col("s")), s=x) for x in (0.5, 1.5, 3661.0, -4.0)] == ["00:00:00", "00:00:02", "01:01:01", "00:00:00"]
    assert [one(spark, T.seconds(F.col("s")), s=x) for x in ("754", "12:34", "[00:12:34]", "1:2:3:4", "x", "")] == [754.0, 754.0, 754.0, None, None, None]


def test_todo_bodies_with_nested_and_escaped_braces(spark):
    body = "\\todo{a {b} c} \\todonotes \\todo[inline]{two\nlines \\} x} \\todos{no} \\todo{open"
    s = spark.createDataFrame([(1, 1, body)], "course int, lecture int, body string")
    assert [r.todo for r in latex.todo_items(s).orderBy("pos").collect()] == ["a {b} c", "two lines \\} x", "open"]


def test_boards_opened_null_is_not_zero(spark):
    runs = spark.createDataFrame(
        [("a", "write", True, None), ("b", "write", True, ["1", "2", "3", "… [+2 more]"]), ("c", "write", False, ["1"])],
        "lecture string, role string, closed boolean, boards array<string>",
    )
    assert rows(audit.boards_opened(runs), "lecture", "opened") == [("a", 0), ("b", 5), ("c", None)]


def test_error_log_in_both_forms(spark):
    log = ["noise", "! Undefined control sequence.", "<recently read>", "l.7 \\foo", "  rest", "./d.tex:9: Missing $", "", "! Emergency stop."]
    df = spark.createDataFrame([("x", i, s) for i, s in enumerate(log, 1)], "doc string, line_no int, line string")
    assert rows(latex.error_blocks(df), "message", "line", "detail") == [
        ("Missing $", 9, ""), ("Undefined control sequence.", 7, "<recently read>\nl.7 \\foo\n  rest"),
    ]


def test_tidy_keeps_foreign_urls_and_both_layouts(spark):
    entries = [
        "@misc{a, title={T}, eprint={2102.13459}, archivePrefix={arXiv}, url={https://arxiv.org/abs/2102.13459}, year=2021}",
        "@article{b,\n  doi = {10.1/x},\n  url = {https://author.example/paper.pdf},\n}",
        "@article{c,\n  DOI = {https://doi.org/10.1234/Ab},\n  url = {http://dx.doi.org/10.1234/ab},\n  urldate = {2020-01-01},\n}",
    ]
    df = spark.createDataFrame(list(enumerate(entries)), "pos int, entry string")
    got = [(r.changed, r.entry) for r in bib.tidy_bibliography(df).orderBy("pos").collect()]
    assert got[0] == (True, "@misc{a, title={T}, eprint={2102.13459}, archivePrefix={arXiv}, year=2021}")
    assert got[1] == (False, entries[1])
    assert got[2] == (True, "@article{c,\n  DOI = {10.1234/Ab},\n}")


def test_diagram_directions_labels_and_phantoms(spark):
    d = "\\begin{tikzcd}\nA \\arrow[r, \"f\"] \\arrow[rrrr] & B \\arrow[dr, hook] \\arrow[dr, phantom] \\\\\n & {} & C \\arrow[ul]\n\\end{tikzcd}"
    cells = diagrams.diagram_cells(spark.createDataFrame([(1, d)], "diagram int, latex string"))
    got = rows(diagrams.diagram_edges(cells), "source", F.coalesce("target", F.lit("-")).alias("t"), "off_grid", F.coalesce("label", F.lit("")).alias("l"), "style")
    assert got == [("A", "-", True, "", []), ("A", "B", False, "f", []), ("B", "C", False, "", ["hook"]), ("C", "B", False, "", [])]


def test_unique_names_step_over_taken_ones(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "a-2"), (1, 4, "a")], "grp int, pos int, name string")
    assert rows(joins.unique_names(df), "pos", "unique") == [(1, "a"), (2, "a-3"), (3, "a-2"), (4, "a-4")]


def test_quote_runs_over_segments(spark):
    seg = spark.createDataFrame([("l", 0, 0.0, "So let us"), ("l", 1, 30.0, "Take, a prime; p")], "lecture string, seq int, start double, text string")
    q = spark.createDataFrame([(1, "let us take a PRIME ... q"), (2, "a prime"), (3, "us take b c")], "quote int, text string")
    assert rows(joins.locate_quotes(q, seg), "quote", "n", "pos", "start") == [(1, 5, 2, 0.0)]


def boards_seen(spark, series, fine=None):
    def table(masks):
        flat = [("v", i, [bool(x) for x in m.ravel()]) for i, m in enumerate(masks)]
        return spark.createDataFrame(flat, "video string, i int, mask array<boolean>").repartition(3)

    size = fine[0].shape if fine is not None else None
    found = frames.segment_boards(table(series), *series[0].shape, fine=None if fine is None else table(fine), fine_size=size)
    return rows(found, "board", "lo", "hi")


def test_segmentation_finds_a_revisit(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.random((20, 30)) < 0.1 for _ in range(2))
    assert boards_seen(spark, [a] * 30 + [b] * 30 + [a] * 30) == [(1, 0.0, 30.0), (1, 63.0, 90.0), (2, 33.0, 60.0)]


def test_segmentation_rules(spark):
    """A fuller view takes over, short disturbances don't count, a blank frame ends a stretch."""
    rng = np.random.default_rng(3)
    a, noise = rng.random((20, 30)) < 0.1, rng.random((20, 30)) < 0.1
    more = a | (rng.random((20, 30)) < 0.05)
    blank = np.zeros((20, 30), bool)
    assert boards_seen(spark, [a] * 10 + [more] * 10 + [noise] * 3 + [more] * 7 + [blank] * 5 + [more] * 5) == [(1, 0.0, 30.0), (1, 35.0, 40.0)]


def test_segmentation_finer_masks_decide_a_revisit(spark):
    """Two boards that look alike in the small masks and not in the wide ones stay apart."""
    rng = np.random.default_rng(4)
    a, b = (rng.random((20, 30)) < 0.1 for _ in range(2))
    small = [a] * 20 + [b] * 20 + [a] * 20
    first, second, third = (rng.random((40, 60)) < 0.1 for _ in range(3))
    assert [x[0] for x in boards_seen(spark, small)] == [1, 1, 2]
    assert [x[0] for x in boards_seen(spark, small, [first] * 20 + [second] * 20 + [third] * 20)] == [1, 2, 3]
    assert [x[0] for x in boards_seen(spark, small, [first] * 20 + [second] * 20 + [first] * 20)] == [1, 1, 2]


def test_aligned_containment_follows_a_pan(spark):
    rng = np.random.default_rng(9)
    a = rng.random((20, 30)) < 0.1
    masks = [a, np.roll(a, (2, -3), axis=(0, 1)), rng.random((20, 30)) < 0.1]
    df = spark.createDataFrame([("v", i, [bool(x) for x in m.ravel()]) for i, m in enumerate(masks)], "video string, i int, mask array<boolean>")
    plain, aligned = (dict((i, s) for i, s in rows(frames.neighbour_containment(df, size), "i", "score")) for size in (None, (20, 30)))
    assert plain[0] < 0.4 and aligned[0] == 1.0 and aligned[1] < 0.6


def test_requested_language(spark):
    assert [one(spark, T.requested_language(F.col("v").cast("string")), v=x) for x in ("auto", " Detect ", "", " de ", "en")] == [None, None, None, "de", "en"]
    df = spark.createDataFrame([("l", "la")], "lecture string, detected_language string")
    assert [audit.language_mismatch(df, x).count() for x in (None, "la", "auto", "EN")] == [1, 0, 0, 1]


def test_camera_motion_and_zoomed_boards(spark):
    """A panning video moves and a still one doesn't; a board seen again at another zoom is merged in the moving video only."""
    rng = np.random.default_rng(6)
    wide = rng.random((24, 32)) < 0.15
    flat = lambda m: [bool(x) for x in m.ravel()]
    pan = [("pan", i, flat(np.roll(wide, (i // 5) * 5, axis=1))) for i in range(40)] + [("still", i, flat(wide)) for i in range(40)]
    motion = frames.camera_motion(spark.createDataFrame(pan, "video string, i int, mask array<boolean>"), 24, 32)
    assert rows(motion, "video", "motion") == [("pan", 1.0), ("still", 0.0)]
    zoomed = np.zeros((24, 32), bool)
    zoomed |= np.kron(wide, np.ones((2, 2), bool))[12:36, 16:48]
    other = rng.random((24, 32)) < 0.15
    boards = [(v, n, 30.0 * n, 30.0 * n + 20, 30.0 * n, float(m.mean()), m.astype(np.uint8).tobytes()) for v in ("pan", "still") for n, m in ((1, wide), (2, zoomed), (3, other))]
    merged = frames.merge_zoomed(spark.createDataFrame(boards, frames.BOARDS), motion, 24, 32)
    got = rows(merged, "video", "board", "lo")
    assert [x[:2] for x in got if x[0] == "still"] == [("still", 1), ("still", 2), ("still", 3)]
    assert ("pan", 1, 60.0) in got


def strokes(seed, n=60, h=90, w=160):
    rng = np.random.default_rng(seed)
    out = np.zeros((h, w), bool)
    for y, x in zip(rng.integers(4, h - 4, n), rng.integers(4, w - 10, n), strict=True):
        out[y : y + 2, x : x + 8] = True
    return out


def test_zoomed_views_match_and_other_boards_do_not():
    """Whole boards drawn at another size, and views of the same size that were zoomed and moved."""
    for seed in (1, 2):
        one = strokes(seed)
        for s in (0.6, 0.7, 0.8, 1.25, 1.5, 1.75, 2.0):
            h, w = round(90 * s), round(160 * s)
            whole = one[np.ix_((np.arange(h) / s).astype(int), (np.arange(w) / s).astype(int))]
            assert frames.zoom_score(one, whole) >= frames.ZOOM_MATCH
            view = frames.moved(frames.zoomed(one, s, one.shape)[0], (5, -12))
            assert frames.zoom_score(one, view) >= frames.ZOOM_MATCH
            assert any(abs(z / s - 1) < 0.06 for z in frames.zooms(one, view))
    assert all(frames.zoom_score(strokes(1), strokes(k)) < frames.ZOOM_MATCH for k in range(9, 15))
    assert frames.zoom_score(strokes(1), np.zeros((90, 160), bool)) == 0.0


def test_near_pixels_and_moves_against_loops():
    rng = np.random.default_rng(4)
    m = rng.random((9, 13)) < 0.1
    want = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m), strict=True):
        want[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3] = True
    assert (frames.near(m) == want).all()
    assert (frames.moved(m, (2, -3))[2:, :-3] == m[:-2, 3:]).all() and not frames.moved(m, (2, -3))[:2].any()


def test_medians_in_tiles_and_blocks_against_a_plain_median(spark):
    """Tiles that don't divide the pixels, blocks shorter than the window, and nulls."""
    rng = np.random.default_rng(5)
    x = rng.random((23, 10))
    df = spark.createDataFrame([("v", i, [None if (i, p) == (3, 4) else float(v) for p, v in enumerate(row)]) for i, row in enumerate(x)], "video string, i int, px array<double>")
    x[3, 4] = np.nan
    for tile, block in ((4, 2), (3, 8), (64, 64)):
        got = {r.i: r.px for r in frames.pack(frames.median_tiles(df, 7, tile, block)).collect()}
        assert sorted(got) == list(range(23))
        assert all(np.allclose(got[i], np.nanmedian(x[max(0, i - 3) : i + 4], axis=0)) for i in got)
    assert frames.rolling_median(df, 7).where("i = 22").count() == 10


def test_shift_brings_a_pan_back():
    rng = np.random.default_rng(2)
    a = rng.random((24, 32)) < 0.2
    assert udf.shift(a, np.roll(a, (3, -5), axis=(0, 1))) == (-3, 5)


def test_same_results_for_any_partitioning(spark):
    log = spark.createDataFrame([(i % 3, i, float(i * 7 % 11), float(i * 7 % 11 + 2)) for i in range(60)], "video int, n int, lo double, hi double")
    want = rows(joins.merge_intervals(log, 0.5), "video", "lo", "hi", "n")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert rows(joins.merge_intervals(log.repartition(7), 0.5), "video", "lo", "hi", "n") == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
