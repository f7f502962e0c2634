"""Queries of the LaTeX operators; the oracles work from the columns, never from the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.operators import latex as L
from chalkline.plans import adapters as A
from chalkline.plans.catalog import query

EDGES = "SELECT DISTINCT o_custkey % 10 AS course, l_orderkey AS lecture, 'eq:' || l_partkey || ':' || l_linenumber AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
DEFS = "SELECT DISTINCT o_custkey % 10 AS course, l_orderkey AS lecture, 'eq:' || l_orderkey || ':' || l_linenumber AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("reference_edges", EDGES)
def reference_edges(spark, sf):
    return L.reference_edges(A.sections(spark, sf))


@query("label_defs", DEFS)
def label_defs(spark, sf):
    return L.label_defs(A.sections(spark, sf))


@query("citation_matrix", f"SELECT course, r.lecture, d.lecture AS target, count(DISTINCT label) AS labels FROM ({EDGES}) r JOIN ({DEFS}) d USING (course, label) GROUP BY ALL")
def citation_matrix(spark, sf):
    return L.citation_matrix(A.sections(spark, sf))


@query("cited_labels", f"SELECT DISTINCT course, label FROM ({DEFS}) SEMI JOIN ({EDGES}) USING (course, label)")
def cited_labels(spark, sf):
    return L.cited_labels(A.sections(spark, sf))


@query("uncited_labels", f"SELECT DISTINCT course, label FROM ({DEFS}) ANTI JOIN ({EDGES}) USING (course, label)")
def uncited_labels(spark, sf):
    return L.uncited_labels(A.sections(spark, sf))


@query("dangling_refs", f"SELECT course, lecture, label FROM ({EDGES}) ANTI JOIN ({DEFS}) USING (course, label)")
def dangling_refs(spark, sf):
    return L.dangling_references(A.sections(spark, sf)).select("course", "lecture", "label")


@query("refs_except_labels", f"SELECT course, label FROM ({EDGES}) EXCEPT SELECT course, label FROM ({DEFS})")
def refs_except_labels(spark, sf):
    s = A.sections(spark, sf)
    return L.reference_edges(s).select("course", "label").subtract(L.label_defs(s).select("course", "label"))


@query("labels_intersect_refs", f"SELECT course, label FROM ({DEFS}) INTERSECT SELECT course, label FROM ({EDGES})")
def labels_intersect_refs(spark, sf):
    s = A.sections(spark, sf)
    return L.label_defs(s).select("course", "label").intersect(L.reference_edges(s).select("course", "label"))


# every display of the adapter is unstarred: an uncited one is starred once per line item
CITED = f"SELECT o_custkey % 10 AS course, l_orderkey AS lecture, l_linenumber, l_partkey, c.label IS NOT NULL AS cited FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT DISTINCT course, label FROM ({EDGES})) c ON c.course = o_custkey % 10 AND c.label = 'eq:' || l_orderkey || ':' || l_linenumber"
CHANGED = f"SELECT course, lecture, count(*) FILTER (WHERE NOT cited) AS unnumbered, 0::BIGINT AS numbered FROM ({CITED}) GROUP BY ALL"
PART = """'\\begin{equation' || star || '}' || chr(10) || '  x \\label{eq:' || lecture || ':' || l_linenumber || '}' || chr(10) || '\\end{equation' || star || '}' || chr(10) || 'See \\cref{eq:' || l_partkey || ':' || l_linenumber || '}.'"""


@query("normalize_numbering", f"""SELECT course, lecture, count(*) FILTER (WHERE NOT cited) AS unnumbered, 0::BIGINT AS numbered, md5(string_agg({PART}, chr(10) ORDER BY l_linenumber, l_partkey)) AS body
FROM (SELECT *, CASE WHEN cited THEN '' ELSE '*' END AS star FROM ({CITED})) GROUP BY ALL""")
def normalize_numbering(spark, sf):
    return L.normalize_numbering(A.sections(spark, sf)).select("course", "lecture", "unnumbered", "numbered", F.md5("body").alias("body"))


@query("numbering_changes", f"SELECT course, lecture, sum(unnumbered)::BIGINT AS unnumbered, sum(numbered)::BIGINT AS numbered FROM ({CHANGED}) GROUP BY ROLLUP (course, lecture)")
def numbering_changes(spark, sf):
    return L.numbering_changes(A.sections(spark, sf))


def _aligned(spark, sf):
    """Sections whose displays are starred multi-line ones, tagged for even part keys."""
    l = A.section_rows(spark, sf)  # noqa: E741
    tag = lambda x: F.when(x["l_partkey"] % 2 == 0, " \\tag{*}").otherwise("")
    part = lambda x: F.concat(F.lit("\\begin{align*} x \\label{eq:"), F.col("lecture"), F.lit(":"), x["l_linenumber"], F.lit("}"), tag(x), F.lit("\\end{align*} \\eqref{eq:"), x["l_partkey"], F.lit(":"), x["l_linenumber"], F.lit("}"))
    items = l.groupBy("course", "lecture").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("items"))
    return items.select("course", "lecture", F.array_join(F.transform("items", part), "\n").alias("body"))


@query("numbering_review", f"""SELECT DISTINCT course, lecture, label, 'align*' AS context, 'unnumbered' AS kind FROM (SELECT o_custkey % 10 AS course, l_orderkey AS lecture, 'eq:' || l_orderkey || ':' || l_linenumber AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 2 = 1) SEMI JOIN ({EDGES}) USING (course, label)
UNION ALL SELECT course, lecture, label, 'no label in the course', 'dangling' FROM ({EDGES}) ANTI JOIN ({DEFS}) USING (course, label)""")
def numbering_review(spark, sf):
    return L.numbering_review(_aligned(spark, sf)).select("course", "lecture", "label", "context", "kind").distinct()


@query("review_report", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS lecture_num, 'eq:' || o_custkey AS label FROM orders")
def review_report(spark, sf):
    """Every third order is an item of its lecture, the others are course-wide."""
    o = A.table(spark, sf, "orders")
    return L.review_report(o.select(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("lecture_num"), F.concat(F.lit("eq:"), "o_custkey").alias("label")))


@query("todo_items", """SELECT o_orderkey AS lecture, (row_number() OVER (PARTITION BY o_orderkey ORDER BY k) - 1)::INTEGER AS pos, CASE k WHEN 0 THEN 'check {\\mathbb Z} ' || o_custkey ELSE 'two lines \\} here' END AS todo
FROM orders, (VALUES (0), (1)) v(k) WHERE k <= o_orderkey % 2""")
def todo_items(spark, sf):
    second = F.when(F.col("o_orderkey") % 2 == 1, "\\todos{no} \\todo {two\n lines \\} here}").otherwise("\\todonotes")
    body = F.concat(F.lit("a \\todo[inline]{check {\\mathbb Z} "), "o_custkey", F.lit("} b "), second)
    return L.todo_items(A.table(spark, sf, "orders").select(F.lit(0).alias("course"), F.col("o_orderkey").alias("lecture"), body.alias("body"))).select("lecture", "pos", "todo")


def _parts(spark, sf):
    return A.table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("doc"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("lecture"), F.repeat(F.lit("line\n"), (F.col("o_orderkey") % 5).cast("int")).alias("body"))


SPANS = "SELECT o_custkey % 10 AS doc, o_orderkey AS pos, o_orderkey::VARCHAR AS lecture, (coalesce(sum(o_orderkey % 5 + 2) OVER w, 0) + 1)::BIGINT AS lo, (coalesce(sum(o_orderkey % 5 + 2) OVER w, 0) + 1 + o_orderkey % 5)::BIGINT AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey % 10 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("line_spans", SPANS)
def line_spans(spark, sf):
    return L.line_spans(_parts(spark, sf))


@query("assemble", "SELECT o_custkey % 10 AS course, string_agg(repeat('line' || chr(10), (o_orderkey % 5)::INTEGER), chr(10) || chr(10) ORDER BY o_orderkey) AS document FROM orders GROUP BY 1")
def assemble(spark, sf):
    return L.assemble(_parts(spark, sf).select(F.col("doc").alias("course"), F.col("pos").alias("lecture_num"), "lecture", "body"))


def _log(spark, sf):
    """Line items as log lines: an error head in either form, a detail, its place; overfull boxes; bookmarks."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    head = F.when(p % 2 == 0, F.concat(F.lit("! Undefined thing "), p)).otherwise(F.concat(F.lit("./main.tex:"), p, F.lit(": Undefined thing "), p))
    lines = F.array(head, F.lit("  "), F.concat(F.lit("detail "), n), F.concat(F.lit("l."), p + 1, F.lit(" \\foo")), F.lit("after"),
                    F.concat(F.lit("Overfull \\hbox ("), F.round(F.col("l_extendedprice") % 100, 1), F.lit("pt too wide) in paragraph at lines "), p, F.lit("--9")),
                    F.concat(F.lit("Package hyperref Warning: removing `math shift' on input line "), n))
    rows = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.struct("l_partkey", "l_linenumber", "l_extendedprice").alias("k"), F.posexplode(lines).alias("i", "line"))
    from pyspark.sql import Window

    return rows.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("k", "i")).alias("line_no"), "line")


@query("error_blocks", """SELECT l_orderkey AS doc, 'Undefined thing ' || l_partkey AS message, (l_partkey + 1)::INTEGER AS line,
'detail ' || arg_min(l_linenumber, (l_linenumber, l_extendedprice)) || chr(10) || 'l.' || (l_partkey + 1) || ' \\foo' || chr(10) || 'after' AS detail FROM lineitem GROUP BY l_orderkey, l_partkey""")
def error_blocks(spark, sf):
    return L.error_blocks(_log(spark, sf))


@query("presentation_warnings", """SELECT DISTINCT l_orderkey AS doc, 'overfull' AS kind, round(l_extendedprice % 100, 1) AS points, l_partkey::INTEGER AS at FROM lineitem WHERE round(l_extendedprice % 100, 1) >= 2
UNION ALL SELECT DISTINCT l_orderkey, 'bookmark', NULL, l_linenumber FROM lineitem""")
def presentation_warnings(spark, sf):
    return L.presentation_warnings(_log(spark, sf))


@query("error_tokens", "SELECT o_orderkey AS error, ['pkg' || o_custkey, 'macro', 'env' || chr(97 + (o_orderkey % 3)::INTEGER)] AS tokens FROM orders")
def error_tokens(spark, sf):
    env = F.element_at(F.array(*(F.lit(x) for x in "abc")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    m = F.concat(F.lit("File `pkg"), "o_custkey", F.lit(".sty' not found \\macro \\a \\macro Environment env"), env, F.lit(" undefined"))
    return A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("error"), L.error_tokens(m).alias("tokens"))


@query("undefined_citations", """WITH m AS (SELECT DISTINCT o_custkey % 10 AS course, 'k' || l_partkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size % 3 = 0))
SELECT course, list_slice(list(k ORDER BY k), 1, 8) AS keys, greatest(count(*) - 8, 0)::INTEGER AS more FROM m GROUP BY course""")
def undefined_citations(spark, sf):
    r = A.section_rows(spark, sf)
    cite = lambda p: F.concat(F.lit("\\citep[p.~3]{k"), p, F.lit(" , k"), p, F.lit("}"))
    s = r.groupBy("course", "lecture").agg(F.collect_list("l_partkey").alias("keys")).select("course", "lecture", F.array_join(F.transform("keys", cite), " ").alias("body"))
    bib = A.table(spark, sf, "part").where("p_size % 3 = 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).alias("course"), F.concat(F.lit("k"), "p_partkey").alias("cite_key"))
    return L.undefined_citations(s, bib)


def _errors(spark, sf):
    """Line items as errors of a course document: by citation, by line, or by identifier."""
    k, p = F.col("l_linenumber") % 3, F.col("l_partkey")
    rows = A.table(spark, sf, "lineitem").join(A.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy((F.col("o_custkey") % 10).alias("doc"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("error")).agg(F.min("l_partkey").alias("l_partkey"), F.min("l_linenumber").alias("l_linenumber")).select(
        "doc", "error", F.when(k == 1, p.cast("int")).alias("line"), F.concat(F.lit("Undefined \\macro"), F.lit(" `id-"), p % 5000, F.lit("-x'")).alias("message"),
        F.when(k == 0, F.array(F.concat(F.lit("key"), p % 4000))).alias("citations"),
    )


def _sources(spark, sf):
    n = F.col("o_orderkey")
    body = F.concat(F.lit("\\cite{key"), n % 6000, F.lit("} id-"), n % 4500, F.lit("-x\n\n"))
    return A.table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("doc"), n.cast("int").alias("pos"), n.cast("string").alias("lecture"), body.alias("body"))


@query("attribute_errors", """WITH s AS (SELECT o_custkey % 10 AS doc, o_orderkey AS pos, o_orderkey::VARCHAR AS lecture, 4 * (row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) - 1) + 11 AS lo FROM orders),
e AS (SELECT o_custkey % 10 AS doc, l_orderkey * 8 + l_linenumber AS error, min(l_partkey) AS p, l_linenumber % 3 AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
c AS (SELECT e.doc, error, lecture FROM e JOIN s ON e.doc = s.doc AND k = 0 AND pos % 6000 = p % 4000),
l AS (SELECT e.doc, error, 'preamble' AS lecture FROM e WHERE k = 1 AND p < 11 UNION ALL SELECT e.doc, error, lecture FROM e JOIN s ON e.doc = s.doc AND k = 1 AND p BETWEEN lo AND lo + 2),
i AS (SELECT e.doc, error, arg_min(lecture, pos) AS lecture FROM e JOIN s ON e.doc = s.doc AND pos % 4500 = p % 5000 WHERE k <> 0 AND NOT EXISTS (SELECT 1 FROM l WHERE l.error = e.error AND l.doc = e.doc) GROUP BY ALL),
f AS (SELECT * FROM c UNION ALL SELECT * FROM l UNION ALL SELECT * FROM i)
SELECT * FROM f UNION ALL SELECT doc, error, NULL FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.error = e.error AND f.doc = e.doc)""")
def attribute_errors(spark, sf):
    s = _sources(spark, sf)
    spans = L.line_spans(s).withColumn("lo", F.col("lo") + 10).withColumn("hi", F.col("hi") + 10)
    preamble = s.select("doc").distinct().withColumn("additions", F.lit("\\usepackage{z}"))
    return L.attribute_errors(_errors(spark, sf), spans, s, preamble)


@query("localize_errors", f"""WITH s AS ({SPANS}), e AS (SELECT o_custkey % 10 AS doc, o_orderkey AS error, o_orderkey % 400 + 1 AS line FROM orders)
SELECT e.doc, error, lecture, line - lo + 1 AS section_line, 'text ' || line AS source FROM e LEFT JOIN s ON e.doc = s.doc AND line BETWEEN lo AND hi""")
def localize_errors(spark, sf):
    o = A.table(spark, sf, "orders")
    e = o.select((F.col("o_custkey") % 10).alias("doc"), F.col("o_orderkey").alias("error"), (F.col("o_orderkey") % 400 + 1).alias("line"))
    lines = e.select("doc", F.col("line").alias("line_no"), F.concat(F.lit("text "), "line").alias("line")).distinct()
    return L.localize_errors(e, L.line_spans(_parts(spark, sf)), lines)


@query("outline", """SELECT o_orderkey AS doc, (3 + o_orderkey % 4)::INTEGER AS line_no, 'section' AS kind, 'Title {A} ' || o_custkey AS title FROM orders
UNION ALL SELECT o_orderkey, (4 + o_orderkey % 4)::INTEGER, 'theorem', 'On $\\Z[S]$ ' || o_custkey FROM orders UNION ALL SELECT o_orderkey, (5 + o_orderkey % 4)::INTEGER, 'lemma', '' FROM orders""")
def outline(spark, sf):
    body = F.concat(F.repeat(F.lit("x\n"), (F.col("o_orderkey") % 4).cast("int")), F.lit("\\subsection{}\n\n\\section*{Title  {A} "), "o_custkey",
                    F.lit("}\n\\begin{theorem}[On $\\Z[S]$ "), "o_custkey", F.lit("]\n\\begin{lemma} y\n\\begin{align}"))
    return L.outline(A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), body.alias("body")))


def _declarations(spark, sf):
    k = F.col("o_orderkey")
    line = (F.when(k % 4 == 0, F.concat(F.lit("\\declaretheorem[name=N, within=section]{e"), k % 7, F.lit("}")))
            .when(k % 4 == 1, F.concat(F.lit("\\newtheorem{n"), k % 7, F.lit("}{Title}[section]"))).when(k % 4 == 2, F.lit("\\usepackage{amsmath}")).otherwise(F.lit("\\declaretheorem[unnumbered]{remark}")))
    return A.table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("course"), k.alias("pos"), line.alias("line"))


@query("theorem_declarations", """SELECT o_custkey % 10 AS course, o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN '\\declaretheorem[name=N,sibling=theorem]{e' || o_orderkey % 7 || '}' WHEN 1 THEN '\\newtheorem{n' || o_orderkey % 7 || '}[theorem]{Title}'
WHEN 2 THEN '\\usepackage{amsmath}' ELSE '\\declaretheorem[unnumbered]{remark}' END AS line, CASE WHEN o_orderkey % 4 = 2 THEN 'early' ELSE 'late' END AS part FROM orders""")
def theorem_declarations(spark, sf):
    return L.theorem_declarations(_declarations(spark, sf))


@query("anchors", """WITH d AS (SELECT o_custkey % 10 AS course, CASE o_orderkey % 4 WHEN 0 THEN 'e' || o_orderkey % 7 ELSE 'remark' END AS name, min(o_orderkey) AS pos FROM orders WHERE o_orderkey % 4 IN (0, 3) GROUP BY 1, 2)
SELECT course, list(name ORDER BY pos) AS names FROM d GROUP BY course""")
def anchors(spark, sf):
    return L.anchors(_declarations(spark, sf))


@query("duplicate_declarations", """WITH x AS (SELECT o_custkey % 10 AS course, o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'e' || o_orderkey % 7 WHEN 1 THEN 'n' || o_orderkey % 7 WHEN 3 THEN 'remark' END AS name FROM orders)
SELECT course, pos FROM x QUALIFY name IS NULL OR row_number() OVER (PARTITION BY course, name ORDER BY pos) = 1""")
def duplicate_declarations(spark, sf):
    return L.duplicate_declarations(_declarations(spark, sf)).select("course", "pos")


@query("preamble_union", "SELECT o_custkey % 10 AS course, min(o_orderkey) AS pos, o_orderpriority AS block FROM orders GROUP BY o_custkey % 10, o_orderpriority")
def preamble_union(spark, sf):
    return L.preamble_union(A.table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("course"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("block")))


@query("first_occurrence", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_occurrence(spark, sf):
    return L.first_occurrence(A.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


LETTERS = "abcdefghij"
BLOCK = 4096


@query("macro_clashes", """WITH n AS (SELECT p_partkey AS pos, p_partkey // 5 AS block, 'm' || substr('abcdefghij', (p_partkey % 10 + 1)::INTEGER, 1) AS m, p_partkey % 3 AS k, p_size % 2 AS b FROM part),
s AS (SELECT *, CASE WHEN pos % 10 > 6 THEN 'new' WHEN b = 0 THEN 'same' WHEN k = 0 THEN 'superseded' ELSE 'clash' END AS state FROM n)
SELECT block, pos, '\\' || m AS name, state, NOT bool_or(state = 'clash') OVER (PARTITION BY block) AS adds FROM s""")
def macro_clashes(spark, sf):
    letter = F.substring(F.lit(LETTERS), (F.col("p_partkey") % 10 + 1).cast("int"), F.lit(1))
    command = F.when(F.col("p_partkey") % 3 == 0, "\\providecommand{\\m").otherwise("\\newcommand{\\m")
    line = F.concat(command, letter, F.lit("}{\\mathbb "), F.when(F.col("p_size") % 2 == 0, "Q").otherwise("Z"), F.lit("}"))
    new = A.table(spark, sf, "part").select(F.lit(0).alias("course"), F.floor(F.col("p_partkey") / 5).alias("block"), F.col("p_partkey").alias("pos"), line.alias("line"))
    old = A.table(spark, sf, "nation").where("n_nationkey < 7").select(F.lit(0).alias("course"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("\\newcommand{\\m"), F.substring(F.lit(LETTERS), F.col("n_nationkey") + 1, F.lit(1)), F.lit("}{\\mathbb Q}")).alias("line"))
    return L.macro_clashes(new, old).drop("course")


@query("macro_table", """SELECT course, 'f' || chr(97 + k) AS name, CASE WHEN k = 9 THEN 0 ELSE 2 END::INTEGER AS arity, CASE WHEN k = 9 THEN '\\mathrm{Op}' ELSE 'a{#1}' || m END AS body
FROM (SELECT o_custkey % 10 AS course, (o_orderkey % 10)::INTEGER AS k, max(o_orderkey) AS m FROM orders GROUP BY 1, 2)""")
def macro_table(spark, sf):
    """Orders as a preamble in blocks of up to BLOCK definitions; numbers are gathered, the text is made of them afterwards."""
    k = lambda n: (n % 10).cast("int")
    line = lambda n: F.when(k(n) == 9, F.lit("\\DeclareMathOperator{\\fj}{Op}")).otherwise(F.concat(F.lit("\\newcommand{\\f"), F.substring(F.lit(LETTERS), k(n) + 1, F.lit(1)), F.lit("}[2]{a{#1}"), n, F.lit("}")))
    course = (F.col("o_custkey") % 10).alias("course")
    orders = A.table(spark, sf, "orders")
    parts = orders.groupBy(course, F.floor(F.col("o_orderkey") / BLOCK).alias("pos")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("x"))
    parts = parts.select("course", "pos", F.array_join(F.transform("x", line), "\n").alias("text"))
    begins = orders.select(course).distinct().select("course", F.lit(1 << 62).alias("pos"), F.lit("\\begin{document}\\newcommand{\\z}{no}").alias("text"))
    return L.macro_table(parts.unionByName(begins))


@query("expand_cells", """SELECT o_orderkey AS cell, CASE o_orderkey % 3 WHEN 0 THEN '\\mathbb{N}\\cup x' WHEN 1 THEN '[' || o_custkey || ']\\mathbb{N} \\unknown' ELSE '[z]\\Nbx' END AS text FROM orders""")
def expand_cells(spark, sf):
    macros = spark.range(10).select(F.col("id").alias("course"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("arity"), F.lit(b).alias("body")) for n, a, b in
             (("Nb", 0, "\\mathbb{N}"), ("br", 1, "[#1]"), ("both", 1, "\\br{#1}\\Nb"))))).alias("m")).select("course", "m.*")
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "\\Nb\\cup x").when(k == 1, F.concat(F.lit("\\both{"), "o_custkey", F.lit("} \\unknown"))).otherwise("\\br z\\Nbx")
    cells = A.table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("course"), F.col("o_orderkey").alias("cell"), text.alias("text"))
    return L.expand_cells(cells, macros).select("cell", "text")
