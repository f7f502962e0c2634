"""Queries of bibliographies, pages, passages and diagrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.functions import text as T
from chalkline.operators import bib as B
from chalkline.operators import diagrams as D
from chalkline.operators import pages as P
from chalkline.plans import adapters as A
from chalkline.plans.catalog import query
from chalkline.sources import readers, sinks


def entries(spark, sf):
    """Parts as entries: by size mod 4 a repeated resolver url, another url, a resolver-valued DOI, an eprint with its abs url."""
    p, k = F.col("p_partkey"), F.col("p_size") % 4
    doi = F.concat(F.lit("10.5555/"), p)
    link = (F.when(k == 0, F.concat(F.lit("  doi = {"), doi, F.lit("},\n  url = {https://doi.org/"), doi, F.lit("},\n  urldate = {2020-01-01},\n")))
            .when(k == 1, F.concat(F.lit("  url = {https://www.example.org/"), p, F.lit("/},\n"))).when(k == 2, F.concat(F.lit("  DOI = {https://doi.org/"), doi, F.lit("},\n")))
            .otherwise(F.concat(F.lit("  eprint = {2101."), F.lpad(p.cast("string"), 5, "0"), F.lit("v2},\n  archivePrefix={arXiv},\n  url = {https://arxiv.org/abs/2101."), F.lpad(p.cast("string"), 5, "0"), F.lit("},\n"))))
    entry = F.concat(F.lit("@article{key"), p, F.lit(",\n  title = {The {"), "p_name", F.lit("} of  "), "p_brand", F.lit("},\n  author = {Last"), k, F.lit(", First and Other, One},\n"), link, F.lit("  year = "), k + 2000, F.lit("\n}"))
    return A.table(spark, sf, "part").select((p % 10).alias("course"), p.alias("pos"), F.concat(F.lit("doi:"), doi).alias("source_key"), F.concat(F.lit("key"), p).alias("cite_key"), entry.alias("entry"))


def _written(spark, sf):
    path = A.folder(spark, "bib")
    sinks.write_bib(entries(spark, sf), path)
    return B.read_bib(spark, path)


@query("src_bib", "SELECT 'key' || p_partkey AS cite_key, 'doi:10.5555/' || p_partkey AS source_key, 'The ' || p_name || ' of ' || p_brand AS title, (2000 + p_size % 4)::VARCHAR AS year FROM part")
def src_bib(spark, sf):
    return _written(spark, sf).select("cite_key", "source_key", B.clean(F.col("fields")["title"]).alias("title"), F.col("fields")["year"].alias("year"))


@query("bibliography_index", "SELECT 'key' || p_partkey AS cite_key, 'Last' || p_size % 4 || ', First et al.' AS author, left('The ' || p_name || ' of ' || p_brand, 70) AS title, (2000 + p_size % 4)::VARCHAR AS year FROM part")
def bibliography_index(spark, sf):
    return B.bibliography_index(_written(spark, sf)).select("cite_key", "author", "title", "year")


@query("tidy_bibliography", """SELECT p_partkey AS pos, p_size % 4 <> 1 AS changed, false AS changed_again,
'@article{key' || p_partkey || ',' || chr(10) || '  title = {The {' || p_name || '} of  ' || p_brand || '},' || chr(10) || '  author = {Last' || p_size % 4 || ', First and Other, One},' || chr(10) || CASE p_size % 4
WHEN 0 THEN '  doi = {10.5555/' || p_partkey || '},' WHEN 1 THEN '  url = {https://www.example.org/' || p_partkey || '/},' WHEN 2 THEN '  DOI = {10.5555/' || p_partkey || '},'
ELSE '  eprint = {2101.' || lpad(p_partkey::VARCHAR, 5, '0') || 'v2},' || chr(10) || '  archivePrefix={arXiv},' END || chr(10) || '  year = ' || (p_size % 4 + 2000) || chr(10) || '}' AS entry FROM part""")
def tidy_bibliography(spark, sf):
    once = B.tidy_bibliography(entries(spark, sf))
    twice = B.tidy_bibliography(once.withColumnRenamed("changed", "first"))
    return twice.select("pos", F.col("first").alias("changed"), F.col("changed").alias("changed_again"), "entry")


def _urls(spark, sf):
    p, k = F.col("p_partkey"), F.col("p_partkey") % 4
    n = F.lpad((p % 100).cast("string"), 5, "0")
    url = (F.when(k == 0, F.concat(F.lit(" https://arxiv.org/pdf/2101."), n)).when(k == 1, F.concat(F.lit("arXiv:2101."), n))
           .when(k == 2, F.concat(F.lit("https://dx.doi.org/10.5555/ab."), p % 100, F.lit("."))).otherwise(F.concat(F.lit("  http://x.org/"), p % 100, F.lit(" "))))
    return A.table(spark, sf, "part").select(p.alias("pos"), url.alias("url"), F.concat(F.lit("k"), p).alias("key"))


SOURCE = "CASE WHEN p_partkey % 4 < 2 THEN 'arxiv:2101.' || lpad((p_partkey % 100)::VARCHAR, 5, '0') WHEN p_partkey % 4 = 2 THEN 'doi:10.5555/ab.' || p_partkey % 100 ELSE 'http://x.org/' || p_partkey % 100 END"


@query("canonical_sources", f"SELECT {SOURCE} AS source_key, 'k' || min(p_partkey) AS key, count(*) AS n FROM part GROUP BY 1")
def canonical_sources(spark, sf):
    return B.canonical_sources(_urls(spark, sf))


@query("existing_citation", f"SELECT p_partkey AS request, {SOURCE} AS source_key, CASE WHEN p_partkey % 100 < 50 THEN 'old' || p_partkey % 4 // 2 || '-' || p_partkey % 100 END AS cite_key FROM part WHERE p_partkey % 4 <> 3")
def existing_citation(spark, sf):
    u = _urls(spark, sf).where("pos % 4 <> 3")
    bib = u.where("pos % 100 < 50").select(T.source_key(F.col("url")).alias("source_key"), "pos", F.concat(F.lit("old"), F.floor(F.col("pos") % 4 / 2), F.lit("-"), F.col("pos") % 100).alias("cite_key"))
    return B.existing_citation(u.select(F.col("pos").alias("request"), "url"), bib).select("request", "source_key", "cite_key")


@query("new_entries", """WITH r AS (SELECT p_partkey AS request, CASE WHEN p_size % 2 = 0 THEN 'last' || p_size % 4 || (2000 + p_size % 5) || split_part(p_name, ' ', 1) ELSE replace(p_name, ' ', '-') END AS base, p_size, p_name FROM part)
SELECT request, base || CASE WHEN row_number() OVER w > 1 THEN (row_number() OVER w)::VARCHAR ELSE '' END AS cite_key, p_size % 3 = 0 AS corrupt,
'title = {' || CASE WHEN p_size % 2 = 0 THEN 'The ' ELSE '' END || p_name || '},' AS title, 'url = {http://y.org/' || request || CASE WHEN p_size % 3 = 0 THEN '?' ELSE '' END || '},' AS url, 'urldate = {2024-01-01},' AS urldate,
CASE WHEN p_size % 2 = 0 THEN 'author = {First Last' || p_size % 4 || ' and Other},' ELSE 'label' END AS second
FROM r WINDOW w AS (PARTITION BY base ORDER BY request)""")
def new_entries(spark, sf):
    size = F.col("p_size")
    author = F.when(size % 2 == 0, F.concat(F.lit("First Last"), size % 4, F.lit(" and Other")))
    r = A.table(spark, sf, "part").select(F.col("p_partkey").alias("request"), F.concat(F.lit("http://y.org/"), "p_partkey").alias("url"), F.concat(F.lit("The "), "p_name").alias("title"), author.alias("author"), F.when(size % 2 == 0, size % 5 + 2000).alias("year"), size.alias("s"))
    r = r.withColumn("title", F.when(F.col("author").isNotNull(), F.col("title")).otherwise(F.expr("substring(title, 5)")))
    r = r.withColumn("url", F.when(F.col("s") % 3 == 0, F.concat("url", F.lit("\ufffd"))).otherwise(F.col("url")))
    empty = spark.createDataFrame([], "source_key string, pos bigint, cite_key string")
    line = lambda n: F.trim(F.split("entry", "\n")[n])
    second = F.when(line(2).startswith("label"), "label").otherwise(line(2))
    at = F.when(line(3).startswith("year"), 4).otherwise(3)
    return B.new_entries(r, empty, "2024-01-01").select(
        "request", "cite_key", "corrupt", line(1).alias("title"), line(at).alias("url"), line(at + 1).alias("urldate"), second.alias("second")
    )


@query("normalized_urls", "SELECT regexp_replace(regexp_replace(regexp_replace(replace(trim(url), chr(92), ''), '^https?://', '', 'i'), '^www\\.', '', 'i'), '/+$', '') AS url, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1")
def normalized_urls(spark, sf):
    return B.normalized_urls(A.table(spark, sf, "pages"))


@query("page_formats", "SELECT CASE WHEN page_id % 3 = 0 THEN 'pdf' ELSE 'html' END AS format, count(*) AS n FROM pages GROUP BY 1")
def page_formats(spark, sf):
    p = A.table(spark, sf, "pages").select(F.concat("url", F.when(F.col("page_id") % 3 == 0, "/a.PDF?x=1.html").otherwise("/a.html?x=.pdf")).alias("url"))
    p = p.withColumn("url", F.regexp_replace("url", r"\?(?!x=)", "-"))
    return readers.read_pages(p).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query("page_titles", "SELECT page_id, html_title AS title FROM (SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS html_title FROM pages)")
def page_titles(spark, sf):
    return P.page_text(A.table(spark, sf, "pages")).select("page_id", F.trim("title").alias("title"))


@query("page_text", """WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style|footer)[ >].*?</(script|style|footer)>', '', 'g') AS g FROM pages),
c AS (SELECT page_id, regexp_replace(g, '(?s)<nav>.*?</nav>', chr(10) || chr(10), 'g') AS h FROM b),
t AS (SELECT page_id, regexp_replace(regexp_replace(h, '</(p|br|div|h1|h2|h3|h4|h5|li|tr)>', chr(10), 'g'), '<[/!a-zA-Z][^>]*>', '', 'g') AS t FROM c),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS t FROM t)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(t, ' *\\n *', chr(10), 'g'), '\\n\\n+', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS text FROM u""")
def page_text(spark, sf):
    return P.page_text(A.table(spark, sf, "pages")).select("page_id", F.md5("text").alias("text"))


def _passages(spark, sf):
    """Documents as passages: the rewrite is the text, white space changed; for every third id a few characters; for every fifth half is gone."""
    k = F.col("doc_id")
    t = F.coalesce("text", F.lit(""))
    new = F.when(k % 5 == 0, F.expr("left(coalesce(text, ''), cast(length(coalesce(text, '')) / 2 as int))")).when(k % 3 == 0, F.concat(t, F.lit(" x"))).otherwise(F.regexp_replace(t, " ", "\n "))
    return A.table(spark, sf, "documents").select(k.alias("source"), t.alias("original"), new.alias("rewritten"))


@query("passage_blocks", """SELECT doc_id AS file, 0::INTEGER AS pos, md5(regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g')) AS original, CASE WHEN doc_id % 5 = 0 THEN 'cut' WHEN doc_id % 3 = 0 THEN 'x' ELSE 'same' END AS rewritten
FROM documents WHERE doc_id % 7 <> 0 AND coalesce(text, '') <> ''""")
def passage_blocks(spark, sf):
    """One pair a file, a second rewrite without an original; files without any rewrite give nothing."""
    p = _passages(spark, sf)
    word = F.when(F.col("source") % 5 == 0, "cut").when(F.col("source") % 3 == 0, "x").otherwise("same")
    rewrites = F.when(F.col("source") % 7 == 0, "").otherwise(F.concat(F.lit("%%% REWRITTEN-START\n"), word, F.lit("\n%%% REWRITTEN-END\n%%% REWRITTEN-START\nodd\n%%% REWRITTEN-END")))
    f = p.select(F.col("source").alias("file"), F.concat(F.lit("%%% ORIGINAL-START\n"), "original", F.lit("\n%%% ORIGINAL-END\n"), rewrites).alias("text")).where("original <> ''")
    return P.passage_blocks(f).select("file", "pos", F.md5("original").alias("original"), "rewritten")


@query("requested_packages", "SELECT doc_id AS file, k::INTEGER AS pos, CASE k WHEN 0 THEN 'amsmath' ELSE 'pkg' || doc_id END AS package FROM documents, (VALUES (0), (1)) v(k) WHERE doc_id % 3 = 0 OR k = 0 AND doc_id % 3 = 1")
def requested_packages(spark, sf):
    d = A.table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    listed = F.when(F.col("file") % 3 == 0, F.concat(F.lit("\n%%% PACKAGES: amsmath,  pkg"), "file", F.lit(" ,\n"))).when(F.col("file") % 3 == 1, "\n%%% PACKAGES:amsmath").otherwise("")
    return P.requested_packages(d.select("file", F.concat("text", listed).alias("text")))


@query("passage_agreement", """WITH t AS (SELECT doc_id AS source, coalesce(text, '') AS t FROM documents),
p AS (SELECT source, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS a, CASE WHEN source % 5 = 0 THEN trim(regexp_replace(left(t, length(t) // 2), '\\s+', ' ', 'g')) WHEN source % 3 = 0 THEN trim(trim(regexp_replace(t, '\\s+', ' ', 'g')) || ' x')
ELSE trim(regexp_replace(t, '\\s+', ' ', 'g')) END AS b FROM t),
g AS (SELECT source, CASE WHEN a = b THEN 1.0::DOUBLE WHEN source % 5 = 0 THEN 2 * least(length(a), length(b)) / (length(a) + length(b)) ELSE 2 * length(a) / (length(a) + length(b)) END AS agreement FROM p)
SELECT source, agreement, agreement >= 0.97 AS verified, CASE WHEN agreement < 0.97 THEN 'differs' END AS note FROM g""")
def passage_agreement(spark, sf):
    return P.passage_agreement(_passages(spark, sf)).select("source", "agreement", "verified", "note")


# -- diagrams: a grid per (customer segment, nation): the region's names and arrows -----------


def _diagrams(spark, sf):
    """Nations as diagrams: the row of the nation's suppliers; arrows r, and rr off the end or not."""
    s = A.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("diagram"), F.col("s_suppkey").alias("k"))
    cell = F.concat(F.lit("\\mathcal{S}_{"), "k", F.lit("} \\arrow[r, \"f\", "), F.when(F.col("k") % 2 == 0, "hook").otherwise("two heads"), F.lit("]"), F.when(F.col("k") % 3 == 0, " \\arrow[rr, dashed] \\arrow[d, phantom]").otherwise(""))
    rows = s.groupBy("diagram").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", cell.alias("x")))), lambda r: r["x"]).alias("cells"))
    return rows.select("diagram", F.concat(F.lit("```latex\n\\begin{tikzcd}[sep=small]\n"), F.array_join("cells", " & "), F.lit(" \\\\\n & {}\n\\end{tikzcd}\n```")).alias("latex"))


GRID = "(SELECT s_nationkey AS diagram, s_suppkey AS k, row_number() OVER w - 1 AS c, lead(s_suppkey, 1) OVER w AS one, lead(s_suppkey, 2) OVER w AS two FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey))"
DRAWN = f"(SELECT diagram, c, k, one AS t, CASE WHEN k % 2 = 0 THEN 'mono' ELSE 'epi' END AS style FROM {GRID} UNION ALL SELECT diagram, c, k, two, 'dashed' FROM {GRID} WHERE k % 3 = 0)"


@query("diagram_edges", f"SELECT diagram, c::INTEGER AS c, 's_' || k AS source, 's_' || t AS target, t IS NULL AS off_grid, CASE WHEN style <> 'dashed' THEN 'f' END AS label, style FROM {DRAWN}")
def diagram_edges(spark, sf):
    e = D.diagram_edges(D.diagram_cells(_diagrams(spark, sf)))
    name = lambda c: F.when(F.col(c).isNotNull(), D.normal_name(F.col(c))).alias(c)
    return e.select("diagram", "c", name("source"), name("target"), "off_grid", "label", D.normal_style(F.col("style")).alias("style"))


@query("diagram_lint", f"SELECT diagram, c::INTEGER AS c, 'arrow off the grid' AS problem, count(*) AS n FROM {DRAWN} WHERE t IS NULL GROUP BY ALL UNION ALL SELECT DISTINCT s_nationkey, x, 'empty cell', 1 FROM supplier, (VALUES (0), (1)) v(x)")
def diagram_lint(spark, sf):
    cells = D.diagram_cells(_diagrams(spark, sf))
    return D.diagram_lint(cells, D.diagram_edges(cells)).groupBy("diagram", "c", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("diagram_names", "SELECT p_partkey AS part, CASE p_size % 6 WHEN 0 THEN 's' || p_partkey WHEN 1 THEN 'm_' || p_partkey WHEN 2 THEN 'n' || p_partkey WHEN 3 THEN '\\tildek' || p_partkey WHEN 4 THEN 'q''' || p_partkey ELSE 'limx' || p_partkey END AS name FROM part")
def diagram_names(spark, sf):
    p, k = F.col("p_partkey"), F.col("p_size") % 6
    text = (F.when(k == 0, F.concat(F.lit("$S"), p, F.lit(" \\in \\mathrm{Pro}_{\\mathbb N}(Fin)$"))).when(k == 1, F.concat(F.lit("M_{"), p, F.lit("} = \\varprojlim M_n,")))
            .when(k == 2, F.concat(F.lit("\\Nb\\cup\\infty = \\mathbb N"), p)).when(k == 3, F.concat(F.lit("\\widetilde{K}"), p, F.lit("."))).when(k == 4, F.concat(F.lit("Q'\\, "), p)).otherwise(F.concat(F.lit("\\varprojlim X"), p)))
    cells = A.table(spark, sf, "part").select(p.alias("part"), text.alias("text"))
    return cells.join(D.diagram_names(cells), "text").select("part", "name")


def _declared(spark, sf):
    s = A.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("diagram"), F.col("s_suppkey").alias("k"))
    objects = s.where("k % 5 <> 0").select("diagram", F.concat(F.lit("S_"), "k").alias("object")).unionByName(s.where("k % 7 = 0").select("diagram", F.concat(F.lit("T_"), "k").alias("object"))).unionByName(s.select("diagram", F.lit("\\cdots").alias("object")))
    return objects, s.where("k % 4 = 0").select("diagram", F.concat(F.lit("S_"), "k").alias("source"), F.concat(F.lit("S_"), F.col("k") + 1).alias("target"))


@query("diagram_inventory", f"""SELECT s_nationkey AS diagram, 'not declared' AS problem, 's_' || s_suppkey AS name FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_nationkey, 'not drawn', 't_' || s_suppkey FROM supplier WHERE s_suppkey % 7 = 0
UNION ALL SELECT s_nationkey, 'arrow missing', 's_' || s_suppkey || ' -> s_' || (s_suppkey + 1) FROM supplier WHERE s_suppkey % 4 = 0 AND NOT EXISTS (SELECT 1 FROM {DRAWN} d WHERE d.k = s_suppkey AND d.t = s_suppkey + 1)""")
def diagram_inventory(spark, sf):
    cells = D.diagram_cells(_diagrams(spark, sf))
    objects, arrows = _declared(spark, sf)
    return D.diagram_inventory(objects, arrows, cells, D.diagram_edges(cells))


def _scores(spark, sf):
    """Orders as cases, line items as attempts: nodes are part keys; an attempt drops, adds, reverses or restyles by line number."""
    l = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("attempt")).distinct()  # noqa: E741
    three = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    tn = l.select("case").distinct().select("case", F.explode(three).alias("name"))
    ta = l.select("case").distinct().select("case", F.lit("a").alias("s"), F.lit("b").alias("t"), F.lit("").alias("style"))
    k = F.col("attempt") % 5
    n = l.select("case", "attempt", F.explode(F.when(k == 1, F.array(F.lit("a"), F.lit("b"))).when(k == 2, F.concat(three, F.array(F.lit("z")))).otherwise(three)).alias("name"))
    a = l.select("case", "attempt", F.when(k == 3, "b").otherwise("a").alias("s"), F.when(k == 3, "a").otherwise("b").alias("t"), F.when(k == 4, "epi").otherwise("").alias("style"))
    return D.score_diagrams(tn, ta, n, a)


SCORES = """(SELECT DISTINCT l_orderkey AS "case", l_linenumber AS attempt, 3::BIGINT AS nodes, (l_linenumber % 5 = 1)::BIGINT AS nodes_missing, (l_linenumber % 5 = 2)::BIGINT AS nodes_extra, (l_linenumber % 5 = 3)::BIGINT AS arrows_missing,
(l_linenumber % 5 = 3)::BIGINT AS arrows_extra, (l_linenumber % 5 = 4)::BIGINT AS style_mismatch, (l_linenumber % 5 = 3)::BIGINT AS reversed, CASE l_linenumber % 5 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END::BIGINT AS wrong FROM lineitem)"""


@query("score_diagrams", f"SELECT * FROM {SCORES}")
def score_diagrams(spark, sf):
    return _scores(spark, sf)


@query("best_attempt", f'SELECT * FROM {SCORES} QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY wrong, attempt) = 1')
def best_attempt(spark, sf):
    return D.best_attempt(_scores(spark, sf))


@query("diagram_score_summary", f'WITH b AS (SELECT * FROM {SCORES} QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY wrong, attempt) = 1) SELECT count(*) AS cases, count(*) FILTER (WHERE wrong = 0) AS exact, round(1 - sum(nodes_missing) / sum(nodes), 6)::DOUBLE AS node_recall, sum(reversed)::BIGINT AS reversed FROM b')
def diagram_score_summary(spark, sf):
    return D.score_summary(D.best_attempt(_scores(spark, sf))).withColumn("node_recall", F.round("node_recall", 6))
