"""Web pages and passages: visible lines of a page, paired passages and their agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import text as T
from chalkline.functions.udf import matching_characters, unescape_entities

# Elements left out, elements whose end breaks a line, agreement needed.
SKIPPED = ("script", "style", "nav", "footer", "header", "aside")
BREAKING = ("p", "br", "div", "h1", "h2", "h3", "h4", "h5", "li", "tr")
AGREEMENT = 0.97
ORIGINAL = r"(?s)%%%\s*ORIGINAL-START\s*\n(.*?)\n%%%\s*ORIGINAL-END"
REWRITTEN = r"(?s)%%%\s*REWRITTEN-START\s*\n(.*?)\n%%%\s*REWRITTEN-END"
PACKAGES = r"%%%\s*PACKAGES:\s*([^\n]*)"


def page_text(pages: DataFrame) -> DataFrame:
    """``(page_id, title, text)``: visible lines, newline at end tags only, blank runs collapsed.

    Raw-text elements and comments are blanked before tokenising.  The skip depth is a
    counter that never falls below zero: the running sum less its running minimum.
    """
    body = F.regexp_replace("html", r"(?is)<!--.*?-->", "")
    body = F.regexp_replace(body, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "<$1></$1>")
    tokens = F.split(body, r"(?=<[/!a-zA-Z][^>]*>)|(?<=>)")
    rows = pages.select("page_id", F.posexplode(tokens).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", r"^<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>$", 1))
    rows = rows.withColumn("tag", tag)
    step = F.when(F.col("tag").isin(*SKIPPED), 1).when(F.col("tag").isin(*("/" + x for x in SKIPPED)), -1).otherwise(0)
    w = Window.partitionBy("page_id").orderBy("pos")
    rows = rows.withColumn("s", F.sum(step).over(w))
    rows = rows.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(w)))
    is_tag = F.col("token").rlike(r"^<[/!a-zA-Z][^>]*>$")
    piece = F.when(F.col("tag").isin(*("/" + x for x in BREAKING)), "\n").when(is_tag, "").when(F.col("depth") == 0, F.col("token")).otherwise("")
    ordered = F.array_sort(F.collect_list(F.struct("pos", piece.alias("x"))))
    text = rows.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda r: r["x"]), "").alias("text"))
    text = text.withColumn("text", unescape_entities("text"))
    lines = F.transform(F.split("text", r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"), T.strip)
    kept = F.filter(lines, lambda x, i: ~((x == "") & (i > 0) & (F.get(lines, i - 1) == "")))
    title = unescape_entities(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return text.select("page_id", T.strip(F.array_join(kept, "\n")).alias("text")).join(pages.select("page_id", title.alias("title")), "page_id")


def passage_blocks(files: DataFrame) -> DataFrame:
    """Paired ORIGINAL/REWRITTEN blocks ``(file, pos, original, rewritten)`` of ``(file, text)``, to the shorter list."""
    blocks = lambda pattern: F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), T.strip)
    pairs = files.select("file", blocks(ORIGINAL).alias("o"), blocks(REWRITTEN).alias("r"))
    n = F.least(F.size("o"), F.size("r"))
    rows = pairs.where(n > 0).select("file", F.posexplode(F.arrays_zip(F.slice("o", F.lit(1), n).alias("o"), F.slice("r", F.lit(1), n).alias("r"))).alias("pos", "x"))
    return rows.select("file", "pos", F.col("x.o").alias("original"), F.col("x.r").alias("rewritten"))


def requested_packages(files: DataFrame) -> DataFrame:
    """``(file, pos, package)`` of the comma list in a file's packages line, blanks left out."""
    listed = F.filter(F.transform(F.split(F.regexp_extract("text", PACKAGES, 1), ","), T.strip), lambda x: x != "")
    return files.select("file", F.posexplode(listed).alias("pos", "package"))


def passage_agreement(passages: DataFrame, least: float = AGREEMENT) -> DataFrame:
    """Adds ``agreement`` of the normalised texts, ``verified`` and a note.

    Equal texts agree fully; where the lengths alone bound the agreement below ``least``
    that bound is reported; of the rest it is twice the characters that match in order over
    all characters.  A passage is judged inside its row, so no text moves.
    """
    a, b = T.squeeze(F.col("original")), T.squeeze(F.col("rewritten"))
    rows = passages.withColumn("_a", a).withColumn("_b", b)
    total = F.length("_a") + F.length("_b")
    bound = F.when(total > 0, 2 * F.least(F.length("_a"), F.length("_b")) / total).otherwise(1.0)
    rows = rows.withColumn("_known", F.when(F.col("_a") == F.col("_b"), 1.0).when(bound < least, bound))
    # every word counts with one blank after it, the last one's is taken off again; null where there is nothing to compare
    open_ = F.col("_known").isNull()
    match = matching_characters(F.when(open_, F.col("_a")), F.when(open_, F.col("_b")))
    counted = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * (match - 1) / total))
    out = rows.withColumn("agreement", F.coalesce("_known", counted))
    verified = F.col("agreement") >= least
    return out.withColumn("verified", verified).withColumn("note", F.when(~verified, "differs")).drop("_a", "_b", "_known")
