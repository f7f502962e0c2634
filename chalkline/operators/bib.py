"""Bibliographies: reading, identity of sources, tidying, new entries, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.functions import text as T
from chalkline.functions.udf import entry_fields, rebuild_entry

KEY = r"@\w+\s*\{\s*([^,\s]+)\s*,"
REPLACEMENT = "\ufffd"


def clean(c: Column) -> Column:
    """A field's value without braces, white space squeezed."""
    return T.squeeze(F.regexp_replace(c, r"[{}]", ""))


def read_bib(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of the files: file, pos, source_key (from the marker before it), cite_key, entry, fields."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    chunks = files.select("file", F.posexplode(F.split("value", r"\n(?=% source: |@)")).alias("pos", "chunk"))
    w = Window.partitionBy("file").orderBy("pos")
    marker = F.nullif(F.regexp_extract("chunk", r"^\s*% source: ([^\n]*)", 1), F.lit(""))
    rows = chunks.withColumn("source_key", F.lag(marker).over(w)).withColumn("chunk", F.trim("chunk"))
    rows = rows.where(F.col("chunk").rlike(f"^{KEY}")).select("file", "pos", "source_key", F.regexp_extract("chunk", KEY, 1).alias("cite_key"), T.strip(F.col("chunk")).alias("entry"))
    return rows.withColumn("fields", entry_fields("entry"))


def canonical_sources(urls: DataFrame) -> DataFrame:
    """Groups ``(pos, url, key)`` of one canonical source: its identity, the first key, how many spellings."""
    return urls.groupBy(T.source_key(F.col("url")).alias("source_key")).agg(F.min_by("key", "pos").alias("key"), F.count(F.lit(1)).alias("n"))


def normalized_urls(pages: DataFrame) -> DataFrame:
    return pages.groupBy(T.normal_url(F.col("url")).alias("url")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))


def doi_target(url: Column) -> Column:
    """The DOI that a URL resolves, if it is nothing but a resolver link."""
    return F.nullif(F.regexp_extract(T.normal_url(url), rf"^(?i:(?:dx\.)?doi\.org/)({T.DOI})$", 1), F.lit(""))


def arxiv_target(url: Column) -> Column:
    """The identifier that a URL points at, if it is nothing but an arXiv link."""
    own = F.regexp_extract(T.normal_url(url), rf"^(?i:arxiv\.org/(?:abs|pdf|html|e-print)/({T.ARXIV_ID})(?:\.pdf)?)$", 1)
    by_doi = F.regexp_extract(F.coalesce(doi_target(url), F.lit("")), rf"^(?i:10\.48550/arxiv\.({T.ARXIV_ID}))$", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(by_doi, F.lit("")))


def tidy_bibliography(entries: DataFrame) -> DataFrame:
    """Entries without a url that repeats their own eprint or DOI (and its urldate), DOIs reduced to bare ones; ``changed`` tells which."""
    f = lambda name: F.coalesce(F.col("_f")[name], F.lit(""))
    rows = entries.withColumn("_f", entry_fields("entry"))
    bare = lambda c: F.lower(F.regexp_replace(F.trim(c), r"v\d+$", ""))
    archive = F.coalesce(F.nullif(clean(f("archiveprefix")), F.lit("")), clean(f("eprinttype")))
    eprint = clean(f("eprint"))
    own_doi = T.doi(clean(f("doi")))
    same_eprint = (eprint != "") & (F.lower(archive) == "arxiv") & (bare(arxiv_target(f("url"))) == bare(eprint))
    same_doi = F.lower(doi_target(f("url"))) == F.lower(own_doi)
    drop = F.coalesce(same_eprint, F.lit(False)) | F.coalesce(same_doi, F.lit(False))
    new_doi = F.when(own_doi != clean(f("doi")), own_doi)
    rows = rows.withColumn("_new", rebuild_entry("entry", drop, new_doi))
    return rows.withColumn("changed", F.col("_new") != F.col("entry")).withColumn("entry", F.col("_new")).drop("_f", "_new")


def existing_citation(requests: DataFrame, bib: DataFrame) -> DataFrame:
    """The key that a source already has (the first entry with its identity), else null; ``requests (request, url)``."""
    known = bib.groupBy("source_key").agg(F.min_by("cite_key", "pos").alias("cite_key"))
    return requests.withColumn("source_key", T.source_key(F.col("url"))).join(known, "source_key", "left")


def new_entries(requests: DataFrame, bib: DataFrame, urldate: str) -> DataFrame:
    """Entries for sources that the bibliography lacks: ``(request, cite_key, entry, corrupt)``.

    ``requests (request, url, title, author, year)``; the key is surname, year and first
    title word, else a slug of the title, ASCII, told apart from taken ones by 2, 3, ...
    """
    rows = existing_citation(requests, bib).where("cite_key IS NULL")
    title = F.coalesce("title", "url")
    words = T.title_words(title)
    has_author = F.coalesce("author", F.lit("")) != ""
    year = F.coalesce(F.col("year").cast("string"), F.lit(""))
    made = F.concat(F.lower(T.surname(F.col("author"))), year, F.lower(F.coalesce(F.get(words, 0), F.lit(""))))
    key = F.when(has_author, F.coalesce(F.nullif(F.regexp_replace(made, r"(?U)[^\w]", ""), F.lit("")), T.slug_key(title))).otherwise(T.slug_key(title))
    key = F.coalesce(F.nullif(F.regexp_replace(key, r"[^A-Za-z0-9_:-]", ""), F.lit("")), F.lit("reference"))
    label = F.coalesce(F.nullif(F.array_join(F.transform(F.slice(words, 1, 3), lambda x: F.upper(F.left(x, F.lit(1)))), ""), F.lit("")), F.lit("Web"))
    rows = rows.withColumn("base", key).withColumn("label", label).withColumn("t", title)
    taken = bib.select(F.col("cite_key").alias("base"), F.lit(-1).cast("bigint").alias("request"), F.lit(True).alias("old"))
    w = Window.partitionBy("base").orderBy("request")
    every = rows.select("base", "request", F.lit(False).alias("old")).unionByName(taken.distinct())
    ranked = every.withColumn("r", F.row_number().over(w)).where("NOT old").select("request", F.concat("base", F.when(F.col("r") > 1, F.col("r").cast("string")).otherwise("")).alias("cite_key"))
    rows = rows.drop("cite_key").join(ranked, "request")
    second = F.when(has_author, F.concat(F.lit("      author = {"), "author", F.lit("},\n"))).otherwise(F.concat(F.lit("      label = {"), "label", F.lit("},\n")))
    entry = F.concat(
        F.lit("@online{"), "cite_key", F.lit(",\n      title = {"), "t", F.lit("},\n"), second, F.when(year != "", F.concat(F.lit("      year = {"), year, F.lit("},\n"))).otherwise(""),
        F.lit("      url = {"), "url", F.lit("},\n      urldate = {"), F.lit(urldate), F.lit("},\n}\n"),
    )
    return rows.select("request", "cite_key", F.regexp_replace(entry, REPLACEMENT, "?").alias("entry"), entry.contains(REPLACEMENT).alias("corrupt"))


def bibliography_index(entries: DataFrame) -> DataFrame:
    """Compact listing: key, first author (et al.), title cut to 70 characters, year."""
    f = F.col("fields")
    authors = F.split(clean(F.coalesce(f["author"], F.lit(""))), " and ")
    who = F.concat(authors[0], F.when(F.size(authors) > 1, " et al.").otherwise(""))
    return entries.select("file", "pos", "cite_key", who.alias("author"), F.left(clean(F.coalesce(f["title"], F.lit(""))), F.lit(70)).alias("title"), clean(F.coalesce(f["year"], F.lit(""))).alias("year"))
