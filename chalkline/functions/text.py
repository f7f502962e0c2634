"""Column expressions for times, identifiers, slugs and word streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide what counts as what.
ARXIV_ID = r"(?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?"
DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
CUES = (
    r"(?i)\bdraw(?:ing|s|n)?\b|\b(?:this|the|that|following|a)\s+diagram\b"
    r"|\bdiagram\s+chase\b|\bpicture\b|\bsketch\b|\b(?:this|the)\s+square\b"
)
BOARD_FILE = r"/boards/board-0*(\d+)\.[a-z]+$"
REFERENCE = r"\\(?:eq|labelc|label|c|C|auto|page|v|name)?ref\*?\s*\{([^{}]*)\}"
LABEL = r"\\label\s*\{([^{}]*)\}"
TAG = r"\\tag\*?\s*\{"
STOPWORDS = ("a", "an", "the", "on", "of", "in", "for", "and", "to", "lectures", "notes", "introduction")


def strip(c: Column) -> Column:
    """Both ends freed of all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clock(seconds: Column) -> Column:
    """Seconds as hh:mm:ss, never negative, halves rounded to even."""
    total = F.greatest(F.bround(seconds.cast("double"), 0).cast("bigint"), F.lit(0).cast("bigint"))
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(total / 3600).cast("bigint")
    hours = F.when(hours < 100, part(hours)).otherwise(hours.cast("string"))
    return F.concat_ws(":", hours, part(F.floor(total % 3600 / 60).cast("bigint")), part(total % 60))


def seconds(text: Column) -> Column:
    """Seconds of ``754``, ``12:34`` or ``[00:12:34]``; null for anything else."""
    bare = strip(F.regexp_replace(strip(text), r"^[\[\]]+|[\[\]]+$", ""))
    parts = F.transform(F.split(bare, ":"), lambda x: x.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)
    return F.when((bare != "") & (F.size(parts) <= 3) & ~F.exists(parts, lambda x: x.isNull()), total)


def arxiv_id(c: Column) -> Column:
    """The arXiv identifier of an id, a prefixed id or an arXiv URL, else null."""
    s = strip(c)
    pick = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    return F.coalesce(pick(f"^(?i:arxiv):((?i:{ARXIV_ID}))$"), pick(f"^({ARXIV_ID})$"), pick(f"arxiv\\.org/(?:abs|pdf|html|e-print)/({ARXIV_ID})"))


def doi(c: Column) -> Column:
    """The first DOI in a text, without trailing dots, else null."""
    return F.regexp_replace(F.nullif(F.regexp_extract(strip(c), f"({DOI})", 1), F.lit("")), r"\.+$", "")


def source_key(c: Column) -> Column:
    """Canonical identity of a citable source: arXiv id, else DOI, else the trimmed text."""
    return F.coalesce(F.concat(F.lit("arxiv:"), arxiv_id(c)), F.concat(F.lit("doi:"), doi(c)), strip(c))


def normal_url(c: Column) -> Column:
    """A URL without scheme, ``www.``, backslashes, braces and trailing slashes."""
    u = squeeze(F.regexp_replace(c, r"[{}]", ""))
    u = F.regexp_replace(u, r"\\", "")
    u = F.regexp_replace(u, r"(?i)^https?://", "")
    return F.regexp_replace(F.regexp_replace(u, r"(?i)^www\.", ""), r"/+$", "")


def slug_key(c: Column) -> Column:
    """Up to four lower-cased words joined by dashes, 48 characters at most."""
    s = F.regexp_replace(F.lower(c), r"(?U)[^\w\s-]", "")
    words = F.slice(F.filter(F.split(s, r"(?U)[\s_-]+"), lambda w: w != ""), 1, 4)
    return F.coalesce(F.nullif(F.left(F.array_join(words, "-"), F.lit(48)), F.lit("")), F.lit("reference"))


def title_words(c: Column) -> Column:
    """The words of a title that are not stop words."""
    words = F.split(F.regexp_replace(c, r"(?U)[^\w\s-]", ""), r"(?U)[\s_-]+")
    return F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(*STOPWORDS))


def surname(author: Column) -> Column:
    """Surname of the first author of ``A and B`` / ``Last, First`` / ``First Last``."""
    first = strip(F.split(strip(author), r"(?U)\s+and\s+|;")[0])
    return F.when(first.contains(","), strip(F.split(first, ",")[0])).otherwise(F.element_at(F.split(first, r"(?U)\s+"), -1))


def word_stream(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), 0)


def short_tokens(n: Column) -> Column:
    """``1.23M``, ``4.5k`` or the number itself."""
    return (
        F.when(n >= 1_000_000, F.concat(F.format_string("%.2f", n / 1e6), F.lit("M")))
        .when(n >= 1_000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def requested_language(value: Column) -> Column:
    """The language to transcribe in: English where none is asked for, null (detect it) for ``auto``, ``detect`` and blanks."""
    asked = strip(value)
    return F.when(value.isNull(), "en").when(~F.lower(asked).isin("auto", "detect", ""), asked)


def references(body: Column) -> Column:
    """All cited labels of a text, comma lists split, in order."""
    keys = F.flatten(F.transform(F.regexp_extract_all(body, F.lit(REFERENCE), 1), lambda x: F.split(x, ",")))
    return F.filter(F.transform(keys, strip), lambda k: k != "")


def labels(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(LABEL), 1), strip)


def source_type(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)^https?://(?:www\.|m\.)?(?:youtube\.com|youtu\.be)/"), "youtube").when(c.rlike("(?i)^https?://"), "url").otherwise("file")
