"""Main-text extraction by tag-path ratios.

A page becomes a sequence of text blocks, each with its root-to-leaf tag path.  Per path
the operator adds up text length and punctuation over the blocks that share it, forms the
two ratios (length per block, punctuation-weighted length per block and its spread),
smooths them over the page with a Gaussian kernel and fuses them.  What an element says
about itself only scales the score: menus, forms and controls count nothing, footers,
sidebars, page headers and elements with a class or id such as ``ad`` or ``comments`` a
tenth - unless an element named after the layout (never one of comments or adverts) holds
nearly all of the page's text, as a wrapper or a page-wide form does.  Paths above a
threshold drawn from the scores' standard deviation are content; short blocks (headings,
list items, table cells) beside them in the same element come along unless they are mostly
links; paragraphs, and what stands in an ``article`` or ``main``, come along with their links.

One page is one row and stays in its task; nothing is shuffled.  Markup is read by a scanner
that goes forward only, so malformed pages cost no more than their length.

Defined results: null or empty html and pages without any text give the empty string, as
do pages with nothing but menus, notices and the like; rows with null ids or urls pass
through; repeated pages give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from chalkline.llm.common import small_arrow_batches

RAW = frozenset("script style noscript template textarea select iframe svg object title".split())
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: What ends a stretch of attributes: the tag, or a value.
ATTRIBUTE_END = re.compile(r"[>=]")
BLANKS = re.compile(r"\s*")
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements that are never content, and those that seldom are.
NEVER_TAGS = frozenset("nav menu dialog button fieldset head".split())
SELDOM_TAGS = frozenset("header footer aside".split())
#: Names of what others than the author wrote, and of layout; only the latter may be those of a wrapper.
FOREIGN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising comment comments disqus promo promoted replies reply respond sponsor sponsored".split()
)
NOISE_WORDS = FOREIGN_WORDS | frozenset(
    "banner breadcrumb breadcrumbs cookie cookies consent copyright footer header login masthead menu modal nav navbar "
    "navigation newsletter notice pager pagination popup related share sharing sidebar signup social subscribe toolbar widget".split()
)
#: Words that turn a compound around: ``entry-header``, ``with-sidebar``.
CONTENT_WORDS = frozenset("article body content entry has main no page post section story title with without".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
ROOT_TAGS = frozenset(("article", "main", "body", "html"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What may lie between a content element and a short block that comes along.
FLOW = HEADINGS | frozenset("p ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header hgroup address".split())
SELDOM, NOISY = 0.1, 0.1
#: Elements nested deeper count as part of the one at this depth, so paths are of bounded length.
DEEPEST = 100
#: An element named after the layout that holds all but this share of the page's text, in several blocks, is a wrapper.
OUTSIDE = 0.2
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
P_ENDERS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
PUNCT = re.compile(r"[.,;:!?…。，！？、；：]")


class Element:
    """An open element: its number, its tag, its label in paths, and what it says about its text."""

    __slots__ = ("number", "tag", "label", "factor", "marks")

    def __init__(self, number: int, tag: str, label: str, factor: float, marks: tuple):
        self.number, self.tag, self.label, self.factor, self.marks = number, tag, label, factor, marks


class Block:
    """A run of text: its elements by label, tag and number, length inside links, scale, and the wrappers-to-be around it."""

    __slots__ = ("path", "tags", "inside", "text", "link", "factor", "marks")

    def __init__(self, stack: list[Element], text: str, link: int):
        self.path, self.tags, self.inside = tuple(x.label for x in stack), tuple(x.tag for x in stack), tuple(x.number for x in stack)
        self.text, self.link = text, min(link, len(text))
        self.factor = stack[-1].factor if stack else 1.0
        self.marks = stack[-1].marks if stack else ()


def noise_words(value: str) -> set[str]:
    """The words by which a class or id calls its element boilerplate: noise words in a compound without a content word."""
    out: set[str] = set()
    for name in value.lower().split():
        words = set(re.split(r"[^a-z]+", name))
        if words & NOISE_WORDS and not words & CONTENT_WORDS:
            out |= words & NOISE_WORDS
    return out


def opened(tag: str, attributes: str, stack: list[Element], number: int) -> Element:
    """The element that a start tag opens inside ``stack``; ``number`` tells it apart where it may be a wrapper."""
    factor, marks = (stack[-1].factor, stack[-1].marks) if stack else (1.0, ())
    label, noisy = tag, set()
    if attributes:
        for a in ATTR.finditer(attributes):
            value = (a[2] or a[3] or a[4] or "").lower()
            kind = a[1].lower()
            if kind == "role":
                factor *= SELDOM if value.strip() in NOISE_ROLES else 1
                continue
            if kind == "class":
                label += "." + value
            noisy |= noise_words(value)
    if tag in NEVER_TAGS:
        factor = 0.0
    elif tag in SELDOM_TAGS and not (tag == "header" and any(x.tag in ("article", "main") for x in stack)):
        factor *= SELDOM
    elif tag == "form":
        marks = (*marks, (number, 0.0))
    elif noisy & FOREIGN_WORDS and tag not in ROOT_TAGS and tag not in HEADINGS:
        factor *= NOISY
    elif noisy and tag not in ROOT_TAGS and tag not in HEADINGS:
        marks = (*marks, (number, NOISY))
    return Element(number, tag, label, factor, marks)


class Markup:
    """Reads a page forward: text between tags, and tags with their attributes."""

    def __init__(self, page: str):
        self.page = page
        self.gone: dict[str, bool] = {}  # what doesn't occur any more from here on

    def find(self, what: str, at: int) -> int:
        """Where ``what`` comes next, or -1; once it doesn't, it isn't looked for again."""
        if self.gone.get(what):
            return -1
        i = self.page.find(what, at)
        if i < 0:
            self.gone[what] = True
        return i

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``; quoted values may hold others.  -1: none."""
        page = self.page
        while m := ATTRIBUTE_END.search(page, at):
            if m[0] == ">":
                return m.start()
            at = BLANKS.match(page, m.end()).end()
            quote = page[at : at + 1]
            if quote and quote in "\"'":
                close = self.find(quote, at + 1)
                at = close + 1 if close >= 0 else at + 1
        return -1

    def raw_end(self, name: str, at: int) -> int:
        """Where the content of an element that holds no markup is over, behind its end tag."""
        key = "</" + name
        if self.gone.get(key):
            return len(self.page)
        m = re.compile(rf"</{name}\s*>", re.I).search(self.page, at)
        if m is None:
            self.gone[key] = True
            return len(self.page)
        return m.end()

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it ends an element, attributes); name is empty for what is no element: comments and the like."""
        page, at = self.page, 0
        while (i := page.find("<", at)) >= 0:
            after = page[i + 1 : i + 2]
            if page.startswith("<!--", i):
                end = self.find("-->", i + 4)
                at = len(page) if end < 0 else end + 3
                yield i, at, "", False, ""
                continue
            closing = after == "/"
            name = NAME.match(page, i + 1 + closing)
            if name is None:
                end = self.find(">", i) if after and after in "!?/" else -1
                if end < 0:
                    at = i + 1  # a sign in a text
                    continue
                at = end + 1
                yield i, at, "", False, ""
                continue
            end = -1 if self.gone.get("tag") else self.tag_end(name.end())
            if end < 0:  # no tag ends any more
                self.gone["tag"] = True
                if self.find(">", i) < 0:
                    return  # the rest is text
                yield i, len(page), "", False, ""
                return
            at = end + 1
            tag, attributes = name[0].lower(), page[name.end() : end]
            if tag in RAW and not closing:
                if not attributes.rstrip().endswith("/"):
                    at = self.raw_end(tag, at)
                yield i, at, "", False, ""
            else:
                yield i, at, tag, closing, attributes


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, with tag paths; inline tags don't break a block."""
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    link, in_link, pos, beyond = 0, 0, 0, 0

    def flush() -> None:
        nonlocal link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(stack, text, link))
            parts.clear()
        link = 0

    def add(text: str) -> None:
        nonlocal link
        text = html_lib.unescape(text) if "&" in text else text  # before runs are joined: a reference doesn't reach over a tag
        parts.append(text)
        link += in_link and len(text)

    for start, end, tag, closing, attributes in Markup(page).tags():
        if start > pos:
            add(page[pos:start])
        pos = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        if closing and beyond:
            beyond -= 1
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    in_link = 0
                    break
            continue
        if tag in P_ENDERS and stack and stack[-1].tag == "p":
            stack.pop()
        ends = CLOSES.get(tag)
        if ends:
            while stack and stack[-1].tag in ends:
                stack.pop()
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        if len(stack) >= DEEPEST:
            beyond += 1
            continue
        stack.append(opened(tag, attributes, stack, start))
    if pos < len(page):
        add(page[pos:])
    flush()
    return out


def own_length(b: Block) -> int:
    return len(b.text) - b.link if b.factor else 0


def scales(blocks: list[Block]) -> list[float]:
    """What each block's elements leave of its score; wrappers take nothing."""
    whole = sum(own_length(b) for b in blocks if b.factor == 1)
    held: dict[int, list[int]] = {}
    for b in blocks:
        if b.factor == 1 and (n := own_length(b)):
            for number, _ in b.marks:
                h = held.setdefault(number, [0, 0])
                h[0] += n
                h[1] += 1
    wrappers = {number for number, (n, count) in held.items() if count > 1 and n >= (1 - OUTSIDE) * whole}
    out = []
    for b in blocks:
        scale = b.factor
        for number, factor in b.marks:
            if number not in wrappers:
                scale *= factor
        out.append(scale)
    return out


def path_scores(blocks: list[Block], scale_of: list[float], sigma: float = 1.0) -> list[float]:
    """The fused tag-path ratio of each block.

    The two ratios are smoothed over the page and averaged, in terms of the greatest ones
    that count in full; the geometric mean with the path's own ratios keeps short text
    beside an article from sharing its score.
    """
    total: dict[tuple, list[float]] = {}
    for b in blocks:
        own = own_length(b)
        marks = len(PUNCT.findall(b.text)) if own else 0
        t = total.setdefault(b.path, [0, 0, 0, 0])
        t[0] += own
        t[1] += marks
        t[2] += 1
        t[3] += own * own
    ratio, rich = {}, {}
    for p, (chars, marks, n, squares) in total.items():
        ratio[p] = chars / n
        spread = math.sqrt(max(0.0, squares / n - (chars / n) ** 2))
        rich[p] = (marks / n) * (chars / n + spread)
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    scale = sum(kernel)

    def smooth(values: list[float]) -> list[float]:
        n = len(values)
        return [
            sum(k * values[j] for k, j in zip(kernel, range(i - reach, i + reach + 1), strict=True) if 0 <= j < n) / scale
            for i in range(n)
        ]

    def fused(lengths: list[float], marks: list[float]) -> list[float]:
        top_a, top_b = (max((x for x, f in zip(values, scale_of, strict=True) if f == 1), default=0) or 1 for values in (lengths, marks))
        return [(min(1.0, x / top_a) + min(1.0, y / top_b)) / 2 for x, y in zip(lengths, marks, strict=True)]

    a, b = [ratio[x.path] for x in blocks], [rich[x.path] for x in blocks]
    return [math.sqrt(x * y) for x, y in zip(fused(a, b), fused(smooth(a), smooth(b)), strict=True)]


def content(blocks: list[Block], weight: float = 0.8, share: float = 0.1) -> list[Block]:
    """The blocks that are content: those on paths above the threshold, and short ones beside them.

    An element whose kept paths hold at least ``share`` of the kept text brings along the
    blocks that lie in it through headings, lists, tables and the like only.
    """
    scale = scales(blocks)
    if 1.0 not in scale:
        return []
    scores = [x * f for x, f in zip(path_scores(blocks, scale), scale, strict=True)]
    mean = sum(scores) / len(scores)
    threshold = weight * math.sqrt(sum((x - mean) ** 2 for x in scores) / len(scores))
    best: dict[tuple, float] = {}
    for b, x in zip(blocks, scores, strict=True):
        best[b.path] = max(x, best.get(b.path, 0.0))
    own = [b.tags[-1:] == ("p",) or "article" in b.tags or "main" in b.tags for b in blocks]
    readable = [f > 0 and (b.link * 2 <= len(b.text) or mine) for b, f, mine in zip(blocks, scale, own, strict=True)]
    chosen = [ok and best[b.path] >= threshold for b, ok in zip(blocks, readable, strict=True)]
    weight_of: dict[tuple, int] = {}
    for b, is_chosen in zip(blocks, chosen, strict=True):
        if is_chosen:
            weight_of[b.inside[:-1]] = weight_of.get(b.inside[:-1], 0) + len(b.text)
    least = share * sum(weight_of.values())
    homes = [p for p, n in weight_of.items() if n >= least]

    def beside(b: Block) -> bool:
        return any(b.inside[: len(p)] == p and all(t in FLOW for t in b.tags[len(p) :]) for p in homes)

    return [b for b, is_chosen, ok, f in zip(blocks, chosen, readable, scale, strict=True) if is_chosen or ok and f == 1 and beside(b)]


def main_text(page: str | None) -> str:
    """The article's text, blocks joined by one space."""
    return " ".join(b.text for b in content(blocks_of(page))) if page else ""


SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages (page_id, url, html)``."""
    small_arrow_batches(pages.sparkSession)
    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(_extract, SCHEMA)


#: What the test tables' pages hold: one article, inline markup, five character references.
SQL = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS x FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""
