"""Licence scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are fingerprinted by winnowing (the least hash of every window of ``WINDOW``
word ``GRAM``-grams) into an inverted index from hash to (template, position).  A document
is winnowed the same way over its whole text; any run of ``GRAM + WINDOW - 1`` words that
it shares with a template shares a fingerprint.  Shared fingerprints are anchors; anchors
that follow one another in both texts, with at most ``SHIFT`` words put in or left out
between them, form a chain, and every chain is a candidate.  A local alignment, banded
around the chain's diagonals, decides: matched share of the template's words, and the span
from the first to the last matched word.  So insertions, deletions and fragments of a
template are found and reported with the coverage they have.  Copies of one passage with
the same words around their anchors are aligned once, so text that repeats costs no more
than its length.

A match is reported from ``COVERAGE`` of the template on, or as a fragment from
``FRAGMENT_WORDS`` matched words and ``FRAGMENT`` of the template on.  Where matches
overlap by more than half of one, the one with more matched words stays (then the better
covered template, then the first name).

The template set is small and given, so its index goes to every task; documents stay
where they are and nothing is shuffled.

Defined results: null and empty texts match nothing; repeated rows give repeated rows; an
empty table gives no rows; null ids pass through; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from chalkline.llm.common import small_arrow_batches
from chalkline.llm.license_texts import TEMPLATES

GRAM = 3
WINDOW = 3
BAND = 12
#: Words that may be put in or left out between two anchors.
SHIFT = 100
#: Words of a document that the spans kept so far are looked up by.
CELL = 64
#: Matched share of a template's words from which a match is reported, and what makes a fragment.
COVERAGE = 0.8
FRAGMENT, FRAGMENT_WORDS = 0.2, 30
#: The index goes to every task, so the template set is bounded.
MOST_TEMPLATES = 10_000
MEMO_WORDS = 300_000
_WORD = re.compile(r"[^\W_]+")
_FACTORS = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(GRAM)]
_memo: dict[str, int] = {}


def words(text: str) -> list[str]:
    """Words as written; they are compared in lower case, and spans refer to the text as it is."""
    return _WORD.findall(text)


def word_hashes(found: list[str]) -> np.ndarray:
    out = list(map(_memo.get, found))
    if None in out:
        if len(_memo) > MEMO_WORDS:
            _memo.clear()
        for i, h in enumerate(out):
            if h is None:
                out[i] = _memo[found[i]] = xxhash.xxh64_intdigest(found[i].lower())
    return np.array(out, np.uint64)


def winnow(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed fingerprints of a word-hash sequence."""
    n = len(hashes) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for i, f in enumerate(_FACTORS):
        grams += hashes[i : i + n] * np.uint64(f)
    grams ^= grams >> np.uint64(29)
    if n <= WINDOW:
        at = np.array([n - 1 - int(np.argmin(grams[::-1]))])
        return at, grams[at]
    m = n - WINDOW + 1
    offset = np.zeros(m, np.int64)
    least = grams[:m].copy()
    for i in range(1, WINDOW):
        now = grams[i : i + m]
        better = now <= least
        least[better] = now[better]
        offset[better] = i
    at = np.unique(np.arange(m) + offset)
    return at, grams[at]


class TemplateIndex:
    """The inverted index of a template set."""

    def __init__(self, templates: dict[str, str]):
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        self.names = list(templates)
        self.words = [[w.lower() for w in words(templates[n])] for n in self.names]
        postings: dict[int, list[tuple[int, int]]] = {}
        for t, found in enumerate(self.words):
            for at, h in zip(*(x.tolist() for x in winnow(word_hashes(found))), strict=True):
                postings.setdefault(h, []).append((t, at))
        self.postings = postings
        self.hashes = np.sort(np.array(list(postings), np.uint64))

    def matches(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, first and last+1 character, matched words) of each match in ``text``."""
        found = words(text)
        at, grams = winnow(word_hashes(found))
        if not len(at):
            return []
        i = np.searchsorted(self.hashes, grams)
        hit = self.hashes[np.minimum(i, len(self.hashes) - 1)] == grams
        if not hit.any():
            return []
        anchors: dict[int, list[tuple[int, int]]] = {}
        for p, h in zip(at[hit].tolist(), grams[hit].tolist(), strict=True):
            for t, q in self.postings[h]:
                anchors.setdefault(t, []).append((p, q))
        found = [w.lower() for w in found]
        candidates = []
        for t, hits in anchors.items():
            template = self.words[t]
            known: dict[tuple, tuple[int, int, int]] = {}
            for chain in chains(hits):
                diagonals = [p - q for p, q in chain]
                low = max(0, min(diagonals) - BAND)
                window = found[low : max(diagonals) + BAND + len(template)]
                here = [(p - low, q) for p, q in chain]
                key = (tuple(here), tuple(window))
                if key not in known:
                    known[key] = align(template, window, here)
                matched, a, b = known[key]
                coverage = matched / len(template)
                if coverage >= COVERAGE or matched >= FRAGMENT_WORDS and coverage >= FRAGMENT:
                    candidates.append((-matched, -coverage, self.names[t], a + low, b + low))
        if not candidates:
            return []
        kept: dict[int, list[tuple[int, int]]] = {}  # by cells of the document
        out = []
        places = [m.span() for m in _WORD.finditer(text)]
        for matched, coverage, name, a, b in sorted(candidates):
            cells = range(a // CELL, (b - 1) // CELL + 1)
            if all(2 * (min(b, y) - max(a, x)) <= min(b - a, y - x) for c in cells for x, y in kept.get(c, ())):
                for c in cells:
                    kept.setdefault(c, []).append((a, b))
                out.append((name, -coverage, places[a][0], places[b - 1][1], -matched))
        return sorted(out, key=lambda x: (x[2], x[0]))


def chains(hits: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Chains of anchors (document, template position), best first, that share no stretch of the document.

    Consecutive anchors go forward in both texts, at most ``2 * SHIFT`` words of the document
    apart, and their diagonals differ by SHIFT at most; among chains the longest counts, less
    a little for every word of shift.  Chains are linked once; the best one takes its stretch
    out, and those that reach into it end there.
    """
    run = sorted(hits)
    best: list[float] = []
    back: list[int] = []
    for i, (p, q) in enumerate(run):
        value, before = 1.0, -1
        for j in range(i - 1, -1, -1):
            x, y = run[j]
            if p - x > 2 * SHIFT:
                break
            if x < p and y < q:
                shift = abs((p - q) - (x - y))
                if shift <= SHIFT and best[j] + 1 - shift / (2 * SHIFT) > value:
                    value, before = best[j] + 1 - shift / (2 * SHIFT), j
                if not shift:
                    break  # what comes before it on other diagonals comes before this one through it
        best.append(value)
        back.append(before)
    out = []
    starts: list[int] = []  # stretches taken, in order; they don't overlap
    ends: list[int] = []

    def taken(p: int) -> bool:
        k = bisect.bisect_right(starts, p) - 1
        return k >= 0 and p <= ends[k]

    for i in sorted(range(len(run)), key=lambda k: -best[k]):
        if taken(run[i][0]):
            continue
        chain = []
        while i >= 0 and not taken(run[i][0]) and not (chain and taken_between(starts, run[i][0], chain[-1][0])):
            chain.append(run[i])
            i = back[i]
        chain.reverse()
        k = bisect.bisect_left(starts, chain[0][0])
        starts.insert(k, chain[0][0])
        ends.insert(k, chain[-1][0])
        out.append(chain)
    return out


def taken_between(starts: list[int], low: int, high: int) -> bool:
    """Whether a stretch that begins in ``starts`` lies between two places."""
    return bisect.bisect_right(starts, high) > bisect.bisect_right(starts, low)


def align(template: list[str], doc: list[str], chain: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Local alignment of the template and the document in a band around the chain's diagonals.

    A match scores 2, a word left out of either text costs 1.  Returns the number of
    matched words, and the first and last+1 matched word of the document.
    """
    diagonals = [p - q for p, q in chain]
    at = [q for _, q in chain]
    reach = chain[0][0], chain[-1][0]  # a neighbouring copy inside the band is another chain's
    k = 0
    before: dict[int, tuple[int, int, int]] = {}  # document position: score, matched, first word
    top = (0, 0, 0, 0)
    for q, word in enumerate(template):
        while k < len(at) and at[k] < q:
            k += 1
        near = diagonals[max(0, k - 1)], diagonals[min(k, len(at) - 1)]
        row: dict[int, tuple[int, int, int]] = {}
        left = (0, 0, 0)
        for p in range(max(0, q + min(near) - BAND), min(len(doc) - 1, q + max(near) + BAND) + 1):
            if doc[p] == word:
                score, matched, first = before.get(p, (0, 0, p))  # where both texts stood before these words
                value = (score + 2, matched + 1, first if score else p)
                if (value[0], value[1]) > top[:2] and p >= reach[0] and value[2] <= reach[1]:
                    top = (value[0], value[1], value[2], p + 1)
            else:
                up = before.get(p + 1, (0, 0, 0))
                value = up if up[:2] >= left[:2] else left
                value = (value[0] - 1, value[1], value[2]) if value[0] > 1 else (0, 0, 0)
            left = row[p + 1] = value
        before = row
    return top[1], top[2], top[3]


SCHEMA = "doc_id bigint, license string, coverage double, start_char bigint, end_char bigint, matched_words bigint"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per match of a template in a document: coverage and character span."""
    small_arrow_batches(docs.sparkSession)
    given = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(given)
        for batch in batches:
            rows = [(i, *m) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for m in index.matches(text)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)
