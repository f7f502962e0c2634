"""The few functions that Spark's built-ins can't express, vectorised or lateral."""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def balanced(text: str, start: int, escapes: bool) -> int:
    """Position after the group that opens at ``start``, or -1 if it never closes."""
    depth = 0
    for i in range(start, len(text)):
        c = text[i]
        if c in "{}" and not (escapes and i > start and text[i - 1] == "\\"):
            depth += 1 if c == "{" else -1
            if depth == 0:
                return i + 1
    return -1


@F.udtf(
    returnType=T.StructType().add("pos", T.IntegerType()).add("start", T.IntegerType()).add("stop", T.IntegerType()).add("opener", T.StringType()).add("body", T.StringType())
)
class BraceGroups:
    """Groups whose opener (a pattern that ends at the brace) occurs in ``text``, in order, with the opener as it stands there.

    ``escapes``: braces after a backslash don't count.  An unclosed group reaches to the
    end of the text if ``rest``, else it has an empty body.
    """

    def eval(self, text: str, opener: str, escapes: bool, rest: bool):
        if text is None:
            return
        n, at = 0, 0
        pattern = re.compile(opener)
        while m := pattern.search(text, at):
            begin = m.end() - 1
            stop = balanced(text, begin, escapes)
            if stop < 0:
                body, at = (text[begin + 1 :], len(text)) if rest else ("", m.end())
            else:
                body, at = text[begin + 1 : stop - 1], stop
            yield n, m.start(), at, m[0], body
            n += 1


@F.pandas_udf(T.StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html.unescape(x))


#: Lengths of the word runs that anchor two texts to each other, one after another in what the longer ones leave.
RUNS = (8, 4, 2, 1)


def forward(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest series of ``pairs``, which rise in the first place, that rises in both."""
    ends: list[int] = []  # the least second place that a series of each length ends with, and its pair
    at: list[int] = []
    back = []
    for i, (_, b) in enumerate(pairs):
        k = bisect.bisect_left(ends, b)
        back.append(at[k - 1] if k else -1)
        ends[k : k + 1], at[k : k + 1] = [b], [i]
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def once(words: list[str], run: int) -> dict[tuple[str, ...], int]:
    """The runs of ``run`` words that occur once, and where."""
    places: dict[tuple[str, ...], int] = {}
    for i, key in enumerate(zip(*(words[k:] for k in range(run)), strict=False)):
        places[key] = -1 if key in places else i
    return {key: i for key, i in places.items() if i >= 0}


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence; a bit of one number stands for a letter of ``a``, so space is linear."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    left = full
    for c in b:
        hit = left & at.get(c, 0)
        left = (left + hit | left - hit) & full
    return len(a) - left.bit_count()


def matching_words(a: list[str], b: list[str], runs: tuple[int, ...] = RUNS) -> int:
    """How many letters of two word lists match in order, every word with one blank after it.

    Equal beginnings and ends match.  Runs of words that occur once in either list anchor the
    lists to each other, long runs first and single words last; what lies between two
    anchors is compared alike with shorter runs, and in the end letter by letter.
    """
    low, total = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        total += len(a[low]) + 1
        low += 1
    end = 0
    while end < min(len(a), len(b)) - low and a[-1 - end] == b[-1 - end]:
        end += 1
        total += len(a[-end]) + 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    if not a or not b:
        return total
    if not runs:
        return total + common_letters(" ".join(a) + " ", " ".join(b) + " ")
    there = once(b, runs[0])
    anchors = forward([(i, there[key]) for key, i in once(a, runs[0]).items() if key in there])
    i = j = 0
    for x, y in [*anchors, (len(a), len(b))]:  # an anchor counts its first word; the rest of its run begins what follows
        total += matching_words(a[i:x], b[j:y], runs[1:])
        if x < len(a):
            total += len(a[x]) + 1
        i, j = x + 1, y + 1
    return total


def matching(a: str, b: str) -> float:
    """How many characters of two texts with single blanks match in order, whatever their length."""
    return float(matching_words(a.split(" "), b.split(" ")))


@F.pandas_udf(T.DoubleType())
def matching_characters(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else matching(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The translation of ``b`` that matches ``a`` best, by phase correlation."""
    f = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    peak = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-9)).real
    y, x = np.unravel_index(int(np.argmax(peak)), peak.shape)
    h, w = a.shape
    return (int(y) - h if y > h // 2 else int(y)), (int(x) - w if x > w // 2 else int(x))


@F.pandas_udf(T.StructType().add("dy", T.IntegerType()).add("dx", T.IntegerType()))
def best_shift(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    rows = [shift(np.asarray(x, float).reshape(n, m), np.asarray(y, float).reshape(n, m)) for x, y, n, m in zip(a, b, h, w, strict=True)]
    return pd.DataFrame(rows, columns=["dy", "dx"])


# -- bibliography entries ---------------------------------------------------------------


def field_value(entry: str, i: int) -> tuple[int, str]:
    """Where the value that begins at ``i`` ends, and the value; braces, quotes or a bare token."""
    opening = entry[i : i + 1]
    if opening == "{":
        stop = balanced(entry, i, False)
        stop = len(entry) + 1 if stop < 0 else stop
        return min(stop, len(entry)), entry[i + 1 : stop - 1]
    if opening == '"':
        stop = entry.find('"', i + 1)
        stop = len(entry) if stop < 0 else stop
        return min(stop + 1, len(entry)), entry[i + 1 : stop]
    bare = re.match(r"[^,}\s]*", entry[i:])
    return i + bare.end(), bare[0]


def field_span(entry: str, name: str) -> tuple[int, int, str] | None:
    """Where a field of an entry begins and ends, and its value."""
    m = re.search(rf"\b{name}\s*=\s*", entry, re.I)
    return None if m is None else (m.start(), *field_value(entry, m.end()))


FIELD = re.compile(r"(?:^\s*@\w+\s*\{[^,=]*|,|\n)\s*([A-Za-z][\w:.+-]*)\s*=\s*")


def every_field(entry: str) -> dict[str, str]:
    """All fields by lower-case name, the first of a name; what stands inside a value is no field."""
    out: dict[str, str] = {}
    at = 0
    while m := FIELD.search(entry, at):
        at, value = field_value(entry, m.end())
        out.setdefault(m[1].lower(), value)
    return out


def without_field(entry: str, name: str) -> str:
    """The entry without a field, its comma, and its line if it had one to itself."""
    span = field_span(entry, name)
    if span is None:
        return entry
    head, tail = entry[: span[0]], re.sub(r"^[ \t]*,?[ \t]*", "", entry[span[1] :])
    own_line = re.search(r"\n[ \t]*$", head)
    if own_line:
        head, tail = head[: own_line.start() + 1], tail.removeprefix("\n")
    return head + tail


@F.pandas_udf(T.StringType())
def rebuild_entry(entry: pd.Series, drop_url: pd.Series, doi: pd.Series) -> pd.Series:
    """Entries without url and urldate where ``drop_url``, and with the doi field's value replaced where ``doi`` isn't null."""
    out = []
    for text, drop, value in zip(entry, drop_url, doi, strict=True):
        if text is not None:
            if drop:
                text = without_field(without_field(text, "url"), "urldate")
            span = field_span(text, "doi") if isinstance(value, str) else None
            if span:
                name = re.match(r"\w+\s*=\s*", text[span[0] :])[0]
                text = f"{text[: span[0]]}{name}{{{value}}}{text[span[1] :]}"
        out.append(text)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def entry_fields(entry: pd.Series) -> pd.Series:
    """Fields of an entry by lower-case name."""
    return entry.map(lambda text: every_field(text or ""))


# -- macros -----------------------------------------------------------------------------

ROUNDS = 4


ARGUMENT = re.compile(r"\s*(\S)")


def argument(text: str, at: int) -> tuple[str | None, int]:
    """The argument that a macro finds at ``at`` (a group or the next character) and where it ends; None at the end of the text."""
    m = ARGUMENT.match(text, at)
    if m is None or m[1] != "{":
        return (None, at) if m is None else (m[1], m.end())
    stop = balanced(text, m.start(1), True)
    return (text[m.end() :], len(text)) if stop < 0 else (text[m.end() : stop - 1], stop)


def expanded(text: str, macros: dict[str, tuple[int, str]], rounds: int = ROUNDS) -> str:
    """``text`` with its macros replaced, as often as bodies hold further macros, ``rounds`` times at most.

    A macro with arguments takes one.  Unknown macros and those without their argument stay.
    """
    if not macros:
        return text
    names = re.compile(r"\\(" + "|".join(map(re.escape, sorted(macros, key=len, reverse=True))) + r")(?![a-zA-Z])")

    def once(text: str) -> Iterator[str]:
        at = 0
        for m in iter(lambda: names.search(text, at), None):
            yield text[at : m.start()]
            arity, body = macros[m[1]]
            value, at = argument(text, m.end()) if arity else ("", m.end())
            yield m[0] if value is None else body.replace("#1", value) if arity else body
        yield text[at:]

    for _ in range(rounds):
        before, text = text, "".join(once(text))
        if text == before:
            break
    return text


@F.pandas_udf(T.StringType())
def expand_macros(text: pd.Series, names: pd.Series, arities: pd.Series, bodies: pd.Series) -> pd.Series:
    def one(t, n, a, b):
        return None if t is None else expanded(t, {} if n is None else {x: (int(y), z) for x, y, z in zip(n, a, b, strict=True)})

    return pd.Series([one(*x) for x in zip(text, names, arities, bodies, strict=True)], dtype=object)
