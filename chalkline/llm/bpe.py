"""Byte-pair encoding by a tokenization automaton.

Reading tokens, the automaton accepts exactly the correct tokenizations.  It starts with
one state that loops on every byte and grows by one gadget per merge (a, b -> c), in
merge order: the target of the a-arcs is split, the new state lacks the b-arc (a followed
by b is no longer correct), and wherever an a-arc leaves a state a c-arc leaves it too,
to the state that b led to.  All arcs with one label share their target, so a state is
known by the last label, and what tells states apart is which arcs they lack.

The full arc table of a 50k vocabulary has 2.5 billion entries, almost all of them
present, so it is stored by its gaps and expanded on demand: ``arc`` answers from the
states' lineage and every answer enters the transition table.  A word has exactly one
accepted path, which a walk driven by the table finds.  Decoding emits the arc labels.

Defined results: null text counts as empty (no tokens, hash of nothing); text that holds
the string of an added token yields that token; repeated rows give repeated rows; an
empty table gives no rows; extra columns are ignored; very long words are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chalkline.llm.common import small_arrow_batches

DEAD = -1
#: Words whose encodings a worker keeps, twice (recent ones, and those before); a bound on its memory, not on what is encoded.
MEMO_WORDS = 150_000
MEMO_BYTES = 64


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    n = 0
    for b in range(256):
        if b not in out.values():
            out[chr(256 + n)] = b
            n += 1
    return out


class MergeAutomaton:
    """The automaton of a byte-level vocabulary and its merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int], pattern: str):
        alphabet = byte_alphabet()
        self.labels: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.labels |= {i: t.encode() for t, i in added.items()}
        self.ids: dict[bytes, int] = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
        self.added = added
        self.split = regex.compile(pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # states: what each was copied from, the arc it lacks, and the gadget that made it
        self.parent, self.lacks, self.born = [DEAD], [DEAD], [0]
        self.target: dict[int, int] = {self.ids[bytes([b])]: 0 for b in range(256) if bytes([b]) in self.ids}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: gadget number, first part, second part
        self.table: dict[tuple[int, int], int] = {}
        for k, (x, y) in enumerate(merges, 1):
            self._gadget(k, vocab[x], vocab[y], vocab[x + y])
        made = {self.labels[t]: t for t in self.target}
        self.size = {t: len(label) for label, t in made.items()}
        # every prefix of a label (a character a byte), with the longest label that it begins with; each label's next shorter one
        self.prefixes: dict[str, int] = {}
        self.reach = max(map(len, made), default=0)
        self.trie = ahocorasick.Automaton()
        for label, t in made.items():
            text = label.decode("latin-1")
            self.trie.add_word(text, t)
            best = DEAD
            for n in range(1, len(label) + 1):
                best = made.get(label[:n], best)
                self.prefixes[text[:n]] = best
        self.shorter = {t: self.prefixes.get(label[:-1].decode("latin-1"), DEAD) for label, t in made.items()}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _gadget(self, k: int, a: int, b: int, c: int) -> None:
        if a not in self.target or b not in self.target or not self._present(self.target[a], b):
            return  # the pair never stands side by side, so the merge never applies
        old, after = self.target[a], self.target[b]
        self.parent.append(old)
        self.lacks.append(b)
        self.born.append(k)
        self.target[a] = len(self.parent) - 1
        if c not in self.target:
            self.target[c] = after if a != b else old
            self.made[c] = (k, a, b)

    def arc(self, state: int, token: int) -> int:
        """The state that ``token`` leads to from ``state``, or DEAD; from the table where it is known."""
        key = (state, token)
        known = self.table.get(key)
        if known is None:
            known = self.table[key] = self.target[token] if self._present(state, token) else DEAD
        return known

    def _present(self, state: int, token: int) -> bool:
        parent, lacks, born, made = self.parent, self.lacks, self.born, self.made
        while True:
            k, first, _ = made.get(token, (0, DEAD, DEAD))
            while born[state] > k:
                if lacks[state] == token:
                    return False
                state = parent[state]
            if first == DEAD:
                return True
            token = first  # the gadget gave c-arcs to the states that had an a-arc then

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens along the one accepted path that spells ``word``.

        Depth first, longest label first; a position from which no path goes on is never
        entered again, as all accepted paths to it are one.
        """
        text = word.decode("latin-1")
        n, pos = len(text), 0
        target, table, shorter, size, prefixes = self.target, self.table, self.shorter, self.size, self.prefixes
        known = self.trie.longest_prefix  # how far the text goes on as the beginning of any label
        tokens: list[int] = []
        states = [0]
        shut: set[int] = set()
        reach = self.reach
        rest = text[:reach]
        t = prefixes[rest[: known(rest)]]
        while True:
            here = states[-1]
            while t != DEAD:
                if pos + size[t] not in shut:
                    to = table.get((here, t))
                    if to is None:
                        to = self.arc(here, t)
                    if to != DEAD:
                        break
                t = shorter[t]
            if t == DEAD:
                shut.add(pos)
                states.pop()
                t = tokens.pop()
                pos -= size[t]
                t = shorter[t]
                continue
            tokens.append(t)
            pos += size[t]
            if pos == n:
                return tokens
            states.append(target[t])
            rest = text[pos : pos + reach]
            t = prefixes[rest[: known(rest)]]

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.special and (parts := self.special.split(text)) and len(parts) > 1:
            return b"".join(self.added[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        words = self.split.findall(text)
        out = list(map(self.memo.get, words))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    out[i] = self._word(words[i])
        if len(self.table) > 4_000_000:
            self.table.clear()
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        x = self.memo.get(word) or self.older.get(word)
        if x is None:
            x = np.array(self.encode_word(word.encode()), "<u4").tobytes()
        if len(word) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_WORDS:
                self.older, self.memo = self.memo, {}
            self.memo[word] = x
        return x

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return b"".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_automata: dict[str, MergeAutomaton] = {}


def _check(spec: dict) -> None:
    """Refuses files that ask for more than byte-level BPE with the usual word pattern."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not spec.get("normalizer") and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    split = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    tokens = not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    if not (plain and split and tokens):
        raise ValueError("only byte-level BPE without normalizer, prefix space and stripping tokens is supported")


def automaton(path: str) -> MergeAutomaton:
    """The automaton of a byte-level BPE file in the tokenizers library's JSON form, once per worker."""
    if path not in _automata:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        _automata[path] = MergeAutomaton(vocab, merges, added, PATTERN)
    return _automata[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs (doc_id, text)``.

    ``path`` names the vocabulary file, which is installed with the workers' Python.
    """
    small_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chalkline.llm.bpe import automaton

        machine = automaton(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch.column(1).to_pylist():
                ids = machine.encode(text or "")
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(machine.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """The operator's real output: doc_id and the token ids of the whole text."""
    small_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chalkline.llm.bpe import automaton

        machine = automaton(path)
        for batch in batches:
            ids = [np.frombuffer(machine.encode(x or ""), "<u4").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")
