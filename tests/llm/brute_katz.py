"""A plain-dictionary Katz model, for comparison."""

import math
import zlib
from collections import Counter

from chalkline.llm.katz import CUTOFF, TAIL, discounts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w.decode() for w in (text or "").translate(LOWER).encode().split()] + ["</s>"]


class Model:
    """Counts of every order in dictionaries, probabilities by recursion."""

    def __init__(self, texts, order=2):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            t = tokens(text)
            padded = ["<s>"] * (order - 1) + t
            for i in range(len(t)):
                for k in range(1, order + 1):
                    self.counts[k][tuple(padded[i + order - k : i + order])] += 1
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.factors = [None] + [discounts([sum(x == r for x in c.values()) for r in range(1, CUTOFF + 2)]) for c in self.counts[1:]]
        self.unknown = 1 - sum(self.cut(c, 1) for c in self.counts[1].values()) / self.n if self.n else 1.0
        self.follow = [{} for _ in range(order + 1)]
        for k in range(2, order + 1):
            for gram, c in self.counts[k].items():
                self.follow[k].setdefault(gram[:-1], {})[gram[-1]] = c

    def cut(self, c, k):
        return c - TAIL if c > CUTOFF else c * self.factors[k][c]

    def p(self, word, context):
        """P(word | context), the context a tuple of at most ``order - 1`` words."""
        k = len(context) + 1
        if k == 1:
            c = self.counts[1][(word,)]
            return self.cut(c, 1) / self.n if c else self.unknown
        f = self.follow[k].get(context)
        if f is None:
            return self.p(word, context[1:])
        if word in f:
            return self.cut(f[word], k) / sum(f.values())
        left = 1 - sum(self.cut(c, k) for c in f.values()) / sum(f.values())
        return left / (1 - sum(self.p(w, context[1:]) for w in f)) * self.p(word, context[1:])


def scores(rows, order=2):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base, score)}"""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    m = Model([t for i, t in rows if not held[i]], order)
    one = m.counts[1]
    out = {}
    for i, text in rows:
        t = tokens(text)
        padded = ["<s>"] * (order - 1) + t
        s = sum(math.log10(m.p(w, tuple(padded[j : j + order - 1]))) for j, w in enumerate(t))
        base = sum(math.log10((one[(w,)] + 1) / (m.n + m.v + 1)) for w in t)
        out[i] = (held[i], len(t), sum((w,) in one for w in t), m.n, base, s)
    return out
