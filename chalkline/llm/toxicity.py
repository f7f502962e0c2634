"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over hashed words; each model
also sees the probabilities of the categories before it.  For training these come from
out-of-fold predictions, so a later model learns from probabilities as uncertain as those
it will meet.  Scoring uses the models fitted on the whole sample.

Training uses at most ``sample`` labelled documents (a documented bound), taken by a
seeded hash of their ids; the fits of one category (the whole sample, and each fold left
out) run as separate Spark groups.  Scoring covers every document and its whole text in
one pass without a shuffle.

Defined results: null and empty texts have no words and get the models' intercepts; null
labels leave the row out of training, of differing labels of one id the greater counts, and
of several texts with one id the one with the least hash; repeated rows give repeated rows; with no usable
labels, or only one class of a category, that category's probability is the class's
share; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import small_arrow_batches, written

#: Labelled documents used for fitting at most.
SAMPLE = 12_000
FOLDS = 3
#: Slots that words are hashed to.
SLOTS = 1 << 18
#: A document is rejected from this probability of the last category on.
THRESHOLD = 0.4
MEMO_WORDS = 300_000
SLOT_STEP = 20.0

_WORD = re.compile(r"[^\W_]+")
_memo: dict[str, int] = {}


def slots(text: str | None) -> np.ndarray:
    """The distinct slots of the lower-cased words of the whole text."""
    found = []
    for w in set(_WORD.findall((text or "").lower())):
        s = _memo.get(w)
        if s is None:
            if len(_memo) >= MEMO_WORDS:
                _memo.clear()
            s = _memo[w] = xxhash.xxh64_intdigest(w) % SLOTS
        found.append(s)
    return np.unique(np.array(found, np.int32))


def forget() -> None:
    """Empties the memo at the end of a task: the worker goes on to other stages."""
    _memo.clear()


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_linear(
    rows: Sequence[np.ndarray], extra: np.ndarray, y: np.ndarray, l1: float = 4e-4, l2: float = 1e-5, steps: int = 150
) -> np.ndarray:
    """Logistic weights ``[slots..., extra..., bias]``: L1 picks the slots, a refit on those sets the weights."""
    n, k = len(rows), extra.shape[1]
    out = np.zeros(SLOTS + k + 1, np.float64)
    share = float(y.mean()) if n else 0.0
    if n == 0 or share in (0.0, 1.0):
        out[-1] = np.log((share * n + 0.5) / (n - share * n + 0.5)) if n else -35.0
        return out
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    ids = np.concatenate(rows) if len(owner) else np.zeros(0, np.int32)
    keep = np.bincount(ids, minlength=SLOTS)[ids] >= 3
    owner, ids = owner[keep], ids[keep]
    chosen = np.unique(ids)
    for penalty, ridge, count in ((l1, 0.0, steps), (0.0, l2, steps)):
        at = np.isin(ids, chosen)
        own, col = owner[at], np.searchsorted(chosen, ids[at])
        m = len(chosen)
        w, bias, e = np.zeros(m), np.log(share / (1 - share)), np.zeros(k)
        v, vb, ve, t = w, bias, e, 1.0
        step = 4.0 / max(1.0, np.sqrt(np.bincount(own, minlength=n).max(initial=1)))
        loss = np.inf
        for _ in range(count):
            z = np.bincount(own, v[col], n) + extra @ ve + vb
            r = (_sigmoid(z) - y) / n
            now = float(np.logaddexp(0, z).mean() - (y * z).mean()) + penalty * np.abs(v).sum() + ridge * (v @ v) / 2
            if now > loss + 1e-9:
                step, v, vb, ve, t, loss = step / 2, w, bias, e, 1.0, np.inf
                continue
            loss = now
            g = np.bincount(col, r[own], m) + ridge * v
            w2 = v - SLOT_STEP * step * g  # slots are rare, so they take longer steps than the bias
            w2 = np.sign(w2) * np.maximum(np.abs(w2) - SLOT_STEP * step * penalty, 0)
            b2, e2 = vb - step * r.sum(), ve - step * (extra.T @ r)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            a = (t - 1) / t2
            v, vb, ve = w2 + a * (w2 - w), b2 + a * (b2 - bias), e2 + a * (e2 - e)
            w, bias, e, t = w2, b2, e2, t2
        if penalty:
            chosen = chosen[np.abs(w) > 0]
            if not len(chosen):
                break
    out[chosen] = w if len(chosen) else 0.0
    out[SLOTS : SLOTS + k] = e
    out[-1] = bias
    return out


def predict_linear(model: np.ndarray, rows: Sequence[np.ndarray], extra: np.ndarray) -> np.ndarray:
    own = np.array([model[r].sum() for r in rows]) if len(rows) else np.zeros(0)
    return _sigmoid(own + extra @ model[SLOTS:-1] + model[-1])


@dataclass
class Chain:
    """The fitted models in chain order, each ``[slots, earlier categories, bias]``."""

    categories: Sequence[str]
    models: list[np.ndarray] = field(default_factory=list)

    def predict(self, texts: Sequence[str | None]) -> np.ndarray:
        rows = [slots(t) for t in texts]
        out = np.zeros((len(rows), 0))
        for model in self.models:
            out = np.column_stack([out, predict_linear(model, rows, out)])
        return out


def _fits(name: str, earlier: dict[int, tuple], folds: int):
    """Fits each ``fit`` that comes: on all of the sample (-1) or without one fold, which it predicts.

    A fit is the whole sample in one task: at most ``sample`` rows of slots.
    """
    width = len(next(iter(earlier.values()))) if earlier else 0

    def one(fit: int, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        ids = part["id"].to_numpy()
        found = [np.asarray(x, np.int64) for x in part["slots"]]
        extra = np.array([earlier[x] for x in ids.tolist()]).reshape(len(ids), width) if width else np.zeros((len(ids), 0))
        y = part[name].to_numpy(float)
        fold = np.array([xxhash.xxh64_intdigest(str(x)) % folds for x in ids.tolist()])
        out = fold == fit
        model = fit_linear([r for r, o in zip(found, out, strict=True) if not o], extra[~out], y[~out])
        p = predict_linear(model, [r for r, o in zip(found, out, strict=True) if o], extra[out])
        at = np.flatnonzero(model)
        return pd.DataFrame({"fit": [fit], "at": [at.astype(np.int32).tolist()], "weights": [model[at].tolist()], "ids": [ids[out].tolist()], "p": [p.tolist()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [x for x in batches if len(x)]
        if held:
            for fit, part in pd.concat(held).groupby("fit"):
                yield one(int(fit), part)

    return run


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE, folds: int = FOLDS) -> Chain:
    """Fit the chain on labelled documents.

    ``categories`` maps each category, in chain order, to a 0/1 column of ``labels``.
    Where labels of one id differ, the greater one counts; where an id has several texts,
    the one with the least hash is used.  So reruns agree, whatever the order of rows.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    names = list(categories)
    own = [f"y{i}" for i in range(len(names))]
    chosen = (
        labels.select(F.col("doc_id").alias("id"), *(c.cast("double").alias(n) for n, c in zip(own, categories.values(), strict=True)))
        .dropna()
        .groupBy("id")
        .agg(*(F.max(n).alias(n) for n in own))
        .orderBy(F.xxhash64("id", F.lit("sample")), "id")
        .limit(sample)
    )
    chosen = written(chosen, "labelled")
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body")).join(F.broadcast(chosen), "id")  # at most ``sample`` rows
    texts = texts.select("id", F.xxhash64(F.coalesce("body", F.lit(""))).alias("hash"), "body", *own)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slots(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int32())), *batch.columns[3:]], names=["id", "hash", "slots", *own])
        forget()

    schema = "id bigint, hash bigint, slots array<int>, " + ", ".join(f"{n} double" for n in own)
    rows = texts.mapInArrow(featurize, schema).groupBy("id").agg(F.min(F.struct("hash", "slots", *own)).alias("x"))
    rows = written(rows.select("id", "x.slots", *(f"x.{n}" for n in own)), "features")
    chain, known = Chain(names), {}
    for i, name in enumerate(own):
        keys = [-1] if i + 1 == len(own) else [-1, *range(folds)]
        earlier = dict(known)
        # every fit is a range of its own, so each has a task to itself
        dealt = rows.select("id", "slots", name, F.explode(F.array(*(F.lit(f) for f in keys))).alias("fit")).repartitionByRange(len(keys), "fit")
        done = dealt.mapInPandas(_fits(name, earlier, folds), "fit int, at array<int>, weights array<double>, ids array<bigint>, p array<double>").collect()  # one row a fit, bounded by the sample
        model = np.zeros(SLOTS + i + 1)
        model[-1] = -35.0
        for r in done:
            if r["fit"] == -1:
                model[:] = 0
                model[r["at"]] = r["weights"]
            for x, p in zip(r["ids"], r["p"], strict=True):
                known[x] = (*earlier.get(x, ()), p)
        chain.models.append(model)
    return chain


def label_categories() -> dict[str, Column]:
    """The chain of the labels table: junk first, as junk shifts a text's words, then toxic."""
    return {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}


def score(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, p_<category> for each category, rejected (by the last) for every row of ``docs``."""
    chain = fit_chain(docs, labels, categories or label_categories(), sample)
    model = docs.sparkSession.sparkContext.broadcast(chain)  # SLOTS weights a category, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(p[:, i]) for i in range(p.shape[1])), pa.array(p[:, -1] >= threshold)],
                names=["doc_id", *(f"p_{c}" for c in model.value.categories), "rejected"],
            )
        forget()

    schema = "doc_id bigint, " + ", ".join(f"p_{c} double" for c in chain.categories) + ", rejected boolean"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns whatever their names.

    Every row is decided by its own text: null counts as empty, ids don't matter here.
    """
    chain = fit_chain(docs, labels, label_categories())
    model = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array(p[:, -1] < THRESHOLD))
        forget()

    return docs.mapInArrow(run, docs.schema)
