"""Toxicity categories by a classifier chain.

Each category has a linear model over evidence from words and their beginnings, and over the
probabilities of the categories before it. In training both come from out-of-fold models, so a later
model learns from predictions as good as those it will get, not from ones that knew the answer.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw, utf8
from .training import fitted, labelled_sample

#: Bits of a hashed feature, lengths (bytes) of word beginnings. Words of more than LONGEST bytes, and
#: passages without blanks, also give their grams of GRAM bytes.
BITS, BEGINNINGS, LONGEST, GRAM = 18, (4, 6), 12, 6
#: The sample: at most so many rows of each value of toxic. Folds of the out-of-fold models.
PER_CLASS, FOLDS = 2000, 4
#: Bytes of a whole text whose features are made at a time.
_SLICE = 1 << 20

#: The chain, in order: any toxicity, and of what kind by the two labels there are.
CATEGORIES = {
    "toxic": lambda: F.col("toxic") == 1,
    "toxic_prose": lambda: (F.col("toxic") == 1) & (F.col("quality") == 1),
    "toxic_junk": lambda: (F.col("toxic") == 1) & (F.col("quality") == 0),
}


_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    return tuple(np.append(np.uint64(1), np.cumprod(np.full(size - 1, x, np.uint64))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _features(data: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + data + b" ", dtype=np.uint8)
    inside = ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57)) | (b >= 128)
    first, end = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(~inside[1:] & inside[:-1]) + 1
    size = end - first
    # sums of bytes times powers: the difference of two, shifted back, is a hash of the bytes between
    power, back = _powers(1 << max(12, (len(b) - 1).bit_length()))
    sums = np.append(np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)]))
    out = []

    def add(i: np.ndarray, j: np.ndarray, kind: int) -> None:
        h = (sums[j] - sums[i]) * back[i] ^ np.uint64(kind * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        out.append((h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(64 - BITS))

    add(first, end, 0)
    for k in BEGINNINGS:
        add(first[size >= k], first[size >= k] + k, k)
    long = size > LONGEST
    n = size[long] - GRAM + 1
    at = np.repeat(first[long], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    add(at, at + GRAM, LONGEST)
    return np.unique(np.concatenate(out)).astype(np.uint32)


def features(text: str | bytes | None) -> np.ndarray:
    """Hashed words, word beginnings and grams of long words that a whole text has, each once, A-Z lower-cased."""
    data = raw(text).lower()
    parts, a = [], 0
    while a < len(data):  # long texts in slices that end at a blank, or where none comes for another slice
        b = len(data) if len(data) - a <= _SLICE else (data.find(b" ", a + _SLICE, a + 2 * _SLICE) + 1 or min(len(data), a + 2 * _SLICE))
        parts.append(_features(data[a:b]))
        a = b
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint32)


def _ratios(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of the share of positive and negative texts that have a feature, smoothed."""
    count = lambda part: np.bincount(np.concatenate(part), minlength=1 << BITS) if part else np.zeros(1 << BITS)
    yes, no = ([d for d, v in zip(docs, y, strict=True) if v == c] for c in (1, 0))
    return (np.log((count(yes) + 0.5) / (len(yes) + 1)) - np.log((count(no) + 0.5) / (len(no) + 1))).astype(np.float32)


def evidence(ratios: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The strongest features' ratios (1, 3 and 10 of them), their mean over all, and the size."""
    if not len(doc):
        return np.zeros(5)
    r = ratios[doc].astype(np.float64)
    top = np.sort(np.partition(r, max(0, len(r) - 10))[-10:])[::-1]
    return np.array([top[0], top[:3].sum() / 3, top.sum() / 10, r.mean(), np.log1p(len(doc)) / 10])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logits(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -15, 15)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def fit(rows: pd.DataFrame, names: list[str], weight: float = 1.0) -> dict[str, np.ndarray]:
    """ratios_j and weights_j of every category of the chain, from text and 0/1 columns.

    ``weight`` is the odds of the first category in all labelled rows, divided by those in the sample.
    """
    docs = [features(t) for t in rows["text"]]
    fold = np.random.default_rng(0).permutation(len(docs)) % FOLDS
    model, chain = {}, np.empty((len(docs), 0))
    for j, name in enumerate(names):
        y = rows[name].to_numpy().astype(np.float64)
        x = np.zeros((len(docs), 5))
        for f in range(FOLDS):
            other = np.flatnonzero(fold != f)
            ratios = _ratios([docs[i] for i in other], y[other])
            for i in np.flatnonzero(fold == f):
                x[i] = evidence(ratios, docs[i])
        x = np.column_stack([x, chain])
        own = np.zeros(len(docs))
        for f in range(FOLDS):
            own[fold == f] = _logits(_logistic(x[fold != f], y[fold != f]), x[fold == f])
        model[f"ratios_{j}"], model[f"weights_{j}"] = _ratios(docs, y), _logistic(x, y)
        model[f"weights_{j}"][-1] += np.log(weight) if j == 0 else 0.0
        chain = np.column_stack([chain, _sigmoid(own + (np.log(weight) if j == 0 else 0.0))])
    return model


def probabilities(model: dict[str, np.ndarray], text: str | bytes | None) -> list[float]:
    doc, chain = features(text), np.empty(0)
    for j in range(len(model) // 2):
        x = np.concatenate([evidence(model[f"ratios_{j}"], doc), chain])
        chain = np.append(chain, _sigmoid(_logits(model[f"weights_{j}"], x)))
    return chain.tolist()


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, per_class: int = PER_CLASS) -> dict[str, np.ndarray]:
    """The chain for ``categories`` (name -> condition on labels); the first one balances the sample."""
    names = list(categories)
    flags = labels.select("doc_id", *(f().cast("int").alias(c) for c, f in categories.items()))
    known = flags.where(" and ".join(f"{c} is not null" for c in names))
    share = known.agg(F.avg(names[0])).first()[0]
    sample = labelled_sample(docs, known, names[0], per_class, *names[1:])

    def chain(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        there = rows[names[0]].mean()
        odds = lambda p: np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4))
        return fit(rows, names, odds(share) / odds(there))

    return fitted(sample, chain)


def score(docs: DataFrame, model: dict[str, np.ndarray], names=tuple(CATEGORIES), threshold: float = 0.5) -> DataFrame:
    """doc_id, p_<category> for each category, and is_toxic: the first reaches ``threshold``.

    One row per row of docs, from the whole text alone. Null and empty texts have no evidence. Without
    labelled rows there is no model; then all probabilities are 0.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def chain(texts: pa.Array) -> pa.Array:
        return pa.array([probabilities(model, t) if model else [0.0] * len(names) for t in utf8(texts)], pa.list_(pa.float64()))

    def p(i: int) -> Column:
        return F.col("p")[i].alias(f"p_{names[i]}")

    rows = docs.select("doc_id", chain("text").alias("p"))
    return rows.select("doc_id", *map(p, range(len(names))), (F.col("p")[0] >= threshold).cast("int").alias("is_toxic"))
