"""How well single vectors tell a regime: class-balanced logistic regression, all folds at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

from .metrics import auc, balanced_accuracy
from .sampling import balanced, in_training, place, training_thresholds

#: Rows of a sample that a task holds at a time, and about how many rows of it are a partition.
SLICE, PART = 2048, 8192


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    return flat.reshape(len(vectors), -1)


def _usable(vector: str) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size(vector) > 0), F.lit(False))


def _slices(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    for p in parts:
        for i in range(0, p.num_rows, SLICE):
            s = p.slice(i, SLICE)
            yield _matrix(s.column(0)), s.column(1).to_numpy(zero_copy_only=False).astype(np.float64), s.column(2).to_pylist()


def _summed(sample: DataFrame, of_fold, folds: Sequence[int]) -> dict[int, np.ndarray]:
    """For each fold the sum over its training rows of of_fold(f, x, y), an array of rows; summed by row over the tasks."""

    def part(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for x, y, held in _slices(parts):
            for f in folds:
                mine = np.array([f in h for h in held], dtype=bool)
                if mine.any():
                    a = of_fold(f, x[mine], y[mine])
                    sums[f] = sums[f] + a if f in sums else a
        for f, a in sums.items():
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), f, np.int32)), pa.array(np.arange(len(a), dtype=np.int32)), cells], names=["fold", "i", "cells"])

    def total(t: pa.Table) -> pa.Table:
        cells = np.concatenate([_matrix(c) for c in t["cells"].chunks if len(c)])
        return pa.table({"fold": t["fold"][:1], "i": t["i"][:1], "cells": pa.array([cells.sum(axis=0)])})

    schema = "fold int, i int, cells array<double>"
    rows = sample.select("vector", "y", "trains").mapInArrow(part, schema).groupBy("fold", "i").applyInArrow(total, schema)
    out: dict[int, dict[int, list]] = {}
    for r in rows.collect():  # folds x (length of a vector) rows
        out.setdefault(r["fold"], {})[r["i"]] = r["cells"]
    return {f: np.array([of[i] for i in range(len(of))]) for f, of in out.items()}


def newton(sample: DataFrame, quota: dict[tuple[int, int], int], folds: Sequence[int], c: float = 0.1, steps: int = 30, tolerance: float = 1e-8) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vector, y, trains: folds that train on the row) -> mean, deviation, weights (the last is the constant) of each fold.

    Minimises c x weighted log loss + |w|^2 / 2 over standardised vectors, the constant is free and both
    classes weigh the same. One job a step gives gradients and Hessians of all folds; a step that
    raises a fold's loss is halved. Deviations of 0 count as 1.
    """
    moments = _summed(sample, lambda f, x, y: np.stack([x.sum(axis=0), (x * x).sum(axis=0), np.full(x.shape[1], float(len(x)))]), folds)
    fits, state = {}, {}
    for f, (total, squares, n) in moments.items():
        mean = total / n
        dev = np.sqrt(np.maximum(squares / n - mean * mean, 0))
        fits[f] = mean, np.where(dev > 1e-12 * np.sqrt(squares / n + 1e-300), dev, 1.0)
        held = quota[f, 0] + quota[f, 1]
        state[f] = {"w": np.zeros(len(mean) + 1), "loss": np.inf, "step": None, "weight": tuple(held / (2 * quota[f, y]) for y in (0, 1))}
    at = lambda f: state[f]["w"] if state[f]["step"] is None else state[f]["w"] + state[f]["step"]
    going = list(state)
    for _ in range(steps):
        if not going:
            break
        tried = {f: (*fits[f], at(f), state[f]["weight"]) for f in going}

        def second_order(f: int, x: np.ndarray, y: np.ndarray, tried=tried) -> np.ndarray:
            """Rows of the Hessian with the gradient and the loss beside them."""
            mean, dev, w, (zero, one) = tried[f]
            x = np.column_stack([(x - mean) / dev, np.ones(len(x))])
            z, weight = x @ w, np.where(y == 1, one, zero)
            p = 0.5 * (1 + np.tanh(z / 2))
            loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
            return np.column_stack([(x * (weight * p * (1 - p))[:, None]).T @ x, x.T @ (weight * (p - y)), np.full(len(w), loss)])

        sums = _summed(sample, second_order, going)
        still = []
        for f in going:
            s, w, a = state[f], tried[f][2], sums[f]
            ridge = np.append(np.ones(len(w) - 1), 0.0)
            loss = c * a[0, -1] + float((ridge * w * w).sum()) / 2
            if loss > s["loss"] * (1 + 1e-12) and s["step"] is not None:
                s["step"] = s["step"] / 2
                still.append(f)
                continue
            gradient = c * a[:, -2] + ridge * w
            step = np.linalg.solve(c * a[:, :-2] + np.diag(ridge + 1e-12), -gradient)
            s.update(w=w, loss=loss, step=step)
            if -float(gradient @ step) > tolerance * max(1.0, loss):
                still.append(f)
            else:  # so near that the last step is taken unseen; it squares the distance
                s["w"] = w + step
        going = still
    return {f: (*fits[f], state[f]["w"]) for f in state}


def decoding_sample(rows: DataFrame, folds: int = 5, n: int = 20000, seed: int = 0) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(key, fold, y, ...) with ``place`` and ``trains``: the folds whose training sample of n rows outside the fold, half of each y, holds the row.

    The same row has the same place for all folds; nothing but the filter moves or reads the other
    columns. Also the rows of each (fold, y). Folds whose other folds lack a class train on nothing.
    """
    rows = rows.withColumn("place", place(F.lit(str(seed)), F.col("key")))
    counts = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    quota = {k: v for k, v in balanced(counts, range(folds), n).items()}
    whole = [f for f in range(folds) if quota[f, 0] and quota[f, 1] and any(g == f for g, _ in counts)]
    quota = {(f, y): quota[f, y] for f in whole for y in (0, 1)}
    thresholds = training_thresholds(rows.select("fold", "y", "place"), folds, quota)
    trains = in_training(thresholds, whole) if whole else F.array().cast("array<int>")
    return rows.withColumn("trains", trains), quota


def scores(rows: DataFrame, folds: int = 5, c: float = 0.1, n: int = 20000, seed: int = 0, steps: int = 30) -> DataFrame:
    """(fold, y, vector, key if there is one) -> fold, y, score of every row, by the fit of the folds that aren't its own.

    Vectors that are null, empty or hold null or non-finite components take no part; different
    lengths are an error. Folds are 0 .. folds - 1, y is 0 or 1; rows of others take no part. Without a
    key, rows of equal vector and y have one place and are drawn together.
    """
    key = F.col("key").cast("string") if "key" in rows.columns else F.xxhash64("vector", "y").cast("string")
    rows = rows.where(_usable("vector") & F.col("y").isin(0, 1) & F.col("fold").between(0, folds - 1))
    rows = rows.select("fold", "y", F.transform("vector", lambda x: x.cast("double")).alias("vector"), key.alias("key"))
    lengths = rows.agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).first()
    if lengths["a"] != lengths["b"]:
        raise ValueError(f"vectors have {lengths['a']} to {lengths['b']} components")
    drawn, quota = decoding_sample(rows, folds, n, seed)
    whole = sorted({f for f, _ in quota})
    if not whole:
        return rows.sparkSession.createDataFrame([], "fold int, y int, score double")
    # at most folds x n rows, read once a step
    parts = max(1, -(-sum(quota.values()) // (len(whole) * PART)))
    fits = newton(cut(drawn.where(F.size("trains") > 0).select("vector", "y", "trains").coalesce(parts)), quota, whole, c, steps)

    @F.pandas_udf("double")
    def score(fold: pd.Series, vector: pd.Series) -> pd.Series:
        out = np.empty(len(fold))
        for f in fold.unique():
            mean, dev, w = fits[int(f)]
            mine = (fold == f).to_numpy()
            z = (np.stack(vector[mine].to_list()) - mean) / dev @ w[:-1] + w[-1]
            out[mine] = 0.5 * (1 + np.tanh(z / 2))
        return pd.Series(out)

    return rows.where(F.col("fold").isin(whole)).select("fold", "y", score("fold", "vector").alias("score"))


def regime_decoding(rows: DataFrame, folds: int = 5, c: float = 0.1, months: Sequence[int] | None = None, steps: int = 30, n: int = 20000, seed: int = 0) -> DataFrame:
    """(fold, y, vector array, ts if months are given) -> fold, n, auc, balanced_accuracy of each held-out fold.

    A fold's fit sees a balanced sample of at most ``n`` rows of the other folds; all rows are scored.
    ``months`` leaves only rows of those months. A fold without rows, or without both classes in its
    training folds, has no row.
    """
    if months is not None:
        rows = rows.where(F.month("ts").isin(list(months)))
    scored = cut(scores(rows, folds, c, n, seed, steps))
    sizes = scored.groupBy("fold").agg(F.count("*").alias("n"))
    return sizes.join(auc(scored, ["fold"]), "fold").join(balanced_accuracy(scored, ["fold"]), "fold")


def overall_decoding(rows: DataFrame, folds: int = 5, c: float = 0.1, n: int = 20000, seed: int = 0) -> DataFrame:
    """One row: n, auc, balanced_accuracy of all held-out scores together."""
    scored = cut(scores(rows, folds, c, n, seed).withColumn("all", F.lit(0)))
    sizes = scored.groupBy("all").agg(F.count("*").alias("n"))
    return sizes.join(auc(scored, ["all"]), "all").join(balanced_accuracy(scored, ["all"]), "all").drop("all")
