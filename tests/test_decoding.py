"""Samples of an exact size and fits of all folds at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import decoding, sampling

SCHEMA = "key string, fold int, y int, vector array<double>"


def planted(n, folds=3, seed=0, dim=4):
    rng = np.random.default_rng(seed)
    return [(str(i), i % folds, int(i % 4 == 0), (rng.standard_normal(dim) * 3 + 2.0 * (i % 4 == 0)).tolist()) for i in range(n)]


def plain_fit(x, y, c):
    """Gradient descent with backtracking on the objective as it is written."""
    mean, dev = x.mean(axis=0), x.std(axis=0)
    x = np.column_stack([(x - mean) / dev, np.ones(len(x))])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    ridge = np.append(np.ones(x.shape[1] - 1), 0)
    loss = lambda w: c * (weight * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + (ridge * w * w).sum() / 2
    w, rate = np.zeros(x.shape[1]), 1.0
    for _ in range(5000):
        g = c * x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)) + ridge * w
        while loss(w - rate * g) > loss(w) - rate * (g @ g) / 4 and rate > 1e-12:
            rate /= 2
        w, rate = w - rate * g, rate * 1.5
    return mean, dev, w


def test_all_folds_equal_single_fits(spark):
    rows = planted(300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    drawn, quota = decoding.decoding_sample(df, 3, 120)
    held = drawn.where(F.size("trains") > 0).collect()
    fits = decoding.newton(drawn, quota, [0, 1, 2])
    for f in range(3):
        mine = [r for r in held if f in r["trains"]]
        assert len(mine) == 120 and sum(r["y"] for r in mine) == 50 and all(r["fold"] != f for r in mine)  # all 50 of the rarer class, 70 of the other
        want = plain_fit(np.array([r["vector"] for r in mine]), np.array([r["y"] for r in mine]), 0.1)
        for got, plain in zip(fits[f], want, strict=True):
            assert got == pytest.approx(plain, abs=1e-5)


@pytest.mark.parametrize("n", [1, 2, 7, 50, 199, 10_000])
def test_samples_are_exact(spark, n):
    rows = planted(400)
    got = decoding.decoding_sample(spark.createDataFrame(rows, SCHEMA), 3, n)[0].select("key", "place", "fold", "y", F.explode("trains").alias("f")).collect()
    everything = spark.createDataFrame(rows, SCHEMA).withColumn("place", sampling.place(F.lit("0"), F.col("key"))).collect()
    for f in range(3):
        of = {y: sorted((r["place"], r["key"]) for r in everything if r["fold"] != f and r["y"] == y) for y in (0, 1)}
        one = min(len(of[1]), max(n // 2, n - len(of[0])))
        zero = min(len(of[0]), n - one)
        want = {k for _, k in of[1][:one] + of[0][:zero]} if one and zero else set()
        assert {r["key"] for r in got if r["f"] == f} == want


def test_thresholds_go_down_to_the_last_bit(spark):
    # places that differ in the lowest bits alone, and one that many rows share
    rows = [(i % 2, 1, (5 << 40) + i) for i in range(20)] + [(0, 1, 9 << 50)] * 30
    df = spark.createDataFrame(rows, "fold int, y int, place long")
    got = sampling.training_thresholds(df, 2, {(0, 1): 4, (1, 1): 7})
    assert sum(f == 1 and p < got[0, 1] for f, _, p in rows) == 4 and sum(f == 0 and p < got[1, 1] for f, _, p in rows) == 7
    # of thirty rows with one place ten can't be taken: none is
    assert sum(f == 0 and p < sampling.training_thresholds(df, 2, {(1, 1): 20})[1, 1] for f, _, p in rows) == 10


def test_scores_and_odd_rows(spark):
    rows = planted(240)
    odd = [("n", 0, 1, None), ("e", 0, 1, []), ("x", 1, 0, [1.0, None, 0.0, 0.0]), ("i", 1, 0, [1.0, float("inf"), 0.0, 0.0]), ("f", 9, 1, [1.0] * 4), ("l", 0, None, [1.0] * 4)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    assert decoding.scores(df, 3).count() == 240
    one = decoding.overall_decoding(df, 3).first()
    assert one["n"] == 240 and one["auc"] > 0.8 and one["balanced_accuracy"] > 0.7
    with pytest.raises(ValueError, match="3 to 4 components"):
        decoding.scores(df.unionByName(spark.createDataFrame([("s", 0, 1, [1.0] * 3)], SCHEMA)), 3)
    assert decoding.scores(df.where("y = 1"), 3).count() == 0 and decoding.scores(df.limit(0), 3).count() == 0
