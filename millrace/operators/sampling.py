"""Samples of an exact size by thresholds of a hash: found from histograms, drawn by a filter, nothing is sorted."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a place, and of a level of its histogram.
BITS, LEVEL = 60, 12


def place(*parts: Column) -> Column:
    """A reproducible number of 60 bits from the text of its parts; it orders as the first 15 digits of their md5 do."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, BITS // 4), 16, 10).cast("long")


def training_thresholds(rows: DataFrame, folds: int, quota: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """(fold, y, place) -> threshold of each (f, y): as many rows of y outside fold f have a smaller place as ``quota`` says.

    A quota is at most the rows there are. A level is one histogram of at most folds x 2 x 4096 counts,
    of the rows in buckets that a threshold still divides. Rows of equal places stay together: if
    they don't all fit they are left out, so only repeated keys make a sample smaller.
    """
    out: dict[tuple[int, int], int] = {}
    prefix = {k: (0, q) for k, q in quota.items()}  # bucket that holds the threshold, rows still wanted of it
    for level in range(BITS // LEVEL):
        shift = BITS - LEVEL * (level + 1)
        at = F.shiftright("place", shift)
        inside = sorted({(y, p) for (_, y), (p, _) in prefix.items()})
        if not inside:
            break
        some = rows if level == 0 else rows.where(F.array_contains(F.array(*(F.struct(F.lit(y).alias("y"), F.lit(p).cast("long").alias("p")) for y, p in inside)), F.struct(F.col("y"), F.shiftright("place", shift + LEVEL).alias("p"))))
        counts: dict[tuple[int, int], np.ndarray] = {}
        for r in some.groupBy("fold", "y", at.alias("b")).agg(F.count("*").alias("n")).collect():
            high, low = r["b"] >> LEVEL, r["b"] & ((1 << LEVEL) - 1)
            counts.setdefault((r["y"], high), np.zeros((folds, 1 << LEVEL), np.int64))[r["fold"], low] = r["n"]
        following = {}
        for (f, y), (p, want) in prefix.items():
            of = counts.get((y, p), np.zeros((folds, 1 << LEVEL), np.int64))
            sums = (of.sum(axis=0) - of[f]).cumsum()
            b = int(np.searchsorted(sums, want, side="right"))  # buckets before b fit whole
            rest = want - (int(sums[b - 1]) if b else 0)
            if rest == 0 or b == 1 << LEVEL or level == BITS // LEVEL - 1:
                out[f, y] = ((p << LEVEL) + b) << shift
            else:
                following[f, y] = ((p << LEVEL) + b, rest)
        prefix = following
    return out


def balanced(counts: dict[tuple[int, int], int], folds: Sequence[int], n: int) -> dict[tuple[int, int], int]:
    """Rows of (fold, y) -> how many of each y fold f trains on: half of n, more of one if the other has fewer."""
    out = {}
    for f in folds:
        zero, one = (sum(k for (g, y), k in counts.items() if g != f and y == label) for label in (0, 1))
        take = min(one, max(n // 2, n - zero))
        out[f, 1], out[f, 0] = take, min(zero, n - take)
    return out


def in_training(thresholds: dict[tuple[int, int], int], folds: Sequence[int]) -> Column:
    """The folds whose training sample holds a row (fold, y, place), as an array; a few comparisons a row, no join."""
    of = lambda f, y: (F.col("fold") != f) & (F.col("y") == y) & (F.col("place") < F.lit(thresholds[f, y]))
    return F.array_compact(F.array(*(F.when(of(f, 0) | of(f, 1), F.lit(f)) for f in folds)))
