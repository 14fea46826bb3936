"""Baselines that need no training: the clock, and the largest of given components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clock(bags: DataFrame, present: str, time_keys: Sequence[str]) -> DataFrame:
    """bag_id, fold, score: the mean of ``present`` at the same time keys in the other folds.

    A time that no other fold has gets the mean of all other folds. Sums by (fold, time) are taken
    once; a fold's training sums are the totals less its own, so nothing is scanned once a fold.
    """
    keys = list(time_keys)
    sums = bags.groupBy("fold", *keys).agg(F.sum(present).alias("s"), F.count("*").alias("n"))
    total = sums.groupBy(*keys).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    whole = sums.groupBy("fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    everything = sums.agg(F.sum("s").alias("as"), F.sum("n").alias("an"))
    rate = sums.join(total, keys).join(whole, "fold").crossJoin(F.broadcast(everything))
    prior = (F.col("as") - F.col("fs")) / F.nullif(F.col("an") - F.col("fn"), F.lit(0))
    own = (F.col("ts") - F.col("s")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0))
    rate = rate.select("fold", *keys, F.coalesce(own, prior).alias("score"))
    return bags.join(rate, ["fold", *keys]).select("bag_id", "fold", F.col(present).alias("y"), "score")


def zero_shot(instances: DataFrame, bag: Column, vector: str, columns: Sequence[int]) -> DataFrame:
    """bag_id, score: the largest of some components over the instances of a bag; absent ones don't count."""
    picked = F.array(*(F.try_element_at(vector, F.lit(c + 1)) for c in columns))
    return instances.groupBy(bag.alias("bag_id")).agg(F.max(F.array_max(picked)).cast("double").alias("score"))
