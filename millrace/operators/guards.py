"""Checks that tables fit together: what is wrong as rows, and an error if there is any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_none(faults: DataFrame, message: str, shown: int = 5) -> None:
    """ValueError with the first few faults, if there are any; only those reach the driver."""
    some = faults.limit(shown + 1).collect()
    if some:
        listed = "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in some[:shown])
        raise ValueError(f"{message}: {listed}{' ...' if len(some) > shown else ''}")


def unknown(wanted: DataFrame, known: DataFrame, by: Sequence[str]) -> DataFrame:
    """The distinct values of ``by`` that are wanted and not known; null is a value."""
    return wanted.select(*by).distinct().exceptAll(known.select(*by).distinct())


def restricted(rows: DataFrame, regimes: Sequence[str] | None, regime: str = "regime") -> DataFrame:
    """rows of the regimes (all for None); a regime that no row has is an error."""
    if regimes is None:
        return rows
    named = rows.sparkSession.createDataFrame([(r,) for r in regimes], f"{regime} string")
    require_none(unknown(named, rows, [regime]), "no row has the regime")
    return rows.where(F.col(regime).isin(list(regimes)))


def cache_faults(instances: DataFrame, cache: DataFrame, parts: int | None = None) -> DataFrame:
    """(instance_id, bag_id, win_idx) and (instance_id, done) -> fault, at, n: what keeps a cache from standing for the instances.

    missing and unexpected ids and rows not done are counted by bag (null where only the cache has
    the id); gap: windows of a bag that aren't 0, 1, ...; repeated: ids that the cache holds twice.
    ``parts``: partitions of the ids, which Spark doesn't coalesce then.
    """
    dealt = lambda df: df.repartition(parts, "instance_id") if parts else df
    cache = dealt(cache)
    held = cache.groupBy("instance_id").agg(F.count("*").alias("copies"), F.min(F.coalesce("done", F.lit(False)).cast("int")).alias("done"))
    both = instances.select("instance_id", "bag_id", F.lit(1).alias("wanted")).transform(dealt).join(held, "instance_id", "full")
    kind = (
        F.when(F.col("copies").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected")
        .when(F.col("copies") > 1, "repeated").when(F.col("done") == 0, "not done")
    )
    of_ids = both.select(kind.alias("fault"), F.col("bag_id").alias("at")).where("fault is not null").groupBy("fault", "at").agg(F.count("*").alias("n"))
    bags = instances.groupBy("bag_id").agg(F.count("*").alias("n"), F.count_distinct("win_idx").alias("k"), F.min("win_idx").alias("a"), F.max("win_idx").alias("b"))
    gaps = bags.where("a <> 0 or b <> n - 1 or k <> n").select(F.lit("gap").alias("fault"), F.col("bag_id").alias("at"), "n")
    return of_ids.unionByName(gaps)


def bags_without_windows(bags: DataFrame, instances: DataFrame) -> DataFrame:
    return bags.select("bag_id").join(instances.select("bag_id"), "bag_id", "left_anti")


def load_bags(bags: DataFrame, instances: DataFrame, vector: str = "vector") -> DataFrame:
    """bags with n_windows and vectors, those of its windows in order; a bag without any is an error."""
    require_none(bags_without_windows(bags, instances), "bags without windows")
    own = instances.groupBy("bag_id").agg(F.count("*").alias("n_windows"), F.array_sort(F.collect_list(F.struct("win_idx", vector))).alias("w"))
    return bags.join(own.select("bag_id", "n_windows", F.transform("w", lambda s: s[vector]).alias("vectors")), "bag_id")


def model_faults(predictions: DataFrame, bags: DataFrame, dataset_id: str, model: Sequence[str], parts: int | None = None) -> DataFrame:
    """(model, dataset_id, bag_id) -> model, n_missing, n_extra, n_repeated, n_other: models that don't cover the bags once each.

    n_other counts rows of another dataset. Models without a fault have no row. ``parts``: partitions of
    the bags, which Spark doesn't coalesce then.
    """
    dealt = lambda df: df.repartition(parts, "bag_id") if parts else df
    known, predictions = dealt(bags.select("bag_id")).distinct(), dealt(predictions)
    total = known.agg(F.count("*").alias("total"))
    rows = predictions.groupBy(*model, "bag_id").agg(F.count("*").alias("copies"), F.count_if(~F.col("dataset_id").eqNullSafe(F.lit(dataset_id))).alias("other"))
    seen = rows.join(known.withColumn("known", F.lit(1)), "bag_id", "left")
    of = seen.groupBy(*model).agg(
        F.count_if(F.col("known").isNotNull()).alias("found"), F.count_if(F.col("known").isNull()).alias("n_extra"),
        F.sum((F.col("copies") > 1).cast("int")).alias("n_repeated"), F.sum("other").alias("n_other"),
    )
    out = of.crossJoin(F.broadcast(total)).withColumn("n_missing", F.col("total") - F.col("found"))
    return out.where("n_missing + n_extra + n_repeated + n_other > 0").select(*model, "n_missing", "n_extra", "n_repeated", "n_other")


def load_models(predictions: DataFrame, bags: DataFrame, dataset_id: str, model: Sequence[str] = ("run_id", "pooling", "seed", "class")) -> DataFrame:
    """predictions of models that all cover the same bags of one dataset; anything else is an error."""
    require_none(model_faults(predictions, bags, dataset_id, model), "models that don't fit the dataset")
    return predictions


def unscored(bags: DataFrame, scores: DataFrame, model: Sequence[str]) -> DataFrame:
    """(model, bag_id, n) that have no test score, or more than one: an out-of-fold table has one of each.

    Bags are distinct. Only models that miss some meet the table of bags, bag by bag.
    """
    known = bags.select("bag_id").distinct()
    n = scores.where("split = 'test'").groupBy(*model, "bag_id").agg(F.count("*").alias("n"))
    n = n.join(known.withColumn("_known", F.lit(True)), "bag_id", "left")
    found = n.groupBy(*model).agg(F.count("_known").alias("_found"))
    total = known.agg(F.count("*").alias("_total"))
    models = scores.select(*model).distinct().join(found, list(model), "left").crossJoin(F.broadcast(total))
    short = models.where(F.coalesce("_found", F.lit(0)) < F.col("_total")).select(*model)
    # a row for each bag and each of the few models that aren't whole, most of which are in the result if any model is
    missing = short.crossJoin(known).join(n.select(*model, "bag_id"), [*model, "bag_id"], "left_anti").withColumn("n", F.lit(0).cast("long"))
    return n.where("n > 1 and _known").select(*model, "bag_id", "n").unionByName(missing.select(*model, "bag_id", "n"))


def select_matching(names: Column, patterns: Sequence[str]) -> Column:
    """The names that match one of the patterns from their start, in the order they have."""
    return F.filter(names, lambda c: F.exists(F.array(*map(F.lit, patterns)), lambda p: F.regexp_like(c, F.concat(F.lit("^(?:"), p, F.lit(")")))))


def subset(instances: DataFrame, kept: DataFrame, folds: DataFrame) -> DataFrame:
    """Instances of the kept bags, with the folds that their bags have: (bag_id, fold) is inherited, not dealt anew."""
    return instances.join(kept.select("bag_id").distinct(), "bag_id", "left_semi").join(folds.select("bag_id", "fold"), "bag_id")
