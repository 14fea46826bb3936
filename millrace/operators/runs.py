"""Runs of models: grids of settings, their union with baselines, sizes, ranges, ranks, and tables kept by key."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import softplus

from .bootstrap import uniform


def grid(values: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Every combination of the values that the factors have in a table; a factor has few, nulls are none."""
    out = values.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in factors))
    for c in factors:
        out = out.withColumn(c, F.explode(c))
    return out


def sweep(settings: DataFrame, factors: Sequence[str]) -> DataFrame:
    """run, settings (json) and arguments of rows of settings, as of ``grid``; run is a digest of the arguments.

    True becomes a bare flag, False and null nothing, any other value an option with its text.
    """
    words, of = [], dict(settings.dtypes)
    for c in factors:
        name = f"--{c.replace('_', '-')}"
        words.append(F.when(F.col(c), name) if of[c] == "boolean" else F.when(F.col(c).isNotNull(), F.concat_ws(" ", F.lit(name), F.col(c).cast("string"))))
    arguments = F.concat_ws(" ", *words)
    return settings.select(F.substring(F.sha2(arguments, 256), 1, 12).alias("run"), F.to_json(F.struct(*factors)).alias("settings"), arguments.alias("arguments"))


def with_baselines(models: DataFrame, baselines: DataFrame) -> DataFrame:
    """Records of models and baselines in one table, kind told apart, models first; columns that one lacks are null."""
    both = models.withColumn("kind", F.lit("model")).unionByName(baselines.withColumn("kind", F.lit("baseline")), allowMissingColumns=True)
    return both.withColumn("rank_of_kind", (F.col("kind") == "baseline").cast("int"))


def parameter_count(dim: Column, classes: int, hidden: Column, levels: int, ordinal: Column, pooling: Column, attention: int) -> Column:
    """Parameters of a probe: one or two layers, the gate of attention, the gaps between ordinal levels."""
    last = F.when(hidden > 0, hidden).otherwise(dim)
    layers = F.when(hidden > 0, dim * hidden + hidden).otherwise(0) + last * classes + classes
    gate = F.when(pooling == "attention", 2 * (dim * attention + attention) + attention * classes + classes).otherwise(0)
    return layers + gate + F.when(ordinal > 0, classes * (levels - 1)).otherwise(0)


def seed_ranges(aps: DataFrame, keys: Sequence[str], value: str = "ap") -> DataFrame:
    """keys, n_seeds, lo, mean, hi over the seeds of each."""
    return aps.groupBy(*keys).agg(F.count_distinct("seed").alias("n_seeds"), F.min(value).alias("lo"), F.avg(value).alias("mean"), F.max(value).alias("hi"))


def ranked_by_recall(recalls: DataFrame, model: str) -> DataFrame:
    """(model, class, recall) -> model, recall (mean of the classes), place from 1; ties by name. Models are few."""
    means = recalls.groupBy(model).agg(F.avg("recall").alias("recall"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("recall", 9)), model)))


def threshold_means(thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seed, fold, threshold) -> keys, n, threshold: the mean over seeds and folds; nulls are left out."""
    return thresholds.groupBy(*keys).agg(F.count("threshold").alias("n"), F.avg("threshold").alias("threshold"))


def learned_thresholds(weights: DataFrame) -> DataFrame:
    """fit, run_id, pooling, seed, fold, class, level, threshold of the ordinal heads in ``weights_table``.

    The first threshold is 0 and has no row; level k is the sum of softplus of the gaps up to it.
    """
    width = F.col("shape")[1]
    rows = weights.where("name = 'gap'").select("fit", "run_id", "pooling", "seed", "fold", width.alias("width"), "values", F.posexplode(F.sequence(F.lit(0), F.col("shape")[0] - 1)).alias("class", "_c"))
    rise = F.transform(F.slice("values", F.col("class") * F.col("width") + 1, F.col("width")), softplus)
    upto = F.transform(rise, lambda _, i: F.aggregate(F.slice(rise, 1, i + 1), F.lit(0.0), lambda s, x: s + x))
    return rows.select("fit", "run_id", "pooling", "seed", "fold", "class", F.posexplode(upto).alias("_k", "threshold")).select("fit", "run_id", "pooling", "seed", "fold", "class", (F.col("_k") + 2).alias("level"), "threshold")


def shuffled_batches(rows: DataFrame, key: str, size: int, epoch: int, seed: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """rows with batch: another deal of the rows of each of ``keys`` in every epoch, of ``size`` rows about.

    A row's batch follows from a hash of seed, epoch and key and the number of rows, so nothing is
    sorted and a rerun gives the same batches.
    """
    # as many batches as whole sizes fit, one at least
    n = rows.groupBy(*keys).agg(F.greatest(F.floor(F.count("*") / size), F.lit(1)).alias("_batches"))
    at = F.floor(uniform(F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")) * F.col("_batches") / F.lit(4294967296.0)).cast("int")
    joined = rows.join(n, list(keys)) if keys else rows.crossJoin(F.broadcast(n))
    return joined.withColumn("batch", at).drop("_batches")


def weights_table(spark: SparkSession, fits: Sequence, params: Sequence[dict[str, np.ndarray]]) -> DataFrame:
    """fit, run_id, pooling, seed, fold, name, shape, values of every array of every fit; for ``load_weights``."""
    rows = [(i, f.run_id, f.pooling, f.seed, f.fold, k, list(v.shape), v.ravel().tolist()) for i, (f, p) in enumerate(zip(fits, params, strict=True)) for k, v in p.items()]
    return spark.createDataFrame(rows, "fit int, run_id string, pooling string, seed int, fold int, name string, shape array<int>, values array<double>")


def load_weights(table: DataFrame, run_id: str, pooling: str, seed: int, fold: int) -> dict[str, np.ndarray]:
    """The arrays of one fit; none is an error."""
    rows = table.where((F.col("run_id") == run_id) & (F.col("pooling") == pooling) & (F.col("seed") == seed) & (F.col("fold") == fold)).collect()
    if not rows:
        raise KeyError(f"no weights of {run_id}/{pooling}, seed {seed}, fold {fold}")
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in rows}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def kept(spark: SparkSession, folder: str, key: Mapping, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a key (settings, inputs' ids and fingerprints), made once and read from then on.

    A finished write has Spark's success mark; a write that was cut short is made again.
    """
    name = hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{folder}/key={name}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def archived(df: DataFrame, folder: str, dataset_id: str) -> str:
    """Keep a table of a dataset by its id; what is there is never overwritten, and the same id is an error."""
    path = f"{folder}/dataset_id={dataset_id}"
    df.write.mode("errorifexists").parquet(path)
    return path


def code_version(spark: SparkSession, folder: str, pattern: str = "*.py", digits: int = 12) -> str:
    """A hash of the names and contents of source files, to tell results of other code from these."""
    from .lineage import fingerprint

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace("path", "^.*/" + folder.rstrip("/").split("/")[-1] + "/", "")
    return fingerprint(files.select(name.alias("name"), F.sha2("content", 256).alias("hash")), ["name", "hash"], digits).first()["fingerprint"]
