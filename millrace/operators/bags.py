"""Bags of instances: hours, regimes, blocks, folds, windows and identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import block, rate_label, windows


def most_common(rows: DataFrame, keys: Sequence[str], value: str, at: str) -> DataFrame:
    """keys, value: the most frequent one; of equally frequent ones that which came first at ``at``."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), "first", value)
    return counts.withColumn("i", F.row_number().over(best)).where("i = 1").select(*keys, value)


def hours(clips: DataFrame, start: str = "start") -> DataFrame:
    """(start, sample_rate, duration_s, qc_ok, clip_frac) -> a row an hour; qc_ok only if all its clips are."""
    return clips.groupBy(F.date_trunc("hour", start).cast("timestamp_ntz").alias("hour")).agg(
        F.count("*").alias("n_clips"),
        F.when(F.count_distinct("sample_rate") == 1, F.min("sample_rate")).otherwise(0).alias("sample_rate"),
        F.round(F.sum("duration_s"), 3).alias("bag_duration_s"), F.max("clip_frac").alias("clip_frac_max"),
        F.bool_and("qc_ok").alias("qc_ok"),
    )


def labelled(hours: DataFrame, annotations: DataFrame) -> DataFrame:
    """Good hours that have labels; of several rows an hour the last (largest line) counts."""
    last = Window.partitionBy("hour").orderBy(F.desc("line"))
    labels = annotations.withColumn("i", F.row_number().over(last)).where("i = 1").drop("i", "line")
    return hours.where("qc_ok").join(labels, "hour")


def regimes(hours: DataFrame) -> DataFrame:
    """hours with regime: sample rate and the usual number of clips of its rate and year; mixed rates apart."""
    rows = hours.withColumn("year", F.year("hour"))
    usual = most_common(rows, ["sample_rate", "year"], "n_clips", "hour").withColumnRenamed("n_clips", "nominal")
    name = F.when(F.col("sample_rate") == 0, "mixed").otherwise(F.concat(rate_label(F.col("sample_rate")), F.lit("-"), F.col("nominal"), F.lit("clip")))
    return rows.join(usual, ["sample_rate", "year"]).withColumn("regime", name).drop("nominal")


def with_blocks(rows: DataFrame, day: Column, days: int = 3) -> DataFrame:
    """rows with block, counted from the first day of the table (one aggregate, joined as one row)."""
    first = rows.agg(F.min(day).alias("_first"))
    return rows.crossJoin(F.broadcast(first)).withColumn("block", block(day, F.col("_first"), days)).drop("_first")


def block_stats(bags: DataFrame, present: Sequence[str], at: str) -> DataFrame:
    """block, bags, the positives of each class, and the block's most common regime."""
    sums = bags.groupBy("block").agg(F.count("*").alias("bags"), *(F.sum(p).alias(p) for p in present))
    return sums.join(most_common(bags, ["block"], "regime", at), "block")


def fold_roles(bags: DataFrame, folds: int) -> DataFrame:
    """Each bag once for each held-out fold f: test in its own, val in the one before, train else."""
    role = F.when(F.col("fold") == F.col("f"), "test").when(F.col("fold") == F.pmod(F.col("f") + 1, F.lit(folds)), "val").otherwise("train")
    return bags.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("role", role)


def expand_windows(clips: DataFrame, width_s: float = 5.0, drop_partial: bool = False) -> DataFrame:
    """Each clip's windows: clip columns, win_idx, start_s, end_s."""
    return clips.select("*", F.inline(windows(F.col("duration_s"), width_s, drop_partial)))


def instance_ids(bag_id: Column, clip_start: Column, start_s: Column) -> Column:
    """{bag}_{HHMMSS}_{window start as 0000.00}"""
    return F.concat_ws("_", bag_id, F.date_format(clip_start, "HHmmss"), F.format_string("%07.2f", start_s))


def dataset_hash(rows: DataFrame, key: str, order: str, digits: int = 12) -> DataFrame:
    """hash: sha256 over the sorted digests of pieces; each piece hashes its own rows in order.

    Pieces keep any task from holding all ids; a piece is a range of 1024 values of ``order``.
    """
    pieces = rows.groupBy(F.floor(F.col(order) / 1024).alias("piece")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("order"), F.col(key).alias("key")))).alias("ids"))
    piece = F.sha2(F.array_join(F.transform("ids", lambda s: s["key"].cast("string")), "\n"), 256)
    whole = pieces.select("piece", piece.alias("digest")).agg(F.sort_array(F.collect_list(F.struct("piece", "digest"))).alias("d"))
    return whole.select(F.substring(F.sha2(F.array_join(F.transform("d", lambda s: s["digest"]), "\n"), 256), 1, digits).alias("hash"))


def standardise_stats(vectors: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """keys, dim, mean, sd of each component: sample deviation plus 1e-6."""
    parts = vectors.select(*keys, F.posexplode(vector).alias("dim", "v"))
    v = F.col("v").cast("double")
    return parts.groupBy(*keys, "dim").agg(F.avg(v).alias("mean"), (F.stddev_samp(v) + 1e-6).alias("sd"))


def positive_weights(bags: DataFrame, keys: Sequence[str], index: str, levels: int) -> DataFrame:
    """keys, level, n_pos, pos_weight: negatives over positives (at least 1) of index >= level."""
    rows = bags.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    pos = F.count_if(F.col(index) >= F.col("level"))
    return rows.groupBy(*keys, "level").agg(pos.alias("n_pos"), ((F.count("*") - pos) / F.greatest(pos, F.lit(1))).alias("pos_weight"))
