"""Fingerprints, staleness and the order of stages, over small tables of metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Hexadecimal digits of a row's digest by which rows are put together.
BRANCH = 3


def fingerprint(files: DataFrame, columns: Sequence[str], digits: int = 16) -> DataFrame:
    """One row, fingerprint: sha256 over the digests of branches, each over its sorted digests of rows.

    A branch holds the rows whose digests begin alike, of which there are 4096, so no task holds all rows.
    """
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\n"), 256)
    branches = files.select(digest.alias("d")).groupBy(F.substring("d", 1, BRANCH).alias("branch")).agg(joined("d").alias("d"))
    return branches.agg(joined("d").alias("d")).select(F.substring("d", 1, digits).alias("fingerprint"))


def stale_stages(stages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, position, stage, exists, built, current: map, stamp: map) -> keys, position, stage, stale, reason.

    Stages of one of ``keys``, such as a dataset, are a chain of their own.

    In order: not there, never built here, keys of the fingerprint that changed, a stage before it
    is stale. A stage after a stale one is stale too.
    """
    names = F.array_sort(F.map_keys("current"))
    changed = F.filter(names, lambda k: ~F.col("current")[k].eqNullSafe(F.col("stamp")[k]))
    own = (
        F.when(~F.col("exists"), "no result")
        .when(~F.col("built"), "never built")
        .when(F.size(changed) > 0, F.array_join(F.transform(changed, lambda k: F.concat(k, F.lit(" changed"))), ", "))
    )
    rows = stages.withColumn("own", own)
    before = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    upstream = F.coalesce(F.max(F.col("own").isNotNull().cast("int")).over(before), F.lit(0)) == 1
    reason = F.coalesce("own", F.when(upstream, "a stage before it is stale"), F.lit("up to date"))
    return rows.select(*keys, "position", "stage", (F.col("own").isNotNull() | upstream).alias("stale"), reason.alias("reason"))
