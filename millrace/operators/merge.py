"""Verify, then merge: staged files join a library by steps that may stop anywhere and be gone on with."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalar import is_wav
from millrace.sources.tables import committed, made_folder

from .guards import require_none
from .ingest import name_of

#: Steps of a merge, in order: old copies go aside, then staged files go to the library.
ASIDE, PUBLISH = 0, 1


@dataclass(frozen=True)
class Roots:
    """Folders, seen by the driver and all tasks, of one file system that renames files."""

    staging: str
    library: str
    aside: str


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """name, size, changed_at of the files right in a folder; contents aren't read."""
    files = spark.read.format("binaryFile").load(made_folder(spark, folder))
    return files.select(name_of(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("changed_at"))


def aside_name(name: Column, stamp: str) -> Column:
    """a.wav -> a.replaced_<stamp>.wav"""
    return F.concat(F.regexp_replace(name, r"(?i)\.wav$", ""), F.lit(f".replaced_{stamp}.wav"))


def recheck(report: DataFrame, staged: DataFrame, library: DataFrame, aside: DataFrame, verified_at: Column, stamp: str, replace: bool = False) -> DataFrame:
    """name, reason: why a merge may not go on now, whatever was found when the files were verified.

    report (name, ok, fail), staged (name, changed_at), library (name), aside (name). A name has the
    first reason that holds: it failed; it is gone; a WAV that no report names; changed at or after
    verification (files that are no WAVs as well); it would replace another file; its old copy's
    place is taken. Names are distinct in each table; null names can't be merged and are left out.
    """
    r = report.select("name", F.coalesce("ok", F.lit(False)).alias("ok"), "fail", F.lit(True).alias("in_report")).where("name is not null")
    s = staged.select("name", "changed_at", F.lit(True).alias("in_staging")).where("name is not null")
    here = library.select("name", F.lit(True).alias("in_library")).distinct()
    taken = aside.select(F.col("name").alias("old"), F.lit(True).alias("in_aside")).distinct()
    all_of = r.join(s, "name", "full").join(here, "name", "left").withColumn("old", aside_name(F.col("name"), stamp)).join(taken, "old", "left")
    there, clash = F.col("in_staging").isNotNull(), F.col("in_report").isNotNull() & F.col("in_library").isNotNull()
    reason = (
        F.when(F.col("in_report") & ~F.col("ok"), F.concat(F.lit("failed: "), F.coalesce("fail", F.lit(""))))
        .when(F.col("in_report").isNotNull() & ~there, "gone since verification")
        .when(F.col("in_report").isNull() & is_wav(F.col("name")), "not verified")
        .when(there & (F.col("changed_at").isNull() | (F.col("changed_at") >= verified_at)), "changed since verification")
        .when(clash & F.lit(not replace), "would replace another file")
        .when(clash & F.col("in_aside").isNotNull(), "place of the old copy is taken")
    )
    return all_of.select("name", reason.alias("reason")).where("reason is not null")


def moves(report: DataFrame, staged: DataFrame, library: DataFrame, roots: Roots, stamp: str) -> DataFrame:
    """step, name, source, target, size of every move: the reported files, and before them the library's files of their names.

    report (name), staged and library (name, size).
    """
    path = lambda root, name: F.concat(F.lit(f"{root.rstrip('/')}/"), name)
    names, name = report.select("name").where("name is not null").distinct(), F.col("name")
    old = library.join(names, "name", "left_semi").select(F.lit(ASIDE).alias("step"), "name", path(roots.library, name).alias("source"), path(roots.aside, aside_name(name, stamp)).alias("target"), "size")
    new = staged.join(names, "name", "left_semi").select(F.lit(PUBLISH).alias("step"), "name", path(roots.staging, name).alias("source"), path(roots.library, name).alias("target"), "size")
    return old.unionByName(new)


def _move(source: str, target: str, size: int) -> str:
    from pyarrow.fs import FileSystem, FileType

    files, a = FileSystem.from_uri(source)
    b = FileSystem.from_uri(target)[1]
    before, after = files.get_file_info([a, b])
    gone = before.type == FileType.NotFound
    if after.type != FileType.NotFound:
        # a step that was stopped, or a task that runs twice, finds its own work
        return "was moved" if gone and after.size == size else "refused: the target is there"
    if gone or before.size != size:
        return "refused: the source is gone" if gone else "refused: the source has another size"
    try:
        files.move(a, b)
    except FileNotFoundError:
        after = files.get_file_info(b)
        return "was moved" if after.type != FileType.NotFound and after.size == size else "refused: the source is gone"
    return "moved"


def carry_out(plan: DataFrame) -> DataFrame:
    """plan with ``outcome`` of each move: moved, was moved (by an earlier try), or refused and why. Nothing is overwritten.

    Runs in the tasks, file by file, so very many files are moved by all executors.
    """

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(outcome=[_move(s, t, n) for s, t, n in zip(p["source"], p["target"], p["size"], strict=True)])

    return plan.mapInPandas(batch, "step int, name string, source string, target string, size long, outcome string")


def merge(spark: SparkSession, report: DataFrame, verified_at: Column, roots: Roots, journal: str, stamp: str, replace: bool = False) -> DataFrame:
    """Merge the files of a report and return their moves with outcomes; called again after a stop, go on with it.

    Refusals are looked for on the folders as they are now, and any is an error before a file has
    moved. The plan is then written to ``journal``, a folder of this merge alone; from there on it holds, and every
    step is repeatable. Old copies are all aside before a staged file takes their place.
    """
    if not committed(spark, f"{journal}/plan"):
        if report.isEmpty():
            raise ValueError("nothing was verified")
        staged, library, aside = (listing(spark, f) for f in (roots.staging, roots.library, roots.aside))
        require_none(recheck(report, staged, library, aside, verified_at, stamp, replace), "the merge is refused")
        moves(report, staged, library, roots, stamp).write.mode("overwrite").parquet(f"{journal}/plan")
    plan = spark.read.parquet(f"{journal}/plan")
    for step in (ASIDE, PUBLISH):
        # a step with refusals isn't done: it is tried again by the next call
        if not committed(spark, f"{journal}/done-{step}"):
            carry_out(plan.where(F.col("step") == step)).write.mode("overwrite").parquet(f"{journal}/tried-{step}")
            tried = spark.read.parquet(f"{journal}/tried-{step}")
            require_none(tried.where("outcome like 'refused%'").select("name", "outcome"), f"step {step} of the merge stopped")
            tried.write.mode("overwrite").parquet(f"{journal}/done-{step}")
    return spark.read.parquet(*(f"{journal}/done-{s}" for s in (ASIDE, PUBLISH)))


def log_entries(moved: DataFrame, described: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, name, line of a merge log: a line for each group of moves, and one (with the name) for each copy set aside.

    moved (keys, step, name, target); described (keys, at, text, source, library, left, after). A group
    of any size has lines of bounded length. Groups without a move have no line.
    """
    n = moved.groupBy(*keys).agg(F.count_if(F.col("step") == PUBLISH).alias("n"), F.count_if(F.col("step") == ASIDE).alias("k"))
    both = n.join(described, list(keys)) if keys else n.where("n + k > 0").crossJoin(described)
    clash = F.when(F.col("k") == 0, "no name collisions").otherwise(F.concat(F.col("k").cast("string"), F.when(F.col("k") == 1, " name collision replaced").otherwise(" name collisions replaced")))
    line = F.format_string("%s moved %d wavs (%s) from %s to %s (%s; all verified); left behind %d; %s now %d files", "at", "n", "text", "source", "library", clash, "left", name_of(F.col("library")), "after")
    old = moved.where(F.col("step") == ASIDE).select(*keys, "name", F.concat("name", F.lit(" REPLACED: old copy moved to "), "target").alias("line"))
    return both.select(*keys, F.lit(None).cast("string").alias("name"), line.alias("line")).unionByName(old)


def cache_after(cache: DataFrame, published: DataFrame, report: DataFrame) -> DataFrame:
    """The hash cache (name, size, mtime_ns, hash) after a merge: files that were published (name, size, mtime_ns) bring their verified hash.

    Moves keep size and time, so nothing is hashed again.
    """
    fresh = published.join(report.select("name", "hash"), "name").select("name", "size", "mtime_ns", "hash")
    return cache.join(fresh.select("name"), "name", "left_anti").select("name", "size", "mtime_ns", "hash").unionByName(fresh)
