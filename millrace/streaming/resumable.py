"""A cache of rows that cost much to compute, filled file by file and taken up where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.tables import claimed, made_folder

#: What a cache says of every row, beside what was computed.
KEY = "instance_id string, file_sig string, done boolean"


def cached(spark: SparkSession, cache: str, payload: str) -> DataFrame:
    """All rows that were ever committed: KEY, the payload, run and batch; none if the cache is new."""
    at = made_folder(spark, f"{cache}/rows")
    return spark.read.schema(f"{KEY}, {payload}, run string, batch long").parquet(at)


def standing(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that stand for wanted (instance_id, file_sig): one each at most, wanted's other columns are left out.

    A row stands if it is done and of the file that is wanted: its signature is the same, or null, as
    in caches from before there were signatures. Of several the one with a signature, then the
    latest commit. Null ids stand for nothing.
    """
    known = rows.where("done").join(wanted.select("instance_id", F.col("file_sig").alias("_sig")).distinct(), "instance_id")
    fit = known.where(F.col("file_sig").isNull() | F.col("file_sig").eqNullSafe(F.col("_sig"))).drop("_sig")
    best = Window.partitionBy("instance_id").orderBy(F.col("file_sig").isNull(), F.desc("batch"), "run")
    return fit.withColumn("_i", F.row_number().over(best)).where("_i = 1").drop("_i")


def to_compute(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    return wanted.join(standing(wanted, rows).select("instance_id"), "instance_id", "left_anti")


def status(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: wanted, standing and missing instances, and committed rows that no longer stand for any."""
    some = standing(wanted, rows).agg(F.count("*").alias("standing"))
    ids = wanted.agg(F.count_distinct("instance_id").alias("wanted"))
    held = rows.agg(F.count("*").alias("rows"))
    one = ids.crossJoin(F.broadcast(some)).crossJoin(F.broadcast(held))  # a row each
    return one.select("wanted", "standing", (F.col("wanted") - F.col("standing")).alias("missing"), (F.col("rows") - F.col("standing")).alias("outdated"))


def fill(
    spark: SparkSession, source: str, wanted: str, cache: str, state: str, payload: str, identity: str,
    compute: Callable[[DataFrame], DataFrame], files_per_batch: int = 64,
) -> None:
    """Take the Parquet files of ``source`` (schema ``wanted``: instance_id, file_sig and more) and cache what they lack.

    ``compute`` maps the rows to do to instance_id and the payload; rows it gives nothing for are
    committed as not done and stay missing until a later file names them again. A batch is a few
    files and its commit one folder, named by query and batch: a batch that is run again after a stop
    replaces its own folder and doesn't take it for work done, so nothing is computed
    twice but for the batch that was stopped, and no row appears twice. A clip may be spread over
    batches and is gone on with in its middle. A cache of another ``identity`` (model, settings) is an error.
    """
    claimed(spark, f"{cache}/identity", identity)

    def commit(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        run = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        before = cached(session, cache, payload).where(~((F.col("run") == run) & (F.col("batch") == number)))
        # a file may name an instance twice
        todo = to_compute(batch.dropDuplicates(["instance_id"]), before)
        made = compute(todo).withColumn("done", F.lit(True))
        rows = todo.select("instance_id", "file_sig").join(made, "instance_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
        rows.write.mode("overwrite").parquet(f"{cache}/rows/run={run}/batch={number}")

    stream = spark.readStream.schema(wanted).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(commit).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
