"""Incremental work: keyed results that grow as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def append_new(spark: SparkSession, source: str, schema: str, result: str, checkpoint: str, make: Callable[[DataFrame], DataFrame]) -> None:
    """Run ``make`` over the Parquet files that came to ``source`` since the last call and append the rows.

    File source with availableNow: every file is taken once, an interrupted call is taken up from
    its checkpoint, and the sink's log makes the appended rows visible exactly once.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    query = make(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(result)
    query.awaitTermination()


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to do: those whose key isn't among the done ones."""
    return wanted.join(done.where("done").select(key), key, "left_anti")
