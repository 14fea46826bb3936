"""Helpers shared by the training-data operators."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders that stored() made in this thread, for drop_stored().
_made = threading.local()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again; for rows that carry texts."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.paths = [*getattr(_made, "paths", []), path]
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_so_far() -> int:
    """How many folders stored() has made in this thread."""
    return len(getattr(_made, "paths", []))


def drop_stored(spark: SparkSession, since: int, until: int) -> None:
    """Delete the folders made between two values of stored_so_far(); nothing may still read them."""
    for path in getattr(_made, "paths", [])[since:until]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: A side is broadcast only if it was measured and has no more rows and bytes than these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20


def _width(c: Column, of: T.DataType) -> Column:
    """Bytes that a value takes, about."""
    if isinstance(of, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(of, T.ArrayType):
        fixed = not isinstance(of.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType))
        parts = 8 * F.size(c) if fixed else F.aggregate(c, F.lit(0), lambda s, x: (s + _width(x, of.elementType)).cast("int"))
        return F.greatest(F.coalesce(parts, F.lit(0)), F.lit(0)) + 8
    if isinstance(of, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in of), F.lit(8))
    return F.lit(8)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, with a broadcast hint if its rows and bytes, measured (cheap: df is cut or tiny), allow it."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0)).cast("long")
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def with_repeats(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows (cut, or read from stored files) with ``name``: 0, 1, ... over the rows of one value of ``by``.

    ``by`` is a long that isn't null. Values of one row, nearly all, are told apart by a count summed
    in the tasks first and get 0. The rows of a repeated value are numbered within each partition of
    ``rows`` and offset by the partitions before it, so that a value that very many rows share is
    never in one task.
    """
    several = cut(rows.groupBy(by).agg(F.count("*").alias("_n")).where("_n > 1").select(by))
    if several.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    parts = rows.withColumn("_part", F.spark_partition_id())
    known = broadcast_if_small(several)
    again = cut(parts.join(known, by, "left_semi"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = again.groupBy(by, "_part").agg(F.count("*").alias("_n")).select(by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(by, "_part").orderBy(F.lit(0))
    numbered = again.withColumn("_i", F.row_number().over(within) - 1).join(broadcast_if_small(cut(offsets)), [by, "_part"])
    numbered = numbered.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_i") + F.col("_before")).cast("long").alias(name))
    return rows.join(known, by, "left_anti").select(*(F.col(f"`{c}`") for c in rows.columns), F.lit(0).cast("long").alias(name)).union(numbered)


def word_count(text: str) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def raw(text: str | bytes | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""


def utf8(texts: pa.Array) -> Iterator[bytes]:
    """The bytes of an Arrow column's texts, one at a time; null gives none. No text is held twice."""
    return (v.as_py() or b"" for v in texts.cast(pa.binary()))
