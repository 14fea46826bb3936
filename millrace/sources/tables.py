"""Readers and writers of tables and listings, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def annotations(spark: SparkSession, path: str, labels: list[str], optional=("Temp", "RH%")) -> DataFrame:
    """CSV of hourly labels: hour, idx_0.. (integers that may be written 1.0), and the optional columns as text.

    ``line`` keeps the order of the file, for tables in which the last row of an hour counts.
    """
    raw = spark.read.option("header", True).csv(path).withColumn("line", F.monotonically_increasing_id())
    index = lambda c: F.col(f"`{c}`").cast("double").cast("int")
    there = [F.col(f"`{c}`").alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in optional]
    return raw.select(F.to_timestamp_ntz("DateTime").alias("hour"), *(index(c).alias(f"idx_{i}") for i, c in enumerate(labels)), *there, "line")


def parse_listing(line: Column) -> Column:
    """hash<TAB>size<TAB>path -> struct; an empty hash is null; a path may hold tabs."""
    part = F.split(line, "\t", 3)
    return F.struct(F.nullif(part[0], F.lit("")).alias("hash"), F.try_element_at(part, F.lit(2)).cast("long").alias("size"), F.try_element_at(part, F.lit(3)).alias("path"))


def parse_hashsum(line: Column) -> Column:
    """hash, two blanks, name -> struct; split once."""
    at = F.instr(line, "  ")
    return F.when(at > 0, F.struct(F.substring(line, F.lit(1), at - 1).alias("hash"), F.substring(line, at + 2, F.length(line)).alias("name")))


def listing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value <> ''").select(parse_listing(F.col("value")).alias("l")).select("l.*")


def hash_cache(spark: SparkSession, path: str, owner: str) -> DataFrame:
    """name, size, mtime_ns, hash of a cache whose first line is '# <owner>'; another owner is an error."""
    head = spark.read.text(path).where(F.col("value").startswith("# ")).first()
    if head is None or head["value"] != f"# {owner}":
        raise ValueError(f"the cache at {path} isn't that of {owner}")
    return spark.read.option("sep", "\t").option("comment", "#").schema("name string, size long, mtime_ns long, hash string").csv(path)


def write(df: DataFrame, path: str, *partition_by: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet, or CSV with a header; Spark's commit makes the result visible as a whole."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def made_folder(spark: SparkSession, path: str) -> str:
    """path, a folder that is there now."""
    files, at = _at(spark, path)
    files.mkdirs(at)
    return path


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    files, at = _at(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def claimed(spark: SparkSession, path: str, owner: str) -> None:
    """Write who owns the folder that holds path; a folder of another owner is an error."""
    if not committed(spark, path):
        spark.createDataFrame([(owner,)], "owner string").coalesce(1).write.mode("overwrite").parquet(path)
    known = spark.read.schema("owner string").parquet(path).first()["owner"]
    if known != owner:
        raise ValueError(f"{path} is of {known}, not of {owner}")
