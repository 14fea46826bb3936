"""A session with the settings that the operators assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("millrace")
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Unset, a temporary one is made in local mode only."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


#: Rows of a side that may go to all tasks; it is counted before it does.
FEW = 200_000


def if_few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, which is cut and narrow, with a broadcast hint if it has no more than FEW rows: Spark knows no size of a checkpoint."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= FEW else df


def tasks(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """Partitions of a shuffle of that many rows: as many as the session has, fewer of a small table, more of a large one."""
    return max(2, -(-rows // each), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 10_000)))


def stored(df: DataFrame) -> DataFrame:
    """df computed once into a table in the shared folder; for large inputs that several passes read, each the columns it needs."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage in the shared folder; for inputs that a plan reads several times."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
