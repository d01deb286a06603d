"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table is sent whole to every task.
SMALL = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new local folder if Spark runs in this process alone; on a cluster that is
    an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            found = spark.sparkContext.getCheckpointDir()
        path = found
    return path.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once as a table in the shared folder and read again: what is built on it several times is worked out once,
    and a lost executor takes nothing with it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = SMALL) -> tuple[DataFrame, bool]:
    """A stored table, marked to be sent to every task if it is of at most so many bytes, and whether it is."""
    sizes = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) if t == "string" else F.octet_length(F.to_json(F.col(c))) if t.startswith(("array", "struct", "map")) else F.lit(8) for c, t in df.dtypes]
    small = (df.agg(F.sum(sum(sizes, F.lit(16)))).first()[0] or 0) <= most
    return (F.broadcast(df) if small else df), small


def small_or_shuffled(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A stored table, sent to every task if it is of at most so many bytes; else Spark chooses the join."""
    return sized(df, most)[0]


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is read in fewer parts: a small table is one file."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
