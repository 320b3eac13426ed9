"""Shared storage for loops: what a round leaves is written where every executor can read it."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "checkpoints", f"tracewell-{uuid.uuid4().hex}")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to the shared folder and read back, so that loops don't grow a plan."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Levels:
    """Rows added level by level, each level written once; `all()` reads what is there so far."""

    def __init__(self, spark: SparkSession, schema, name: str) -> None:
        self.spark, self.schema, self.path, self.paths, self.n = spark, schema, new_path(spark, name), [], 0

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """(the level as stored, its number of rows)."""
        path, self.n = f"{self.path}/{self.n}", self.n + 1
        df.write.parquet(path)
        level = self.spark.read.schema(self.schema).parquet(path)
        n = level.count()  # from the files' footers
        if n:
            self.paths.append(path)
        return level, n

    def all(self) -> DataFrame:
        read = self.spark.read.schema(self.schema)
        return read.parquet(*self.paths) if self.paths else self.spark.createDataFrame([], self.schema)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if its known number of rows allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
