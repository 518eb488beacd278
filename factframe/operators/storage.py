"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Widest table that a join broadcasts; beyond it the same join shuffles.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own, but only where one process on one machine does all work."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "factframe-checkpoints")
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read that back."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like written(), but in buckets of a key, which groups and joins by that key read without a shuffle.

    A frame that is partitioned by the key into as many parts gives one file a bucket.
    """
    path = fresh_folder(df.sparkSession, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(buckets, key).sortBy(key).options(path=path, compression="zstd").saveAsTable(table)
    return df.sparkSession.table(table)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the table, counted, is within the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
