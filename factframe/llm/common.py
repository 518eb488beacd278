"""Small Spark helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Widest table that an operator broadcasts; beyond it the same join shuffles.
BROADCAST_ROWS = 200_000
#: Most rows that reach Python at a time.
ARROW_ROWS = 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, one of our own, but only where driver and executors are one process on one machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "factframe-checkpoints")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read that back."""
    return Scratch(df.sparkSession).written(df, name)


def small_batches(spark: SparkSession) -> None:
    """Let the session hand whole texts to Python in small batches, which are held on both sides at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


class Scratch:
    """Tables of the shared folder that an operator needs until its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        small_batches(spark)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete them all; nothing that is still to run may read them."""
        for path in self.paths:
            system, place = fs.FileSystem.from_uri(path)
            system.delete_dir(place)
        self.paths = []


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the table, counted, is within the bound; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fold(id_column: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids count as fold 1."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5, F.lit(1))


def unit_hash(*columns: Column | str) -> Column:
    """A deterministic uniform number in (0, 1) for each row."""
    h = F.xxhash64(*columns)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label of every labelled id whose fold is not 0: one row for each id, the largest label where they differ."""
    rows = labels.select("doc_id", F.col(label).alias("label")).where((fold("doc_id") != 0) & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def label_sample(rows: DataFrame, per_class: int) -> DataFrame:
    """About `per_class` of the training labels of each class, chosen by a hash of the id.

    The bound holds at every size: a class with n rows keeps each with
    probability min(1, per_class / n).
    """
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    keep = F.lit(False)
    for value, n in sizes.items():
        keep = keep | ((F.col("label") == value) & (unit_hash(F.lit("sample"), F.col("doc_id")) < min(1.0, per_class / n)))
    return rows.where(keep)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def carried(df: DataFrame, *without: str) -> Column:
    """The columns of the table as one struct `_row`, whatever their names, to be handed through Python tasks as it is."""
    held = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return F.struct(*held, F.lit(1).alias(free_name(df, "_"))).alias("_row")


def with_row(rows: DataFrame, rest: str) -> StructType:
    """A schema of the struct `_row` and the columns that `rest` declares."""
    return StructType([StructField("_row", rows.schema["_row"].dataType), *StructType.fromDDL(rest).fields])
