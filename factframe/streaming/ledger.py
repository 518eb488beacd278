"""Streaming extension: ledgers kept up to date by Structured Streaming.

Events are deduplicated within a watermark, counted in event-time windows, and
the latest row of each key is maintained in a table by foreachBatch, which is
idempotent: a replayed batch merges to the same table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Deduplicated counts and sums by window and type; windows close when the watermark passes them."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")


def merge_latest(current: DataFrame | None, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest row of each key over the table so far and a batch; the same whatever the batches."""
    rows = batch if current is None else current.unionByName(batch.select(*current.columns))
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("ts", "event_id")).alias("_b")).select(*keys, "_b.*")


def keep_latest(events: DataFrame, keys: Sequence[str], folder: str, checkpoint: str):
    """Maintain the latest row of each key under `folder`/version=N; readers take the highest version."""
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        # the newest version before this batch's; a batch that is run again writes over its own
        try:
            # names of folders say it; no rows are read
            versions = {int(v) for name in spark.read.parquet(folder).inputFiles() for v in re.findall(r"/version=(-?\d+)/", name)}
            newest = max((v for v in versions if v < number), default=None)
        except AnalysisException as error:  # nothing has been written yet
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            newest = None
        current = None if newest is None else spark.read.parquet(f"{folder}/version={newest}")
        merge_latest(current, batch, keys).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
