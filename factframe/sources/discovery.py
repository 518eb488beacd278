"""Discovery of what a folder holds, where some files may be unreadable."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def readable_rows(spark: SparkSession, folder: str, schema: T.StructType, version: tuple[str, int] | None = None) -> DataFrame:
    """Rows of all files that can be read, with `file`; with `version` (column, least value), only those that are not stale."""
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(folder)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    return rows if version is None else rows.where(F.col(version[0]) >= version[1])


def skipped_files(spark: SparkSession, folder: str, schema: T.StructType, version: tuple[str, int] | None = None) -> DataFrame:
    """(file, reason) of every file that gives no row: unreadable, empty or stale.

    The names of the files are listed, as Spark itself does to plan a scan; those
    that gave a row are taken off by an anti-join, and only what is left is looked at again, in tasks: a footer that can't be read
    makes a file unreadable.
    """
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).inputFiles()
    listed = spark.createDataFrame([(n,) for n in names], "_path string")
    gave = readable_rows(spark, folder, schema, version).select(_plain(F.col("file")).alias("_plain")).distinct()
    left = listed.withColumn("_plain", _plain(F.col("_path"))).join(gave, "_plain", "left_anti").select(F.col("_path").alias("file"))

    def look(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            reasons = []
            for uri in batch.column(0).to_pylist():
                try:
                    system, place = fs.FileSystem.from_uri(uri)
                    with system.open_input_file(place) as f:
                        found = pq.ParquetFile(f)
                        for group in range(found.num_row_groups):  # pages too: a broken one is found by reading it
                            found.read_row_group(group)
                    reasons.append("stale" if found.metadata.num_rows else "empty")
                except (pa.ArrowException, OSError):
                    reasons.append("unreadable")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reasons, pa.string())], names=["file", "reason"])

    return left.mapInArrow(look, "file string, reason string")


def _plain(path):
    """Paths as either reader spells them."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "^file:/+", "/")
