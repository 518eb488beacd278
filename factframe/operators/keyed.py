"""Tables in a folder whose rows are replaced by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factframe.operators.storage import written


class KeyedTable:
    """Parquet files under `folder`, dealt by buckets of the key; a write replaces only the buckets that it touches.

    Of rows with one key the one of highest `version` stays; of equal versions
    the one written last, so a write that is run again leaves the table as it is.
    A row that records a failure is a row like others: it stays until a newer
    version of its key is written. A write whose rows repeat a key raises an
    error before anything is changed, and so does a null in the key.

    A write reads the touched buckets, merges, and stages the result; only then
    are partitions exchanged, by Spark's committer for dynamic overwriting. A
    write that dies before that leaves the table as it was, and one that is run
    again finishes the work. Writers must not run at the same time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str], version: str = "version", buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.version, self.buckets = spark, folder.rstrip("/"), schema, [*keys], version, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(self.folder)
        except AnalysisException as error:  # nothing has been written yet
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def read(self) -> DataFrame:
        """All rows; those of a key are found in one bucket by `lookup`."""
        stored = self._stored()
        return self.spark.createDataFrame([], self.schema) if stored is None else stored.select(*self.schema.names)

    def lookup(self, *key) -> DataFrame:
        """The row of a key; only its bucket is read."""
        stored = self._stored()
        if stored is None:
            return self.read()
        literal = [F.lit(k).cast(self.schema[c].dataType) for c, k in zip(self.keys, key, strict=True)]
        same = F.lit(True)
        for c, value in zip(self.keys, literal, strict=True):
            same = same & (F.col(c) == value)
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(*literal), F.lit(self.buckets)).cast("int")).first()[0]
        return stored.where(F.col("_bucket") == bucket).where(same).select(*self.schema.names)

    def replace(self, rows: DataFrame) -> int:
        """Merge the rows into the table; how many buckets were written."""
        fresh = written(self._bucketed(rows.select(*self.schema.names)), "incoming")
        nulls = " or ".join(f"`{k}` is null" for k in self.keys)
        if fresh.where(nulls).limit(1).count():
            raise ValueError("a key is null")
        repeated = fresh.groupBy(*self.keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if repeated:
            raise ValueError(f"the write repeats the key {tuple(repeated[0][k] for k in self.keys)}")
        # at most `buckets` numbers
        touched = sorted(r["_bucket"] for r in fresh.select("_bucket").distinct().collect())
        if not touched:
            return 0
        stored = self._stored()
        both = fresh.withColumn("_new", F.lit(1))
        if stored is not None:
            both = both.unionByName(stored.where(F.col("_bucket").isin(touched)).withColumn("_new", F.lit(0)))
        others = [c for c in self.schema.names if c not in self.keys]
        newest = F.max_by(F.struct(*others), F.struct(self.version, "_new")).alias("_row")
        merged = both.groupBy(*self.keys, "_bucket").agg(newest).select(*self.keys, "_row.*", "_bucket").select(*self.schema.names, "_bucket")
        staged = written(merged, "staged")
        staged.repartition("_bucket").write.partitionBy("_bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.folder)
        return len(touched)
