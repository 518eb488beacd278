"""Row numbers and running values of a key without gathering the key's rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factframe.operators.storage import bounded


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], width: int = 10_000, name: str = "number") -> DataFrame:
    """The rows with their number, from 1, among those of their keys by `order`.

    The first column of the order is a whole number and cuts a key into shards
    of `width` of its values; rows are numbered inside a shard, and the counts of
    the shards before, one row a shard, are added.
    """
    sharded = rows.withColumn("_shard", F.floor(F.col(order[0]) / width))
    sizes = sharded.groupBy(*keys, "_shard").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_shard")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_shard").orderBy(*order))
    same: Column = F.lit(True)
    renamed = before
    for c in [*keys, "_shard"]:
        renamed = renamed.withColumnRenamed(c, f"_of{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"_of{c}"))
    joined = sharded.withColumn("_inside", inside).join(bounded(renamed), same)
    return joined.withColumn(name, F.col("_inside") + F.col("_before")).select(*rows.columns, name)
