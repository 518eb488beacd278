"""As-of association without gathering a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factframe.operators.storage import bounded


def asof_before(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: Column, ties: Sequence[str] = (), width: int = 3_600, name: str = "value") -> DataFrame:
    """Each left row with `name`: the value of the last right row of its keys strictly before it, null if there is none.

    Right rows of one time are ordered by `ties`, the last one counts. Time is cut
    into ranges of `width` seconds; a range of a key is one group, so a key's rows
    are spread as its times are. Within a range the last value is carried along by
    a window; what a range ends with, one row each, is carried to the ranges after
    it. Two passes, whatever the key's share of the rows.
    """
    range_ = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (1_000_000 * width))
    struct = F.struct(F.lit(True).alias("is"), value.alias("v"))
    there = right.select(*keys, F.col(time).alias("_t"), F.struct(*[F.col(c) for c in ties]).alias("_o") if ties else F.lit(0).alias("_o"), struct.alias("_v")).withColumn("_range", F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / (1_000_000 * width)))
    last = there.groupBy(*keys, "_range").agg(F.max_by("_v", F.struct("_t", "_o")).alias("_end"))
    asked = left.withColumn("_range", range_)
    # ranges with right rows or with left ones: what the ranges before have left
    steps = last.unionByName(asked.select(*keys, "_range").distinct().withColumn("_end", F.lit(None).cast(last.schema["_end"].dataType)))
    steps = steps.groupBy(*keys, "_range").agg(F.first("_end", ignorenulls=True).alias("_end"))
    carried = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = steps.withColumn("_before", carried).select(*keys, "_range", "_before")
    # inside a range: right rows sort before left rows of a later time only
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    events = there.select(*keys, "_range", "_t", F.lit(1).alias("_side"), "_o", "_v", F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    empty = F.lit(None)
    asking = asked.select(*keys, "_range", F.col(time).alias("_t"), F.lit(0).alias("_side"), empty.cast(there.schema["_o"].dataType).alias("_o"), empty.cast(there.schema["_v"].dataType).alias("_v"), row.alias("_row"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_t", "_side", F.col("_o").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = events.unionByName(asking).withColumn("_here", F.last("_v", ignorenulls=True).over(inside)).where("_side = 0")
    found = filled.join(bounded(before), [*keys, "_range"], "left").withColumn("_found", F.coalesce("_here", "_before"))
    return found.select(*[F.col("_row").getField(c).alias(c) for c in left.columns], F.col("_found").getField("v").alias(name))
