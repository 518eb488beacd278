"""Packing into optimal length buckets.

A dynamic program over the global histogram of exact lengths chooses the bucket
boundaries that minimise padding; batches of at most a token budget then form
inside each bucket. A layer of the program is a lower envelope of lines, so it
takes time in proportion to the number of different lengths. Only the histogram
reaches the driver, one row for each different length.

Rows are numbered inside a bucket without gathering it in one task: row numbers
within (bucket, shard), plus the counts of the shards before. Shards are drawn by
a hash of id and length, so the same rows are packed alike however they are
dealt. Rows that agree in both are interchangeable: they are counted first, a
group takes as many places as it has rows, and its rows are made again from the
count.

Defined results: a null or empty text has length 0; a text longer than the
budget is a batch of its own; null ids and repeated rows are packed like any
other row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factframe.llm.common import bounded, written
from factframe.llm.tokenids import token_counts

BUCKETS = 16
TOKEN_BUDGET = 16_384
SHARD_ROWS = 50_000
LEAST_SHARDS = 64


def word_count(text: str = "text") -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padded length.

    With i the last length of the bucket before, the least cost up to length j is
    the minimum over i < j of cost(i) + length_j (rows_j - rows_i): for each i a
    line in length_j, of falling slope. Whole numbers, so the result is exact.
    """
    order = np.argsort(lengths)
    x, rows = np.asarray(lengths)[order].tolist(), np.cumsum(np.asarray(counts)[order]).tolist()
    n = len(x)
    if n == 0:
        return []
    costs, came = [a * b for a, b in zip(x, rows, strict=True)], []
    for _ in range(1, min(buckets, n)):
        now, origin, hull, front = costs[:], [-1] * n, [], 0
        for j in range(1, n):
            i = j - 1  # a line more to choose from
            while len(hull) - front > 1:
                p, q = hull[-2], hull[-1]
                if (costs[i] - costs[p]) * (rows[q] - rows[p]) > (costs[q] - costs[p]) * (rows[i] - rows[p]):
                    break
                hull.pop()
            hull.append(i)
            while front + 1 < len(hull) and costs[hull[front + 1]] - x[j] * rows[hull[front + 1]] <= costs[hull[front]] - x[j] * rows[hull[front]]:
                front += 1
            total = costs[hull[front]] + x[j] * (rows[j] - rows[hull[front]])
            if total < now[j]:
                now[j], origin[j] = total, hull[front]
        costs = now
        came.append(origin)
    bounds, j = [], n - 1
    for origin in [*came[::-1], None]:
        if origin is None:
            bounds.append(int(x[j]))
        elif origin[j] >= 0:
            bounds.append(int(x[j]))
            j = origin[j]
    return bounds[::-1]


def pack(docs: DataFrame, tokenizer: str | None = None, length: Column | None = None, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row per document: doc_id, length, bucket, bucket_length, batch_id, slot, padding.

    Lengths are ids under the tokenizer of that path, or the given column, or words.
    """
    if tokenizer is None:
        sized = docs.select("doc_id", (word_count() if length is None else length).cast("long").alias("length"))
    else:
        sized = token_counts(docs, tokenizer)
    # rows that repeat id and length are one row with their number
    sized = written(sized.groupBy("doc_id", "length").agg(F.count("*").alias("_rows")).withColumn("_draw", F.xxhash64("doc_id", "length")), "lengths")
    histogram = sized.groupBy(F.col("length").alias("v")).agg(F.sum("_rows")).collect()
    values, counts = np.array([r[0] for r in histogram], dtype=np.int64), np.array([r[1] for r in histogram], dtype=np.int64)
    bounds = optimal_boundaries(values, counts, buckets) or [0]
    room = [max(1, token_budget // max(1, b)) for b in bounds]
    inside = np.bincount(np.searchsorted(bounds, values), weights=counts, minlength=len(bounds)).astype(int)
    first_batch = np.concatenate(([0], np.cumsum(-(-inside // np.array(room)))))[:-1]
    shards = max(LEAST_SHARDS, -(-int(counts.sum()) // SHARD_ROWS))

    # the bucket of a length: how many boundaries lie below it
    bucket = sum((F.lit(b) < F.col("length")).cast("int") for b in bounds)
    placed = sized.withColumn("bucket", bucket).withColumn("_shard", F.pmod("_draw", F.lit(shards)))
    within = Window.partitionBy("bucket", "_shard")
    held = placed.groupBy("bucket", "_shard").agg(F.sum("_rows").alias("_held"))
    before = held.select("bucket", "_shard", (F.sum("_held").over(Window.partitionBy("bucket").orderBy("_shard")) - F.col("_held")).alias("_before"))
    first = F.sum("_rows").over(within.orderBy("_draw", "doc_id", "length")) - F.col("_rows")
    numbered = placed.withColumn("_first", first).join(bounded(before), ["bucket", "_shard"])
    # a row for each that was counted, some thousands at a time
    some, zero = F.lit(SHARD_ROWS).cast("long"), F.lit(0).cast("long")
    numbered = numbered.withColumn("_part", F.explode(F.sequence(zero, F.floor((F.col("_rows") - 1) / some))))
    numbered = numbered.withColumn("_each", F.explode(F.sequence(zero, F.least(some, F.col("_rows") - F.col("_part") * some) - 1)))
    numbered = numbered.withColumn("_row", F.col("_first") + F.col("_part") * some + F.col("_each"))

    def by_bucket(numbers) -> Column:
        return F.element_at(F.array(*[F.lit(int(x)) for x in numbers]), F.col("bucket") + 1).cast("long")

    place = F.col("_before") + F.col("_row")
    return numbered.select(
        "doc_id",
        "length",
        "bucket",
        by_bucket(bounds).alias("bucket_length"),
        (by_bucket(first_batch) + F.floor(place / by_bucket(room))).cast("long").alias("batch_id"),
        (place % by_bucket(room)).cast("int").alias("slot"),
        (by_bucket(bounds) - F.col("length")).alias("padding"),
    )
