"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, how often it is taken. Among all rates of at most
MOST_COPIES that take a source's target of words, entropy balancing picks those
of least relative entropy to taking each document once: by its dual a document
of x words has the rate min(MOST_COPIES, exp(tilt * x)), with one tilt a source.
The dual is convex; Newton's method finds the tilts of all sources together, an
iteration being one aggregation of the histogram of (source, size) and a table of
one row a source. A step that leaves the bracket known so far is halved into it.

Rates become whole copies, the floor or the ceiling of the rate: over the sizes
of a source, largest first, the copies follow the words due so far, so that the
smallest documents settle what is left, and what they can't settle is made up by
a copy more or less of a few documents. Documents of one source and size share a
rate; which of them get one copy more is drawn by a hash of their contents.

Words and targets are counted in whole numbers and gradients in decimals, so a
rerun adds up to the same digits under any partitioning. Nothing of the size of
the corpus reaches the driver, and no task holds a source: the histogram has one
row a size, and rows of one size are numbered by shards (rows that are equal in
every column share one).

Targets: sources by code point, null last, weigh WEIGHTS in turn and share the
given number of words. A target stops at MOST_COPIES times its source's words;
what is left over is shared again by weight until none is above.

Defined results: null and empty texts have size 0 and are taken 0 times; sources
without words have target 0; repeated rows and null ids are rows like others; an
empty table gives an empty result; other columns are kept, and result columns
whose names are taken get an underscore.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factframe.llm.common import Scratch, bounded, free_name

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Newton's method ends when every source is within this share of its target, or half a word.
TOLERANCE, MOST_STEPS = 1e-9, 100
SHARD_ROWS = 1_000
RANGES = 64
_EXACT = "decimal(38,9)"


def word_size(text: str) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def ranked(rows: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """The table with `rank`, the place of each row by `key`, null last; counted by ranges, so no task holds all rows."""
    order = F.col(key).asc_nulls_last()
    dealt = rows.repartitionByRange(RANGES, order).sortWithinPartitions(order)
    place = F.monotonically_increasing_id()
    held = scratch.written(dealt.withColumn("_part", F.shiftright(place, 33)).withColumn("_inner", place.bitwiseAND((1 << 33) - 1)), "ranked")
    parts = held.groupBy("_part").agg(F.count("*").alias("_n"))  # at most RANGES rows
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_inner")).drop("_part", "_inner", "_before")


def source_targets(sources: DataFrame, share: float = 1.0, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Sources (`rank`, `words`) with `target`: `share` of all words by weight, none above `most` times its own."""
    listed = F.array(*[F.lit(int(w)) for w in weights])
    rows = sources.withColumn("_weight", F.element_at(listed, (F.col("rank") % len(weights) + 1).cast("int")).cast("long")).withColumn("_room", F.col("words") * most)
    total = rows.agg(F.sum("words")).first()[0] or 0
    # the level is words for each unit of weight: a source is full if its room for each unit is below it
    left, level = share * total, None
    while True:
        full = F.lit(False) if level is None else F.col("_room") <= F.col("_weight") * F.lit(level)
        r = rows.agg(F.sum(F.when(full, F.col("_room"))).alias("room"), F.sum(F.when(~full, F.col("_weight"))).alias("weight")).first()
        now = (left - (r["room"] or 0)) / r["weight"] if r["weight"] else level
        if level is None and now is None:
            now = 0.0
        if now == level:
            break
        level = now
    return rows.withColumn("target", F.least(F.col("_room").cast("double"), F.col("_weight") * F.lit(float(level)))).drop("_weight", "_room")


def tilts(sizes: DataFrame, sources: DataFrame, scratch: Scratch, most: int = MOST_COPIES) -> DataFrame:
    """rank, target, unit, tilt of each source; null tilt: every document is taken `most` times.

    `sizes` is the histogram (rank, size, n); a rate is min(most, exp(tilt * size / unit)).
    """
    least = sizes.where("size > 0").groupBy("rank").agg(F.min("size").alias("_least"))
    begun = sources.join(bounded(least), "rank").where("target > 0").select("rank", "target", (F.col("words") / F.col("documents")).alias("unit"), (F.col("target") >= F.col("words") * most).alias("full"))
    state = begun.withColumn("tilt", F.when(~F.col("full"), F.lit(0.0))).withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
    state = scratch.written(state.withColumn("off", F.lit(None).cast("double")), "tilts")
    x, words = F.col("size") / F.col("unit"), (F.col("n") * F.col("size")).cast("double")
    free = F.col("tilt") * x < math.log(most)
    rate = F.when(free, F.exp(F.col("tilt") * x)).otherwise(F.lit(float(most)))
    step = F.col("tilt") - F.try_divide("off", "slope")
    middle = (F.col("low") + F.col("high")) / 2
    # beyond a known bracket halve it; beyond an open one go at most by 2, times as far as it already is
    far = F.greatest(F.lit(2.0), 2 * F.abs("tilt"))
    inside = (F.col("low").isNull() | (step > F.col("low"))) & (F.col("high").isNull() | (step < F.col("high"))) & (F.abs(step - F.col("tilt")) <= far)
    outward = F.when(F.col("off") > 0, F.coalesce(middle, F.col("tilt") - far)).otherwise(F.coalesce(middle, F.col("tilt") + far))
    bound = F.greatest(F.col("target") * TOLERANCE, F.lit(0.5))
    for _ in range(MOST_STEPS):
        # one row a (source, size): no source is gathered, tasks add up before the shuffle
        joined = sizes.where("size > 0").join(bounded(state.where("not full")), "rank")
        sums = joined.groupBy("rank").agg(F.sum((words * rate).cast(_EXACT)).cast("double").alias("taken"), F.sum(F.when(free, words * rate * x).otherwise(0.0).cast(_EXACT)).cast("double").alias("slope"))
        off = state.drop("off").join(bounded(sums), "rank", "left").withColumn("off", F.col("taken") - F.col("target"))
        narrowed = off.withColumn("low", F.when(F.col("off") <= 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("off") > 0, F.col("tilt")).otherwise(F.col("high")))
        moved = F.when(F.col("full") | (F.abs("off") <= bound), F.col("tilt")).when(inside & (F.col("slope") > 0), step).otherwise(outward)
        state = scratch.written(narrowed.withColumn("_next", moved).select("rank", "target", "unit", "full", F.col("_next").alias("tilt"), "low", "high", "off"), "tilts")
        if not state.where(~F.col("full") & (F.abs("off") > bound)).limit(1).count():
            return state.select("rank", "target", "unit", "tilt")
    raise RuntimeError(f"no tilts within {MOST_STEPS} steps")


def whole_copies(sizes: DataFrame, state: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """rank, size, low, extra: each document of the size is taken `low` times, `extra` of them once more.

    Largest sizes first; a size takes the number of copies that brings the words
    taken nearest to those due so far, within the floor and ceiling of its rate.
    Where the smallest documents have no room for what is left, a second pass
    changes sizes by at most one copy a document. A task folds the sizes of one
    source, one row each.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        sizes, held, rates = rows["size"].tolist(), rows["n"].tolist(), rows["rate"].tolist()
        due, taken, copies = 0.0, 0, []
        for size, n, rate in zip(sizes, held, rates, strict=True):
            due += rate * n * size
            k = min(max(round((due - taken) / size), math.floor(rate) * n), math.ceil(rate) * n)
            copies.append(k)
            taken += k * size
        for i, (size, n) in enumerate(zip(sizes, held, strict=True)):
            k = min(max(round((due - taken) / size), -n, -copies[i]), n, most * n - copies[i])
            copies[i] += k
            taken += k * size
        out = [(rank, size, k // n, k % n) for rank, size, n, k in zip(rows["rank"], sizes, held, copies, strict=True)]
        return pd.DataFrame(out, columns=["rank", "size", "low", "extra"])

    rate = F.when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("unit"), F.lit(math.log(most) + 1)))))
    rated = sizes.where("size > 0").join(bounded(state), "rank").select("rank", "size", "n", rate.alias("rate"))
    return rated.groupBy("rank").applyInPandas(fold, "rank long, size long, low int, extra long")


def mix(docs: DataFrame, source: str = "source", text: str = "text", share: float = 1.0, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, keep_text: bool = False) -> DataFrame:
    """The table (without the text unless asked for) with size, source_size, target, copies and taken (copies times size)."""
    scratch = Scratch(docs.sparkSession)
    kept = [c for c in docs.columns if keep_text or c != text]
    body = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(1).alias("_"))
    draw = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))])
    sized = scratch.written(docs.select(body.alias("_row"), F.col(f"`{source}`").alias("source"), word_size(text).alias("size"), draw.alias("_draw")), "sized")
    held = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    by_source = held.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("documents"))
    sources = scratch.written(source_targets(ranked(by_source, "source", scratch), share, weights, most), "sources")
    places = sources.select(F.col("source").alias("_source"), "rank")
    sizes = scratch.written(held.join(bounded(places), F.col("source").eqNullSafe(F.col("_source"))).select("rank", "size", "n"), "sizes")
    copies = scratch.written(whole_copies(sizes, tilts(sizes, sources, scratch, most), most), "copies")

    # rows of one size that a copy more is drawn for: numbered by shards of their draw
    known = sized.join(bounded(sources.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
    plan = copies.join(sizes, ["rank", "size"]).withColumn("_shards", F.ceil(F.col("n") / SHARD_ROWS))
    planned = known.join(bounded(plan.drop("n")), ["rank", "size"], "left").withColumn("_shard", F.pmod(F.shiftright("_draw", 8), F.coalesce("_shards", F.lit(1))))
    drawn = planned.where("extra > 0")
    shards = drawn.groupBy("rank", "size", "_shard").agg(F.count("*").alias("_n"))
    before = shards.select("rank", "size", "_shard", (F.sum("_n").over(Window.partitionBy("rank", "size").orderBy("_shard")) - F.col("_n")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("rank", "size", "_shard").orderBy("_draw"))
    numbered = drawn.withColumn("_number", number).join(bounded(before), ["rank", "size", "_shard"])
    more = (F.col("_before") + F.col("_number") <= F.col("extra")).cast("int")
    columns = ["_row", "size", "words", "target"]
    rest = planned.where("extra is null or extra = 0").select(*columns, F.coalesce("low", F.lit(0)).alias("copies"))
    every = numbered.select(*columns, (F.col("low") + more).alias("copies")).unionByName(rest)

    own = [F.col("_row").getField(c).alias(c) for c in kept]
    probe = every.select(*own)
    made = {"size": F.col("size"), "source_size": F.col("words"), "target": F.col("target"), "copies": F.col("copies"), "taken": F.col("copies") * F.col("size")}
    return every.select(*own, *[c.alias(free_name(probe, name)) for name, c in made.items()])
