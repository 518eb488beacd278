"""Greedy matching of expectations with facts, where a null field of an expectation matches anything."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factframe.operators.ranks import numbered
from factframe.operators.storage import bounded, written


#: Rows of a scope that one task sorts; larger scopes are matched by shards.
SCOPE_ROWS = 1_000_000


def greedy_matches(
    expected: DataFrame, found: DataFrame, scope: Sequence[str], fields: Sequence[str], order: Sequence[str], width: int = 10_000, within: int = SCOPE_ROWS, sizes: DataFrame | None = None
) -> DataFrame:
    """One row for each expectation that claims a fact: the scope, `expectation` and `fact` (ids of rows) and `fixed` (number of fields).

    Expectations claim one after another, each the first fact of its scope that
    no other has claimed and that agrees in every field that is not null: those
    with most fixed fields first, of equal number in the order of the fields (as
    bits, the first field lowest), then by `order`. A null field of a fact agrees
    with a null field only.

    Expectations with the same fixed fields are one round: among those of equal
    values the k-th takes the k-th fact that is left. There are at most
    2 ** fields rounds. Scopes of at most `within` rows are shuffled once, for
    all rounds; the rows of larger ones are numbered by shards, never gathered.
    `sizes` is what scope_sizes() gave, if it is known.
    """
    bits = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(fields)))
    columns = [*scope, *fields, *order]
    wanted = expected.select(*columns).withColumn("expectation", F.monotonically_increasing_id()).withColumn("_fixed", bits)
    offered = found.select(*columns).withColumn("fact", F.monotonically_increasing_id())
    masks = sorted((r["_fixed"] for r in expected.select(bits.alias("_fixed")).distinct().collect()), key=lambda m: (-m.bit_count(), m))
    if not masks:
        return wanted.select(*scope, "expectation", F.col("expectation").alias("fact"), F.lit(0).alias("fixed"))
    sizes = scope_sizes(expected, found, scope) if sizes is None else sizes
    large = sizes.where(F.col("expected") + F.col("found") > within).select(*scope)
    if large.isEmpty():
        return _by_scope(wanted, offered, scope, fields, order, masks)
    wanted, offered, large = written(wanted, "expected"), written(offered, "found"), bounded(large)
    most = _by_shards(wanted.join(large, [*scope], "left_semi"), offered.join(large, [*scope], "left_semi"), scope, fields, order, masks, width)
    return most.unionByName(_by_scope(wanted.join(large, [*scope], "left_anti"), offered.join(large, [*scope], "left_anti"), scope, fields, order, masks))


def scope_sizes(expected: DataFrame, found: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The scope with the numbers of its rows, `expected` and `found`."""
    both = expected.select(*scope, F.lit(1).alias("_e")).unionByName(found.select(*scope, F.lit(0).alias("_e")))
    return written(both.groupBy(*scope).agg(F.count_if(F.col("_e") == 1).alias("expected"), F.count_if(F.col("_e") == 0).alias("found")), "sizes")


def _by_scope(wanted: DataFrame, offered: DataFrame, scope: Sequence[str], fields: Sequence[str], order: Sequence[str], masks: Sequence[int]) -> DataFrame:
    """The rounds as windows over one table of expectations and facts, dealt by scope once; a window streams, no group is held.

    In a group the expectations come first, so at a fact their number is known,
    and the facts left are claimed up to it.
    """
    asks, free = F.col("_asks"), F.col("_round").isNull()
    # ids that nobody reads are not shuffled
    asking = wanted.withColumns({"_asks": F.lit(True), "fact": F.lit(None).cast("long")})
    offering = offered.withColumns({"_asks": F.lit(False), "expectation": F.lit(None).cast("long"), "_fixed": F.lit(None).cast("int")})
    rows = asking.unionByName(offering).dropna(subset=[*scope]).repartition(*scope)
    # one number stands for the columns of the order in all rounds
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*scope).orderBy(asks.desc(), *order))).drop(*order)
    rows = rows.withColumn("_round", F.lit(None).cast("int")).withColumn("_number", F.lit(None).cast("long"))
    for mask in masks:
        fixed = [*scope, *(c for i, c in enumerate(fields) if mask >> i & 1)]
        group = Window.partitionBy(*fixed).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
        mine = asks & (F.col("_fixed") == mask)
        rows = rows.withColumns({"_asked": F.count_if(mine).over(group), "_left": F.count_if(~asks & free).over(group)})
        claimed = ~asks & free & (F.col("_left") <= F.col("_asked"))
        number = F.when(mine, F.col("_asked")).when(claimed, F.col("_left")).otherwise(F.col("_number"))
        rows = rows.withColumns({"_number": number, "_round": F.when(mine | claimed, mask).otherwise(F.col("_round"))}).drop("_asked", "_left")
    values = [F.when(F.col("_round").bitwiseAND(1 << i) != 0, F.col(c)).alias(c) for i, c in enumerate(fields)]
    pairs = rows.where("_round is not null").select(*scope, *values, "_round", "_number", "expectation", "fact").groupBy(*scope, *fields, "_round", "_number")
    met = pairs.agg(F.count("*").alias("_n"), F.max("expectation").alias("expectation"), F.max("fact").alias("fact")).where("_n = 2")
    return met.select(*scope, "expectation", "fact", F.bit_count("_round").alias("fixed"))


def _by_shards(wanted: DataFrame, left: DataFrame, scope: Sequence[str], fields: Sequence[str], order: Sequence[str], masks: Sequence[int], width: int) -> DataFrame:
    """The rounds as equi-joins on scope, values and row numbers, each with the facts that earlier ones left."""
    claims = []
    for mask in masks:
        fixed = [*scope, *(c for i, c in enumerate(fields) if mask >> i & 1)]
        asking = numbered(wanted.where(F.col("_fixed") == mask), fixed, order, width).select(*fixed, "number", "expectation")
        offered = numbered(left, fixed, order, width).select(*fixed, "number", "fact")
        claimed = written(asking.join(offered, [*fixed, "number"]).select(*scope, "expectation", "fact", F.lit(mask.bit_count()).alias("fixed")), "claims")
        claims.append(claimed)
        left = written(left.join(claimed.select("fact"), "fact", "left_anti"), "left")
    return reduce(DataFrame.unionByName, claims)


def match_quality(expected: DataFrame, found: DataFrame, scope: Sequence[str], fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The scope with matched, expected, found, precision, recall and f1; a share of nothing is 0."""
    counts = scope_sizes(expected, found, scope)
    claims = greedy_matches(expected, found, scope, fields, order, sizes=counts).groupBy(*scope).agg(F.count("*").alias("matched"))
    counts = counts.join(claims, [*scope], "left")
    matched, n_expected, n_found = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("matched", "expected", "found"))
    share = lambda a, b: F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(0.0)
    out = counts.select(*scope, matched.alias("matched"), n_expected.alias("expected"), n_found.alias("found"))
    out = out.withColumn("precision", share(F.col("matched"), F.col("found"))).withColumn("recall", share(F.col("matched"), F.col("expected")))
    return out.withColumn("f1", share(2 * F.col("matched"), F.col("found") + F.col("expected")))
