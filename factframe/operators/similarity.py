"""Similarity join of sets: all pairs of a Jaccard similarity above a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factframe.operators.storage import bounded, written


def prefix_length(size: Column, threshold: float) -> Column:
    """How many of a set's rarest members any similar set must share one of."""
    return size - F.ceil(F.lit(threshold) * size - 1e-9) + 1


#: Largest set that is carried along with its rare members; larger ones are looked up for each candidate pair.
WIDE = 64


def _meetings(ranked: DataFrame, key: str, threshold: float) -> DataFrame:
    """a, b, their sizes n and m, and their members _a and _b where they are not wide: a row for each rare member in common."""
    sized = ranked.withColumn("_n", F.size("members"))
    carried = F.when(F.col("_n") <= WIDE, F.col("members"))
    rare = F.posexplode(F.slice("members", F.lit(1), prefix_length(F.col("_n"), threshold).cast("int"))).alias("i", "member")
    prefix = sized.select(F.col(key).alias("a"), F.col("_n").alias("n"), carried.alias("_a"), rare)
    other = prefix.select(F.col("a").alias("b"), F.col("n").alias("m"), F.col("_a").alias("_b"), F.col("i").alias("j"), "member")
    n, m = F.col("n"), F.col("m")
    overlap = F.ceil(F.lit(threshold / (1 + threshold)) * (n + m) - 1e-9)
    able = (F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - 1e-9) & (F.least(n - F.col("i"), m - F.col("j")) >= overlap)
    return prefix.join(other, "member").where((F.col("a") < F.col("b")) & able)


def similar_candidates(ranked: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b) of the pairs that sizes and places of a common rare member leave able to be similar.

    ranked: key, members (rarest first). Only the rarest members of a set are
    looked up, so common ones, whose lists would be multiplied with themselves,
    meet nobody. A pair must be large enough for each other, and what stands
    after the common member in either must be enough for the overlap that the
    threshold asks for.
    """
    return _meetings(ranked, key, threshold).select("a", "b").distinct()


def similar_sets(sets: DataFrame, key: str, members: str, threshold: float) -> DataFrame:
    """(a, b, shared, jaccard) of all pairs of different keys whose sets' similarity is above the threshold.

    Members are ordered by rarity, candidates are found by their rarest ones and
    counted exactly, where they meet. Empty sets and null keys have no partners; a set's repeated
    members count once; keys are unique.
    """
    rows = written(sets.where(F.col(key).isNotNull()).select(key, F.array_distinct(members).alias("members")), "sets")
    each = rows.select(key, F.explode("members").alias("member"))
    often = each.groupBy("member").agg(F.count("*").alias("_often"))
    placed = each.join(bounded(often), "member").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_often", "member"))).alias("_m"))
    ranked = written(placed.select(key, F.transform("_m", lambda x: x["member"]).alias("members")), "ranked")
    # a pair is counted where it meets by its first common member, so it is neither made distinct nor joined to its sets
    met = _meetings(ranked, key, threshold)
    common = F.array_intersect("_a", "_b")
    small = met.where(F.greatest("n", "m") <= WIDE).withColumn("_common", common).where(F.get("_common", F.lit(0)) == F.col("member"))
    counted = small.select("a", "b", "n", "m", F.size("_common").cast("long").alias("shared"))
    if not ranked.where(F.size("members") > WIDE).isEmpty():
        pairs = met.where(F.greatest("n", "m") > WIDE).select("a", "b", "n", "m").distinct()
        left, right = (ranked.select(F.col(key).alias(c), F.col("members").alias(f"_{c}")) for c in ("a", "b"))
        counted = counted.unionByName(pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", F.size(common).cast("long").alias("shared")))
    found = counted.withColumn("jaccard", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")))
    return found.where(F.col("jaccard") > threshold).select("a", "b", "shared", "jaccard")
