"""Chains of records that supersede one another, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factframe.operators.storage import written


def doubled(links: DataFrame, rounds: int) -> DataFrame:
    """(id, to) after 2 ** rounds steps along (id, to); ids whose way ends earlier are gone."""
    jump = links
    for _ in range(rounds):
        jump = written(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("_far")), "to").select("id", F.col("_far").alias("to")), "jumps")
    return jump


def named_cycles(links: DataFrame) -> DataFrame:
    """(id, cycle) of every record on a cycle; a cycle's name is its least id.

    After as many steps as there are links, only ways that run into a cycle go
    on, and where they stand is on one. Ways that have ended take no part in the
    next doubling, so without cycles this takes log2 of the longest chain rounds.
    """
    jump, steps, most = links, 1, links.count()
    while steps <= most:
        if jump.isEmpty():
            return jump.select("id", F.col("id").alias("cycle"))
        jump, steps = doubled(jump, 1), 2 * steps
    # the least id of the next 2 ** k steps, until a whole round changes nothing
    on = written(jump.select(F.col("to").alias("id")).distinct(), "cycles")
    state = written(links.join(on, "id").select("id", "to", F.col("id").alias("cycle")), "cycles")
    while True:
        far = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("cycle").alias("_cycle"))
        wider = written(state.join(far, "to").select("id", F.col("_to").alias("to"), F.least("cycle", "_cycle").alias("cycle"), (F.col("_cycle") < F.col("cycle")).alias("_less")), "cycles")
        if not wider.where("_less").limit(1).count():
            return wider.select("id", "cycle")
        state = wider.drop("_less")


def chains(records: DataFrame) -> DataFrame:
    """(newest, id, depth, ends, cycle) of every chain of `records` (id, supersedes), one record superseding at most one other.

    A chain begins at a record that nothing supersedes and goes back along the
    links. It ends at a record that supersedes nothing (`root`), at one whose
    predecessor is not among the records (`dangling`), or before it would enter a
    cycle (`cycle`, with the cycle's name, its least id). A cycle is a chain of
    its own that begins at its name. Chains of n records take log2(n) rounds of
    joins, whatever their number.

    Defined results: a null id is left out, rows that repeat an id count as the
    one with the least link, a record that supersedes itself is a cycle of one.
    """
    known = written(records.where("id is not null").groupBy("id").agg(F.min("supersedes").alias("supersedes")), "records")
    there = known.select(F.col("id").alias("supersedes"), F.lit(True).alias("_there"))
    linked = written(known.join(there, "supersedes", "left").select("id", "supersedes", F.coalesce("_there", F.lit(False)).alias("_there")), "linked")
    links = linked.where("_there").select("id", F.col("supersedes").alias("to"))
    cycles = named_cycles(links)
    to_cycle = cycles.select(F.col("id").alias("to"), F.col("cycle").alias("_into"))
    # links that would enter a cycle, or close one, are cut
    marked = linked.withColumn("to", F.when(F.col("_there"), F.col("supersedes"))).join(cycles, "id", "left").join(to_cycle, "to", "left")
    cut = F.col("_into").isNotNull() & (F.col("cycle").isNull() | (F.col("to") == F.col("cycle")))
    ends = F.when(F.col("supersedes").isNull(), "root").when(~F.col("_there"), "dangling").when(cut, "cycle")
    nodes = written(marked.select("id", F.when(~cut | F.col("_into").isNull(), F.col("to")).alias("to"), ends.alias("ends"), F.coalesce("cycle", "_into").alias("cycle")), "nodes")
    step = written(nodes.where("to is not null").select("id", "to"), "steps")
    heads = nodes.select("id").join(step.select(F.col("to").alias("id")), "id", "left_anti")
    # what is within 2 ** k steps of a head, and jumps of 2 ** k steps
    reach = written(heads.select(F.col("id").alias("newest"), "id", F.lit(0).cast("long").alias("depth")), "reach")
    length = 1
    while not step.isEmpty():
        further = reach.join(step, "id").select("newest", F.col("to").alias("id"), (F.col("depth") + length).alias("depth"))
        reach, step, length = written(reach.unionByName(further), "reach"), doubled(step, 1), 2 * length
    last = reach.groupBy("newest").agg(F.max_by("id", "depth").alias("id"))
    told = last.join(nodes.select("id", "ends", F.when(F.col("ends") == "cycle", F.col("cycle")).alias("cycle")), "id").select("newest", "ends", "cycle")
    return reach.join(told, "newest").select("newest", "id", "depth", "ends", "cycle")
