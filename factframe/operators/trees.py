"""Nested documents as rows: every node with its path, differences of versions, canonical text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factframe.operators.storage import written

#: Keys that hold times of the clock and are no part of what a document says.
VOLATILE = ("analyzed_at", "built_at", "created_at")


def quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def tree_nodes(docs: DataFrame, keys: Sequence[str], document: str = "document", without: Sequence[str] = ()) -> DataFrame:
    """One row for each node of each document: the keys, path, parent, key, pos, depth, kind, leaf.

    `document` is JSON text, or a variant. Kind is object, array or leaf; `leaf`
    is the JSON of a leaf. A path is keys joined by dots and positions in
    brackets; keys that are no plain names stand in brackets, quoted, so no two
    nodes share a path. What stands under a key of `without`, at any depth, is
    left out. A text that is no JSON raises an error; a null has no nodes.

    Containers are opened level by level, so the work is in proportion to the
    nodes and the number of jobs to the depth.
    """
    v = F.col(document) if dict(docs.dtypes)[document] == "variant" else F.parse_json(F.col(document))
    level = docs.select(*keys, v.alias("_v")).where("_v is not null")
    level = level.select(*keys, F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("pos"), "_v")
    levels, depth = [], 0
    while True:
        text = F.to_json("_v")
        begins = F.substring("_text", 1, 1)
        kind = F.when(begins == "{", "object").when(begins == "[", "array").otherwise("leaf")
        level = written(level.withColumn("_text", text).withColumn("kind", kind), "nodes")
        levels.append(level.select(*keys, "path", "parent", "key", "pos", F.lit(depth).alias("depth"), "kind", F.when(F.col("kind") == "leaf", F.col("_text")).alias("leaf")))
        inner = level.where("kind <> 'leaf' and _text not in ('{}', '[]')")
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        opened = inner.select(*keys, F.col("path").alias("parent"), "_v").lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        if without:
            opened = opened.where(F.col("key").isNull() | ~F.col("key").isin(*without))
        plain = F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_]*$")
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos"), F.lit("]"))).when(~plain, F.concat(F.lit("["), quoted(F.col("key")), F.lit("]")))
        dotted = F.when(F.col("parent") == "", F.col("key")).otherwise(F.concat_ws(".", "parent", "key"))
        level = opened.select(*keys, F.coalesce(F.concat("parent", step), dotted).alias("path"), "parent", "key", "pos", F.col("value").alias("_v"))
        depth += 1


def rebuilt(nodes: DataFrame, keys: Sequence[str], name: str = "document") -> DataFrame:
    """The keys and the text of each document, made of its nodes: keys sorted by code point at every depth, no white space."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    inner = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = nodes.where(F.col("depth") == depth)
        if inner is None:
            here = here.withColumn("_inside", F.lit(None).cast("string"))
        else:
            here = here.join(inner.withColumnRenamed("parent", "path"), [*keys, "path"], "left")
        inside = F.coalesce("_inside", F.lit(""))
        text = F.when(F.col("kind") == "leaf", F.col("leaf")).when(F.col("kind") == "object", F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(F.concat(F.lit("["), inside, F.lit("]")))
        made = here.select(*keys, "parent", F.when(F.col("key").isNotNull(), F.concat(quoted(F.col("key")), F.lit(":"))).alias("_name"), "key", "pos", text.alias("_text"))
        if depth == 0:
            return made.select(*keys, F.col("_text").alias(name))
        parts = F.sort_array(F.collect_list(F.struct("key", "pos", F.concat_ws("", "_name", "_text").alias("text"))))
        inner = made.groupBy(*keys, "parent").agg(F.array_join(F.transform(parts, lambda p: p["text"]), ",").alias("_inside"))
    return nodes.select(*keys, F.col("leaf").alias(name)).limit(0)


def canonical(docs: DataFrame, keys: Sequence[str], document: str = "document", volatile: Sequence[str] = VOLATILE) -> DataFrame:
    """The keys, the canonical text of each document without volatile keys, and its sha256."""
    text = rebuilt(tree_nodes(docs, keys, document, volatile), keys, "canonical")
    return text.withColumn("digest", F.sha2(F.col("canonical").cast("binary"), 256))


def tree_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], document: str = "document", without: Sequence[str] = ()) -> DataFrame:
    """Leaves that differ: the keys, path, change (- only left, + only right, ~ both), old, new."""
    sides = [tree_nodes(d, keys, document, without).where("kind = 'leaf'").select(*keys, "path", F.col("leaf").alias(n)) for d, n in ((left, "old"), (right, "new"))]
    both = sides[0].join(sides[1], [*keys, "path"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("new").isNull(), "-").when(F.col("old").isNull(), "+").otherwise("~")
    return both.select(*keys, "path", change.alias("change"), "old", "new")
