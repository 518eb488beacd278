"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so a MinHash of the document would be
drowned by its other text (40 words in 20,000 words are a Jaccard similarity of
0.002). Containment is estimated from the short side: items are partitioned by
size, each item's bottom-k MinHash sketch (its k shingles of least hash, k grows
with the partition) is looked up among all shingles of every document, and pairs
with enough of the sketch present become candidates. Candidates are verified by
exact shingle containment. Everything is DataFrame operations.

Documents' shingles are never shuffled before they are looked up: the items'
shingles are cut into slices small enough to broadcast, each counted first, and
every slice is looked up in a pass over the documents. One benchmark takes one
pass. Items of equal texts are looked up once.

A shingle is five consecutive words (letters, digits and underscores, case
folded); an item of fewer words is one shingle of all its words and is looked
up among runs of that many words.

Defined results: items without a word match nothing; a null or empty text
contains nothing; rows that share a doc_id count as one document, null ids as
one more; repeated items are each reported under their own item_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factframe.llm.common import bounded, written

SHINGLE = 5
CONTAINMENT = 0.8
#: Shingles in the sketch of an item of 2**part to 2**(part + 1) - 1 shingles.
SKETCH = {part: 8 * (part + 1) for part in range(3, 32)} | {0: 8, 1: 8, 2: 8}
#: Share of the sketch that a candidate must hold; a pair at containment 0.8 misses it with probability below 1e-6.
CANDIDATE = 0.35
#: Shingles of items in a slice.
SLICE_ROWS = 200_000


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+"), "")


def _hashed(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, plus the array of word hashes."""
    return df.select(*keep, F.transform(words(text), lambda w: F.xxhash64(w)).alias("_h"))


def _runs(k: int) -> Column:
    """Hashes of all runs of k words of _h."""
    starts = F.slice("_h", 1, F.greatest(F.size("_h") - (k - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(F.col("_h"), i + j) for j in range(1, k)]))


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, k (run length), shingle: the distinct shingles of every item."""
    n = F.size("_h")
    shingles = F.when(n >= SHINGLE, _runs(SHINGLE))
    for k in range(1, SHINGLE):
        shingles = shingles.when(n == k, _runs(k))
    hashed = _hashed(items.select("item_id", "text"), ["item_id"]).where(n > 0)
    return hashed.select("item_id", F.least(n, F.lit(SHINGLE)).alias("k"), F.explode(F.array_distinct(shingles)).alias("shingle")).distinct()


def sketches(shingles: DataFrame) -> DataFrame:
    """item_id, size, part (power of two of the size), need (hits that make a candidate), shingle: the bottom-k sketch."""
    rank = F.struct(F.xxhash64(F.lit("sketch"), "shingle").alias("rank"), "shingle")
    sized = shingles.groupBy("item_id").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(rank)).alias("all"))
    part = F.floor(F.log2("size")).cast("int")
    k = F.least(F.col("size"), F.element_at(F.create_map(*[F.lit(x) for p in sorted(SKETCH) for x in (p, SKETCH[p])]), part))
    chosen = sized.withColumn("part", part).withColumn("k", k.cast("int"))
    need = F.greatest(F.lit(1), F.floor(F.col("k") * CANDIDATE)).cast("long").alias("need")
    return chosen.select("item_id", "size", "part", need, F.explode(F.slice("all.shingle", 1, F.col("k"))).alias("shingle"))


def _sliced(table: DataFrame) -> list[DataFrame]:
    """The table in slices of about SLICE_ROWS rows by hash of the shingle, so a long item spreads over them like many short ones."""
    n = -(-table.count() // SLICE_ROWS) or 1
    return [table if n == 1 else table.where(F.pmod(F.xxhash64(F.lit("slice"), "shingle"), F.lit(n)) == i) for i in range(n)]


def _looked_up(docs: DataFrame, lengths: list[int], table: DataFrame) -> DataFrame:
    """Shingles of documents joined with the table's rows of the same shingle, slice by slice; a slice that is larger than planned, of a shingle that very many items share, is joined by a shuffle."""
    found = [_document_shingles(docs, lengths).join(bounded(part, 2 * SLICE_ROWS), "shingle") for part in _sliced(table)]
    return reduce(DataFrame.unionByName, found)


def _document_shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    hashed = _hashed(docs, ["doc_id"])
    runs = [_runs(k) for k in lengths]
    return hashed.select("doc_id", F.size("_h").alias("words"), F.explode(F.concat(*runs) if len(runs) > 1 else runs[0]).alias("shingle"))


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, containment: every pair whose document holds at least that share of the item's shingles."""
    docs = docs.select("doc_id", "text")
    # items of equal texts are looked for once, under the least of their ids
    held_text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    told = items.where("item_id is not null").groupBy("item_id").agg(F.array_sort(F.collect_set(held_text)).alias("_texts"))
    named = written(told.groupBy("_texts").agg(F.min("item_id").alias("rep"), F.count("*").alias("_n")), "item-texts")
    members = told.join(bounded(named.where("_n > 1").select("_texts", "rep")), "_texts").select("item_id", "rep")
    once = items.join(bounded(named.select(F.col("rep").alias("item_id"))), "item_id", "left_semi")
    whole = written(item_shingles(once), "item-shingles")
    lengths = sorted(r["k"] for r in whole.select("k").distinct().collect()) or [SHINGLE]
    least = written(sketches(whole), "item-sketches")

    # a document of too few words cannot hold enough of an item of this size partition
    hits = _looked_up(docs, lengths, least).where(F.col("words") >= F.floor(F.pow(F.lit(2.0), "part") * containment))
    pairs = hits.groupBy("doc_id", "item_id", "need", "size").agg(F.count_distinct("shingle").alias("hits")).where("hits >= need")
    candidates = written(pairs.select("doc_id", "item_id", "size"), "contained")

    suspects = candidates.select(F.col("doc_id").alias("_id")).distinct()
    again = docs.join(bounded(suspects), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = _looked_up(again, lengths, whole.select("item_id", "shingle"))
    held = found.groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("held"))
    same = held["doc_id"].eqNullSafe(candidates["doc_id"]) & (held["item_id"] == candidates["item_id"])
    share = F.col("held") / F.col("size")
    contained = held.join(candidates, same).where(share >= containment).select(held["doc_id"], held["item_id"].alias("rep"), share.alias("containment"))
    every = contained.join(bounded(members), "rep", "left")
    return every.select("doc_id", F.coalesce("item_id", "rep").alias("item_id"), "containment")


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no test item, with their own columns; rows without an id are kept unless they hold one."""
    found = written(contained_items(docs, items, **options).select(F.col("doc_id").alias("_id")).distinct(), "contaminated")
    return docs.join(bounded(found), docs["doc_id"].eqNullSafe(found["_id"]), "left_anti")
