"""Near-duplicate detection with Order MinHash.

A text's five-word shingles are labelled with their occurrence number. Each of
BANDS hash functions takes the LENGTH labelled shingles of least hash and keeps
them in text order; texts with an equal ordered tuple meet in a bucket. Unlike
plain MinHash this is sensitive to the order of the text, hence to edit
similarity. Every two texts that meet in a bucket, and whose sizes allow it,
are a candidate pair. Two texts in which every tenth word differs share a third
of their shingles and meet with probability 1 - (1 - 1/9)**32, 0.98; with every
twentieth, 0.9999.

A candidate is verified by a banded alignment of the words alone: a bit-parallel
longest common subsequence, within the band that this similarity allows, whose
words are at least SIMILARITY of the words of both texts together. Words that
both texts hold at all, in any order, bound what can align, so pairs that share
too few are not aligned; no pair that would be accepted is lost by that. Verified
links are closed into classes.

Exact copies are collapsed first. Then one member of each bucket, the one that
meets most others, is verified against the rest and the classes are closed:
this joins large groups with as many pairs as members. Buckets that still hold
several classes are dealt into blocks of bounded size, and every pair of blocks
is one group: in it all pairs of different classes are compared exactly, classes
are merged as links are found, and only links that merged two classes leave the
task, fewer than it has members. A pair is compared in its first common bucket
only. So every candidate is either verified or already within one class; none
is capped. The comparing itself is quadratic in the members of one bucket that
stay apart after the first step; its output and memory are not.

Defined results: null and empty texts, and texts without a word, are classes by
equality of the text only; a text of fewer than five words is one shingle; the
class id is the least doc_id of the class (null if it has none); rows that
repeat a doc_id with other text are documents of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factframe.llm.common import Scratch, bounded, written
from factframe.llm.hashing import Tokens, chunks, mix, pair, shingles

SHINGLE, SIMILARITY = 5, 0.8
BANDS, LENGTH = 32, 2
#: The shorter of two similar texts has at least this share of the longer one's words.
SHORTER = SIMILARITY / (2 - SIMILARITY)
#: Words in a block of a bucket.
BLOCK_WORDS = 400_000
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def labelled(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Shingle hashes combined with how often the shingle has occurred before in the text."""
    s = shingles(hashes, k)
    order = np.argsort(s, kind="stable")
    ordered = s[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    occurrence = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    out = np.empty(len(s), np.uint64)
    out[order] = pair(ordered, occurrence.astype(np.uint64))
    return out


def sketch(labels: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """One hash for each band: of the `length` least labelled shingles, in text order."""
    rows = []
    for seeds in np.array_split(_SEEDS, 1 + len(labels) // 100_000):
        if not len(seeds):
            continue
        ranks = (labels[None, :] ^ seeds) * np.uint64(0xFF51AFD7ED558CCD)
        ranks ^= ranks >> np.uint64(32)
        if len(labels) > length:
            at = np.sort(np.argpartition(ranks, length - 1, axis=1)[:, :length], axis=1)
        else:
            at = np.broadcast_to(np.arange(len(labels)), (len(seeds), len(labels)))
        rows.append(labels[at])
    chosen = np.concatenate(rows)
    out = np.arange(len(chosen), dtype=np.uint64)
    for column in chosen.T:
        out = pair(out, column)
    return out


def banded_lcs(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """Longest common subsequence with matches at most `band` off the diagonal, one bit for each word of x."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    if n == 0:
        return head
    differ = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    x, y = x[: len(x) - tail].tolist(), y[: len(y) - tail].tolist()
    if not x or not y:
        return head + tail
    where: dict[int, int] = {}
    for i, w in enumerate(x):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(x)) - 1
    window, row = (1 << (2 * band + 1)) - 1, full
    for j, w in enumerate(y):
        match = where.get(w)
        if match:
            match &= window << (j - band) if j >= band else window >> (band - j)
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
    return head + tail + len(x) - row.bit_count()


def aligned(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> bool:
    """The words that align within the band are at least that share of both texts."""
    longest = max(len(x), len(y))
    return 2 * banded_lcs(x, y, int((1 - least) * longest) + abs(len(x) - len(y)) + 1) >= least * (len(x) + len(y))


def similar(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> bool:
    """The aligned words are at least that share of both texts together; they are no more than the words both hold."""
    if not len(x) or not len(y):
        return False
    shared = len(np.intersect1d(labelled(x, 1), labelled(y, 1), assume_unique=True))
    return 2 * shared >= least * (len(x) + len(y)) and aligned(x, y, least)


def text_key(text: str = "text") -> Column:
    """16 bytes that stand for a text; null and empty are alike."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sketches(docs: DataFrame) -> DataFrame:
    """node (text key), n (words), tuples (one hash for each band): one row for each distinct text with a word."""

    def sketch_all(batches):
        for batch, texts in chunks(batches):
            tokens = Tokens(texts)
            offsets = tokens.per_doc()
            kept, keys, sizes = [], [], []
            for i in range(len(texts)):
                if offsets[i + 1] > offsets[i]:
                    kept.append(i)
                    keys.append(sketch(labelled(tokens.hash[offsets[i] : offsets[i + 1]])).view(np.int64))
                    sizes.append(offsets[i + 1] - offsets[i])
            if kept:
                flat = pa.array(np.concatenate(keys))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(sizes, pa.int64()), lists], names=["node", "n", "tuples"])

    return docs.select(text_key().alias("node"), "text").mapInArrow(sketch_all, "node binary, n long, tuples array<long>").distinct()


def word_hashes(texts: DataFrame) -> DataFrame:
    """node, words: the hashes of a text's words in order, eight bytes each."""

    def hashes(batches):
        for batch, part in chunks(batches):
            tokens = Tokens(part)
            offsets = tokens.per_doc()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokens.hash[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["node", "words"])

    return texts.select("node", "text").mapInArrow(hashes, "node binary, words binary")


def _words(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def verify(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar; words are looked up by two joins."""

    def check(batches):
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                ok = pa.array([similar(x, y) for x, y in zip(_words(part.column(2)), _words(part.column(3)), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(ok)

    left = words.select(F.col("node").alias("a"), F.col("words").alias("_x"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("_y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "_x", "_y").mapInArrow(check, "a binary, b binary")


def merging_links(words: list[np.ndarray], tuples: np.ndarray, group: np.ndarray, home: np.ndarray, band: int, apart: bool) -> list[tuple[int, int]]:
    """Links between members of different groups, each merging two groups: as many as it takes to merge all that are linked.

    Members come in order of their number of words. With `apart`, only pairs
    of different homes count. A pair counts in the first band where its tuples agree.
    """
    counted = [labelled(w, 1) for w in words]
    n = np.fromiter(map(len, counted), np.int64, len(counted))
    offset = np.concatenate(([0], np.cumsum(n)))
    ids = np.unique(np.concatenate(counted), return_inverse=True)[1].astype(np.int32)
    mine = np.zeros(len(ids), bool)
    last = np.searchsorted(n, n / SHORTER + 1e-9, side="right")
    group, links = group.copy(), []
    for i in range(len(n)):
        near = np.flatnonzero((group[i + 1 : last[i]] != group[i]) & ((home[i + 1 : last[i]] != home[i]) | (not apart))) + i + 1
        if len(near):
            near = near[(tuples[near] == tuples[i]).argmax(1) == band]
        if not len(near):
            continue
        own = ids[offset[i] : offset[i + 1]]
        mine[own] = True
        first = np.cumsum(n[near]) - n[near]
        at = np.repeat(offset[near] - first, n[near]) + np.arange(int(n[near].sum()))
        shared = np.add.reduceat(mine[ids[at]].astype(np.int32), first)
        mine[own] = False
        fit = np.flatnonzero(2 * shared >= SIMILARITY * (n[i] + n[near]))
        for j in near[fit[np.argsort(-shared[fit], kind="stable")]].tolist():
            if group[j] != group[i] and aligned(words[i], words[j]):
                links.append((i, j))
                group[group == group[j]] = group[i]
    return links


def links_within_buckets(members: DataFrame) -> DataFrame:
    """a, b: links that merge classes, in each bucket of (band, key, node, n, label, tuples, words, blocks).

    Each pair of a bucket's blocks is one group, so no group grows with its bucket.
    """
    other, home = F.col("_other"), F.pmod(F.xxhash64("node"), F.col("blocks"))
    cells = members.withColumn("home", home).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.withColumn("low", F.least("home", other)).withColumn("high", F.greatest("home", other)).drop("_other", "blocks")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        band, apart = table.column("band")[0].as_py(), table.column("low")[0].as_py() != table.column("high")[0].as_py()
        group = np.unique(np.array(table.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
        links = merging_links(_words(table.column("words")), np.stack(table.column("tuples").to_numpy()), group, table.column("home").to_numpy(), band, apart) if group.any() else []
        nodes = table.column("node")
        x, y = (nodes.take(pa.array([link[k] for link in links], pa.int64())) for k in (0, 1))
        return pa.table([x, y], names=["a", "b"])

    return cells.groupBy("band", "key", "low", "high").applyInArrow(compare, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that links reach.

    In a round every node takes the least node of itself and its neighbours,
    pointers are followed to their ends, and the links that are left are those
    between different ends: a round meets each of its links twice, and the next
    one has fewer.
    """
    scratch = Scratch(links.sparkSession)
    ordered = lambda df, a, b: df.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).where("low != high").distinct()
    left, labels = scratch.written(ordered(links, "a", "b"), "links"), None
    while labels is None or not left.isEmpty():
        ends = left.select(F.col("high").alias("node"), F.col("low").alias("end")).union(left.select("low", "low")).groupBy("node").agg(F.min("end").alias("end"))
        ends, moved = scratch.written(ends, "ends"), True
        while moved:
            further = ends.select(F.col("node").alias("end"), F.col("end").alias("_far"))
            jumped = scratch.written(ends.join(further, "end").select("node", F.col("_far").alias("end"), (F.col("end") != F.col("_far")).alias("moved")), "ends")
            ends, moved = jumped.select("node", "end"), not jumped.where("moved").isEmpty()
        low, high = (ends.select(F.col("node").alias(c), F.col("end").alias(f"_{c}")) for c in ("low", "high"))
        left = scratch.written(ordered(left.join(low, "low").join(high, "high"), "_low", "_high"), "links")
        if labels is None:
            labels = ends.select("node", F.col("end").alias("label"))
        else:
            now = labels.join(ends.select(F.col("node").alias("label"), "end"), "label", "left")
            labels = scratch.written(now.select("node", F.coalesce("end", "label").alias("label")), "labels")
    found = written(labels, "components")
    scratch.clear()
    return found


def classes(docs: DataFrame) -> DataFrame | None:
    """node, label of all distinct texts that have a link; None if no texts meet."""
    scratch = Scratch(docs.sparkSession)
    everyone = scratch.written(sketches(docs), "sketches")
    exploded = everyone.select("node", "n", F.posexplode("tuples").alias("band", "key"))
    shared = exploded.groupBy("band", "key").agg(F.count("*").alias("meet")).where("meet > 1")
    # one row for each text that meets another, with its buckets: BANDS at most
    meeting = exploded.join(shared, ["band", "key"]).groupBy("node", "n").agg(F.collect_list(F.struct("band", "key", "meet")).alias("buckets"))
    meeting = scratch.written(meeting.withColumn("weight", F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + b["meet"])), "meeting")
    if meeting.isEmpty():
        scratch.clear()
        return None
    texts = docs.select(text_key().alias("node"), "text").join(bounded(meeting.select("node")), "node", "left_semi").dropDuplicates(["node"])
    words = scratch.written(word_hashes(texts), "words")
    members = meeting.select("node", "n", "weight", F.explode("buckets").alias("_b")).select("node", "n", "weight", "_b.band", "_b.key")

    # the star's centre is the member that meets most others, as the origin of a group of near copies does
    centre = members.groupBy("band", "key").agg(F.min(F.struct((-F.col("weight")).alias("rank"), "node", "n")).alias("_c")).select("band", "key", F.col("_c.node").alias("_node"), F.col("_c.n").alias("_n"))
    close = (F.col("node") != F.col("_node")) & (F.least("n", "_n") >= SHORTER * F.greatest("n", "_n") - 1e-9)
    star = members.join(centre, ["band", "key"]).where(close).select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()
    links = scratch.written(verify(scratch.written(star, "pairs"), words), "star-links")
    labels = components(links)

    now = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = now.groupBy("band", "key").agg(F.ceil(F.sum("n") / BLOCK_WORDS).alias("blocks"), F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low != _high").select("band", "key", "blocks")
    inside = scratch.written(now.join(mixed, ["band", "key"]).select("band", "key", "node", "n", "label", "blocks"), "inside")
    more = scratch.written(links_within_buckets(inside.join(everyone.select("node", "tuples"), "node").join(words, "node")), "bucket-links")
    # a class found before is a star of its label, so its links are not met again
    labels = labels if more.isEmpty() else components(labels.select(F.col("label").alias("a"), F.col("node").alias("b")).union(more))
    scratch.clear()
    return labels


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, label, class_id of every row. Least ids are taken by text, then by class, so copies collapse before any join."""
    rows = docs.select("doc_id", text_key().alias("node"))
    labels = classes(docs)
    least = written(rows.groupBy("node").agg(F.min("doc_id").alias("class_id")), "least")
    if labels is None:
        by_node = least.select("node", F.col("node").alias("label"), "class_id")
    else:
        linked = labels.join(least, "node").groupBy("label").agg(F.min("class_id").alias("_class"))
        by_node = least.join(labels, "node", "left").join(linked, "label", "left").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("_class", "class_id").alias("class_id"))
    return rows.join(by_node, "node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, keep (it has the class id)."""
    return _classes(docs.select("doc_id", "text")).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("keep"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one of each class, with their own columns: the one of least doc_id (one row of it where rows repeat)."""
    marked = written(_classes(docs.select("doc_id", "text")), "classes")
    same = F.col("doc_id").eqNullSafe(F.col("class_id"))
    key, gone = "node of a row", "node that goes"  # names that no column of a table is likely to have
    dropped = bounded(written(marked.where(~same).select(F.col("doc_id").alias("id that goes"), F.col("node").alias(gone)).distinct(), "dropped"))
    survivors = docs.withColumn(key, text_key())
    survivors = survivors.join(dropped, (F.col(key) == F.col(gone)) & docs["doc_id"].eqNullSafe(dropped["id that goes"]), "left_anti")
    # several rows of a class may carry its id: repeated rows, and repeated ids with other text
    kept = marked.where(same).groupBy("label").agg(F.min("node").alias(gone), F.count("*").alias("_rows"))
    if not kept.where("_rows > 1").isEmpty():
        survivors = survivors.join(kept.select(gone), F.col(key) == F.col(gone), "left_semi").dropDuplicates(["doc_id", key])
    return survivors.select(*docs.columns)
