"""Alignment of two tokenizers over the same bytes, by a dictionary of groups.

Both tokenizers' ids of a text cover the same bytes. Offsets where tokens of both
end cut them into groups, a few ids of A beside a few ids of B; how the tokens of
a group overlap depends on its ids only. So each distinct group is interned, its
links (overlapping pairs of one token of A and one of B) are expanded once and
multiplied by how often the group occurs, and what the corpus knows of its links
is joined back by the group's key.

Texts are cut into cells, before a blank that follows anything but white space:
no pretoken of the byte-level pattern and no piece goes across such a place (the
pieces are looked through for one that does), so a cell has the same ids alone as
in its text. Each distinct cell is encoded once a worker. A text that holds a
cell whose tokens don't give back its bytes is encoded as a whole and compared.

Documents are dealt in chunks of about CHUNK_CHARS; a chunk has a dictionary of
its cells and groups, and its documents keep the numbers of their cells. A group
is one row a chunk in the shuffle by its key, however often it occurs, and the
answers go back to the chunk, not to each document.

Defined results: texts that are null or empty, or whose joined tokens of either
side are not a blank and the text, have no tokens and zeros; repeated rows each
count; null ids are rows like others; an empty table gives an empty result. The
columns of the table but the text are kept; where names clash the result's get
an underscore.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factframe.llm.common import Scratch, bounded, carried, free_name, with_row
from factframe.llm.hashing import chunks

#: Characters of text to a chunk; cells that a worker remembers between chunks.
CHUNK_CHARS = 1 << 23
REMEMBERED = 400_000
PART_CHARS = 1 << 18
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
_WIDE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def cells_of(text: str) -> list[str]:
    """The cells of a blank and the text, each without the blank it begins with."""
    whole = " " + text
    if _WIDE.search(whole) is None:
        return text.split(" ")
    return [c[1:] for c in _CUT.split(whole)]


def links_of(a: list[int], b: list[int], size_a: np.ndarray, size_b: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a group whose byte ranges overlap: each token meets the next one of the other side."""
    out, i, j, end_a, end_b = [], 0, 0, int(size_a[a[0]]), int(size_b[b[0]])
    while True:
        out.append((a[i], b[j]))
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a:
            i += 1
        if step_b:
            j += 1
        if i == len(a) or j == len(b):
            return out
        if step_a:
            end_a += int(size_a[a[i]])
        if step_b:
            end_b += int(size_b[b[j]])


def group_key(a: list[int], b: list[int]) -> bytes:
    return np.array([len(a), *a, *b], "<i4").tobytes()


def read_key(key: bytes) -> tuple[list[int], list[int]]:
    n, *ids = np.frombuffer(key, "<i4").tolist()
    return ids[:n], ids[n:]


class Pair:
    """Both tokenizers; token bytes by id."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in set(plain)]
        back = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(back[c] for c in n) if all(c in back for c in n) else n.encode() for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id("▁")
        #: No piece goes on with a blank after something else; otherwise texts are not cut.
        self.cuts = not any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not self.b.is_byte(i))

    def encode(self, cells: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of either side for a blank and each text, and whether both give back its bytes."""
        wholes = [" " + c for c in cells]
        a = [e.ids for e in self.a.encode_batch_fast(wholes, add_special_tokens=False)]
        # the library gives nothing for nothing
        b = [ids or [self.blank] for ids in self.b.encode(cells, num_threads=1)]
        raw = [w.encode() for w in wholes]
        joined = b"".join(raw)
        sizes = np.array([*map(len, raw)], np.int64)
        good = np.ones(len(cells), bool)
        for ids, pieces, size in ((a, self.bytes_a, self.size_a), (b, self.bytes_b, self.size_b)):
            flat = [*chain.from_iterable(ids)]
            ends = np.cumsum([*map(len, ids)])
            good &= np.diff(np.append(0, np.cumsum(size[flat]))[ends], prepend=0) == sizes
            if not good.all() or b"".join([pieces[i] for i in flat]) != joined:
                good &= [b"".join([pieces[i] for i in x]) == r for x, r in zip(ids, raw, strict=True)]
        return a, b, good.tolist()


class Growing:
    """Whole numbers that are added to, with room to spare."""

    def __init__(self):
        self.n, self._held = 0, np.zeros(1 << 12, np.int64)

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self._held):
            self._held = np.append(self._held[: self.n], np.zeros(2 * end - self.n, np.int64))
        self._held[self.n : end] = values
        self.n = end

    @property
    def values(self) -> np.ndarray:
        return self._held[: self.n]


class Dictionary:
    """Distinct cells and groups that a worker has met."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        # of each cell: ids of A, ids of B, groups, where its groups begin among all
        self.n_a, self.n_b, self.n_groups, self.first, self.held = (Growing() for _ in range(5))
        self.numbers_of: dict[int | bytes, int] = {}
        self.keys: list[bytes] = []
        self.strings: list[str] = []  # of each group

    def _group(self, name: int | bytes, a: list[int], b: list[int]) -> int:
        number = self.numbers_of.setdefault(name, len(self.keys))
        if number == len(self.keys):
            self.keys.append(group_key(a, b))
            self.strings.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
        return number

    def learn(self, cells: list[str]) -> None:
        """Number new cells; -1 for those without tokens. Groups lie between offsets where ids of both end."""
        ids_a, ids_b, good = self.pair.encode(cells)
        for cell, fine in zip(cells, good, strict=True):
            if not fine:
                self.known[cell] = -1
        kept = [i for i, fine in enumerate(good) if fine]
        if not kept:
            return
        a, b = (np.array([*chain.from_iterable([ids[i] for i in kept])], np.int64) for ids in (ids_a, ids_b))
        n_a, n_b = (np.array([len(ids[i]) for i in kept], np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.pair.size_a[a]), np.cumsum(self.pair.size_b[b])
        cuts, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        owner = np.searchsorted(ends_a[np.cumsum(n_a) - 1], cuts)
        count_a, count_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        single = (count_a == 1) & (count_b == 1)
        groups = np.empty(len(cuts), np.int64)
        names, back = np.unique(a[last_a[single]] << 32 | b[last_b[single]], return_inverse=True)
        groups[single] = np.array([self._group(x, [x >> 32], [x & 0xFFFFFFFF]) for x in names.tolist()], np.int64)[back]
        for g in np.flatnonzero(~single).tolist():
            x, y = a[last_a[g] + 1 - count_a[g] : last_a[g] + 1], b[last_b[g] + 1 - count_b[g] : last_b[g] + 1]
            groups[g] = self._group(x.tobytes() + b"|" + y.tobytes(), x.tolist(), y.tolist())
        per_cell = np.bincount(owner, minlength=len(kept))
        begin = self.held.n + np.cumsum(per_cell) - per_cell
        self.known.update(zip([cells[i] for i in kept], range(self.n_a.n, self.n_a.n + len(kept)), strict=True))
        for column, values in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, per_cell), (self.first, begin), (self.held, groups)):
            column.add(values)

    def groups(self, cells: np.ndarray) -> np.ndarray:
        """The groups of these cells, one after another."""
        sizes = self.n_groups.values[cells]
        ends = np.cumsum(sizes)
        return self.held.values[np.repeat(self.first.values[cells] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]

    def numbers(self, texts: list[str | None]) -> list[list[int]]:
        """The cells of each text by number; none for a text without tokens."""
        split = [[] if not t else cells_of(t) if self.pair.cuts else [t] for t in texts]
        known = self.known
        new = {c for cells in split for c in cells if c not in known}
        if new:
            self.learn([*new])
        out = []
        for text, cells in zip(texts, split, strict=True):
            mine = [known[c] for c in cells]
            if -1 in mine:
                # no cell of its own may be at fault, but all together: the whole text decides
                if text not in known:
                    self.learn([text])
                mine = [] if known[text] < 0 else [known[text]]
            out.append(mine)
        return out


_dictionaries: dict[tuple[str, str], Dictionary] = {}


def dictionary(path_a: str, path_b: str) -> Dictionary:
    """One for each Python worker."""
    key = (path_a, path_b)
    if key not in _dictionaries:
        _dictionaries[key] = Dictionary(Pair(path_a, path_b))
    return _dictionaries[key]


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return raw.reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


class Chunk:
    """Numbers of its own for the cells and groups that its documents hold, and how often each group occurs."""

    def __init__(self, words: Dictionary):
        self.words = words
        self.place, self.uses, self.cells = Growing(), Growing(), Growing()
        self.chars = 0

    def local(self, numbers: np.ndarray) -> np.ndarray:
        more = self.words.n_a.n - self.place.n
        if more > 0:
            self.place.add(np.full(more, -1, np.int64))
            self.uses.add(np.zeros(more, np.int64))
        distinct, times = np.unique(numbers, return_counts=True)
        self.uses.values[distinct] += times
        new = distinct[self.place.values[distinct] < 0]
        self.place.values[new] = self.cells.n + np.arange(len(new))
        self.cells.add(new)
        return self.place.values[numbers]

    def close(self) -> tuple[list[bytes], np.ndarray, bytes]:
        """Keys of its groups, how often each occurs, and the groups of each cell (sizes, then numbers)."""
        cells = self.cells.values
        sizes = self.words.n_groups.values[cells]
        groups, local = np.unique(self.words.groups(cells), return_inverse=True)
        often = np.bincount(local, weights=np.repeat(self.uses.values[cells], sizes), minlength=len(groups)).astype(np.int64)
        return [self.words.keys[g] for g in groups.tolist()], often, _packed(np.concatenate(([len(sizes)], sizes, local)))


def tokenized(docs: DataFrame, path_a: str, path_b: str, text: str, groups: bool = False) -> DataFrame:
    """A row a document (its other columns, counts, digest or whole string of groups, cells) and, where `keys` is not null, a row a chunk (its dictionary)."""
    rows = docs.select(carried(docs, text), F.col(f"`{text}`").alias("text"))
    names = ["_row", "chunk", "n_a", "n_b", "n_groups", "groups", "cells", "keys", "often"]
    shape = with_row(rows, "chunk long, n_a long, n_b long, n_groups long, groups string, cells binary, keys array<binary>, often array<long>")

    def run(batches: Iterator[pa.RecordBatch]):
        words, part, seq = dictionary(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        chunk, row_type = None, None

        def closing():
            keys, often, cells = chunk.close()
            lists = [pa.array([keys], pa.list_(pa.binary())), pa.array([often.tolist()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.nulls(1, row_type), pa.array([part + seq], pa.int64()), *[pa.array([0], pa.int64())] * 3, pa.array([""]), pa.array([cells], pa.binary()), *lists], names=names)

        for batch, texts in chunks(batches, limit=PART_CHARS):
            if chunk is None:
                if len(words.known) > REMEMBERED:
                    words.forget()
                chunk, row_type = Chunk(words), batch.schema.field(0).type
            found = words.numbers(texts)
            sizes = np.array([*map(len, found)], np.int64)
            flat, ends = np.array([*chain.from_iterable(found)], np.int64), np.cumsum(sizes)
            local = chunk.local(flat)
            totals = [np.diff(np.append(0, np.cumsum(column.values[flat]))[ends], prepend=0) for column in (words.n_a, words.n_b, words.n_groups)]
            names_of, last = [words.strings[g] for g in words.groups(flat).tolist()], np.cumsum(totals[2])
            strings = [";".join(names_of[e - n : e]) for e, n in zip(last.tolist(), totals[2].tolist(), strict=True)]
            told = strings if groups else [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in strings]
            packed = [_packed(local[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            columns = [batch.column(0), pa.array(np.full(len(batch), part + seq)), *map(pa.array, totals)]
            empty = [pa.nulls(len(batch), pa.list_(pa.binary())), pa.nulls(len(batch), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(told, pa.string()), pa.array(packed, pa.binary()), *empty], names=names)
            chunk.chars += sum(len(t) for t in texts if t)
            if chunk.chars >= CHUNK_CHARS:
                yield closing()
                chunk, seq = None, seq + 1
        if chunk is not None:
            yield closing()

    return rows.mapInArrow(run, shape)


def expanded_links(groups: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """key, often, a, b, times: the links of each distinct group, once."""

    def expand(batches: Iterator[pa.RecordBatch]):
        pair = dictionary(path_a, path_b).pair
        for batch in batches:
            out: list = []
            for key, often in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                times: dict[tuple[int, int], int] = {}
                for link in links_of(*read_key(key), pair.size_a, pair.size_b):
                    times[link] = times.get(link, 0) + 1
                out += [(key, often, *link, n) for link, n in times.items()]
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "often", "a", "b", "times"])

    return groups.mapInArrow(expand, "key binary, often long, a int, b int, times long")


class Alignment:
    """Tables of an aligned corpus in the shared folder: documents and chunks, links of distinct groups, counts of pairs."""

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, text: str = "text", groups: bool = False):
        self.columns = [c for c in docs.columns if c != text]
        scratch, self.whole = Scratch(docs.sparkSession), groups
        self.rows = scratch.written(tokenized(docs, path_a, path_b, text, groups), "aligned")
        listed = self.rows.where("keys is not null").select("chunk", F.posexplode(F.arrays_zip("keys", "often")).alias("place", "g"))
        self.entries = listed.select("chunk", "place", F.col("g.keys").alias("key"), F.col("g.often").alias("often"))
        self.distinct = self.entries.groupBy("key").agg(F.sum("often").alias("often"))
        self.links = scratch.written(expanded_links(self.distinct, path_a, path_b), "links")
        counted = self.links.groupBy("a", "b").agg(F.sum(F.col("often") * F.col("times")).alias("count"))
        # an id of B meets at most as many ids as A has
        best = F.max("count").over(Window.partitionBy("b"))
        #: a, b, count (links of the whole corpus that hold the pair), best (no other id of A meets b more often).
        self.pairs = scratch.written(counted.withColumn("best", F.col("count") == best), "pairs")

    def documents(self) -> DataFrame:
        """The table's other columns, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (or `groups`, the whole string)."""
        times, count = F.col("times"), F.col("count")
        known = self.links.join(bounded(self.pairs), ["a", "b"]).groupBy("key").agg(F.sum(times).alias("n_links"), F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * count).alias("count_sum"))
        answers = self.entries.join(known, "key").select(F.col("chunk").alias("of"), "place", "n_links", "n_best", "count_sum")
        held = self.rows.select("_row", "chunk", "n_a", "n_b", "n_groups", "groups", "cells", F.col("keys").isNotNull().alias("_dictionary"))
        counts = ["n_links", "n_best", "count_sum"]

        def back(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            place = left.column("place").to_numpy()
            at = {c: np.zeros(len(place), np.int64) for c in counts}
            for c in counts:
                at[c][place] = left.column(c).to_numpy()
            listed = right.column("_dictionary").to_numpy(zero_copy_only=False)
            table = _unpacked(right.filter(pa.array(listed)).column("cells")[0].as_py())
            sizes, groups = table[1 : 1 + table[0]], table[1 + table[0] :]
            ends = np.cumsum(sizes)
            mine = right.filter(pa.array(~listed))
            cells = [_unpacked(x) for x in mine.column("cells").to_pylist()]
            out = {c: mine.column(c) for c in ("_row", "n_a", "n_b", "n_groups", "groups")}
            for c in counts:
                total = np.append(0, np.cumsum(at[c][groups]))
                by_cell = total[ends] - total[ends - sizes]
                out[c] = pa.array([int(by_cell[x].sum()) for x in cells], pa.int64())
            return pa.table(out)

        shape = with_row(held, "n_a long, n_b long, n_groups long, groups string, n_links long, n_best long, count_sum long")
        both = answers.groupBy("of").cogroup(held.groupBy("chunk")).applyInArrow(back, shape)
        names = {c: c for c in RESULTS} | ({"groups_sha256": "groups"} if self.whole else {})
        own = [F.col("_row").getField(c).alias(c) for c in self.columns]
        probe = both.select(*own)
        return both.select(*own, *[F.col("groups" if c == "groups_sha256" else c).alias(free_name(probe, names[c])) for c in RESULTS])
