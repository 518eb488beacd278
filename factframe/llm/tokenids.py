"""Token ids in files under a canonical, length-limited Huffman code.

Tokenising runs once: ids are stored as compressed columns in the shared
folder, each task with its counts beside them, and one code over all ids (at
most MOST_BITS bits a code, optimal under that limit) is agreed. Documents are
dealt by ranges of their ids and sorted, still compressed; each range becomes a
file of independent blocks of BLOCK ids. A block begins at a byte and its bit
offset is its checkpoint, so any block can be decoded alone. Decoding looks
MOST_BITS bits up in one table and advances all blocks of a task together.

A file can be read with nothing but itself: MAGIC, the code's lengths, the
blocks, then a table of its documents (id, number of ids, place, checkpoints)
whose place is the file's last eight bytes. A folder lists its files, in order,
in `manifest`; files of retried tasks that it doesn't name are not read.

Pretokens: text is split by the byte-level tokenizer's published pattern with
array operations over code points; each distinct pretoken is encoded by the
tokenizers library once per worker. Remembered ones are found by two hashes and
then compared code point by code point; a text in which one differs goes to the
library as a whole. Classes of characters are asked of the library's own
splitting. Texts with the content of an added token go to the library as a whole
too; results are those of its encode(text, add_special_tokens=False) either way.

Defined results: a null text is empty; every document ends with the end id; rows
that repeat an id are adjacent documents in an order fixed by their ids' bytes;
null ids come first; an empty table writes no file. Ids are below 65,536: a
tokenizer with more raises an error.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factframe.llm.common import fresh_path, written
from factframe.llm.files import Folder
from factframe.llm.hashing import chunks, mix

END_ID = 0
BLOCK = 1_024
MOST_BITS = 16
FILE_IDS = 8_000_000
REMEMBERED, COUNTING = 1_200_000, 150_000
#: Ids coded or decoded at a time, and files to a section of the running sum.
TASK_IDS = 400_000
SECTION = 4_096
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_UNKNOWN = 255
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
# Fixed values of the published byte-level pattern: what may follow an apostrophe as a token of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class Memory:
    """An open-addressing table from two hashes of a pretoken to its place among those remembered."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys, self.checks = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is not known."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slots[slot]
        left = np.flatnonzero((found >= 0) & ((self.keys[found] != keys) | (self.checks[found] != checks)))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            found[left] = here = self.slots[slot[left]]
            left = left[(here >= 0) & ((self.keys[here] != keys[left]) | (self.checks[here] != checks[left]))]
        return found

    def add(self, keys: np.ndarray, checks: np.ndarray) -> None:
        """Keys not known yet and all different; they take the next places."""
        end = self.n + len(keys)
        if end > len(self.keys):
            self.keys, self.checks = (np.resize(x, 1 << int(end).bit_length()) for x in (self.keys, self.checks))
        self.keys[self.n : end], self.checks[self.n : end] = keys, checks
        first, self.n = self.n, end
        if 2 * end > len(self.slots):
            self.bits = int(2 * end).bit_length()
            self.slots = np.full(1 << self.bits, -1, np.int32)
            first = 0
        place = np.arange(first, end, dtype=np.int32)
        slot = (self.keys[first:end] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(place):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = place[free]
            lost = self.slots[slot] != place
            place, slot = place[lost], (slot[lost] + 1) & (len(self.slots) - 1)


class Encoder:
    """The library's ids for whole texts, with a memory of at most about `remembered` pretokens."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.remembered = Tokenizer.from_file(path), remembered
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids of 16 bits can't hold a vocabulary of more than 65,536")
        self.letters = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self.forget()
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * len(_BASES)

    def forget(self) -> None:
        self.memory = Memory()
        self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint16)
        # code points of those remembered, one after another
        self.points, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _class(self, point: int) -> int:
        """The pattern's class of a code point, as the library's own splitting shows it: does it join a letter, a digit, a mark?"""
        split = self.library.pre_tokenizer.pre_tokenize_str
        for kind, beside in ((_LETTER, "a"), (_DIGIT, "1"), (_OTHER, "!")):
            if len(split(beside + chr(point))) == 1:
                return kind
        return _SPACE

    def _learn(self, hashes: list[np.ndarray], words: list[str]) -> None:
        tokenize, letters = self.model.tokenize, self.letters
        found = [[t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))] for w in words]
        count = np.array([*map(len, found)], np.int64)
        flat = np.array([*chain.from_iterable(found)], np.uint16)
        self.memory.add(*hashes)
        self.first = np.concatenate([self.first, (len(self.flat) + np.cumsum(count) - count).astype(np.int32)])
        self.count, self.flat = np.concatenate([self.count, count.astype(np.int32)]), np.concatenate([self.flat, flat])
        size = np.array([*map(len, words)], np.int64)
        self.at = np.concatenate([self.at, len(self.points) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.points = np.concatenate([self.points, np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)])

    def _spans(self, points: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pretokens begin: texts' begins, changes of class, how spaces go with what follows, and contractions."""
        n = len(points)
        first = np.zeros(n + 3, bool)
        first[begins] = True
        first[n:] = True
        start = first[: n + 1].copy()
        start[1:n] |= kinds[1:] != kinds[:-1]
        # the last of a run of white space stands alone, or joins what follows if it is a blank
        space = kinds == _SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        quote = np.flatnonzero((points == 39) & start[:n])
        if len(quote):
            padded = np.concatenate([points, np.zeros(3, np.uint32)])
            for tail in CONTRACTIONS:
                fits = np.ones(len(quote), bool)
                for k, c in enumerate(tail, 1):
                    fits &= (padded[quote + k] == ord(c)) & ~first[quote + k]
                at = quote[fits]
                start[at + 1] = False
                start[at + 1 + len(tail)] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list = [np.zeros(0, np.uint16)] * len(texts)
        whole = [bool(t) and any(a in t for a in self.added) for t in texts]
        plain = [i for i, t in enumerate(texts) if t and not whole[i]]
        for i, ids in zip(plain, self._encode([texts[i] for i in plain]) if plain else [], strict=True):
            out[i] = ids
        for i, t in enumerate(texts):
            if whole[i]:
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint16)
        return out

    def _hashes(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Two hashes of each span, of different polynomials."""
        out, values = [], points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(12345)
        for k, base in enumerate(_BASES):
            if len(self.powers[k][0]) <= len(points):
                pair = []
                for step in (base, pow(base, -1, 1 << 64)):
                    steps = np.full(len(points) + 1, step, np.uint64)
                    steps[0] = 1
                    pair.append(np.cumprod(steps, dtype=np.uint64))
                self.powers[k] = tuple(pair)
            up, down = self.powers[k]
            total = np.zeros(len(points) + 1, np.uint64)
            np.cumsum(values * up[: len(points)], out=total[1:])
            out.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without added tokens."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        kinds = self.classes[points]
        if (kinds == _UNKNOWN).any():
            for c in np.unique(points[kinds == _UNKNOWN]).tolist():
                self.classes[c] = self._class(c)
            kinds = self.classes[points]
        edges = self._spans(points, kinds, begins)
        start, end = edges[:-1], edges[1:]
        hashes = self._hashes(points, start, end)
        if self.memory.n > self.remembered:
            self.forget()
        at = self.memory.find(*hashes)
        whole = None
        while len(missing := np.flatnonzero(at < 0)):
            _, where = np.unique(hashes[0][missing] ^ (hashes[1][missing] << np.uint64(1)), return_index=True)
            where = missing[where]
            whole = whole or "".join(texts)
            self._learn([h[where] for h in hashes], [whole[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            at[missing] = self.memory.find(*(h[missing] for h in hashes))
        wrong = self._differ(points, start, end, at)
        count = self.count[at].astype(np.int64)
        stop = np.cumsum(count)
        index = np.repeat(self.first[at] - (stop - count), count) + np.arange(stop[-1])
        ids = self.flat[index]
        cuts = np.concatenate(([0], stop))[np.append(np.searchsorted(start, begins), len(start))]
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i in np.unique(np.searchsorted(begins, start[wrong], side="right") - 1).tolist():
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint16)
        return out

    def _differ(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Spans that are not what they were found as: their hashes agree, their code points don't."""
        size = end - start
        short = self.size[at] != size
        if short.any():
            size = np.where(short, 0, size)
            same = np.repeat(~short, end - start)
            points = points[same]
        place = np.cumsum(size) - size
        other = np.flatnonzero(self.points[np.repeat(self.at[at] - place, size) + np.arange(len(points))] != points)
        return np.union1d(np.flatnonzero(short), np.searchsorted(place, other, side="right") - 1) if len(other) else np.flatnonzero(short)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, so that later tasks know the pretokens of earlier ones."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (compressed 16-bit, low bytes then high bytes), n: ids with the end id, whole texts.

    Each task ends with one row of `counts`, how often it has met each id; ids is null there.
    """
    counted = pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())]))

    def encode(batches: Iterator[pa.RecordBatch]):
        squeeze, names = zstandard.ZstdCompressor(level=1), ["doc_id", "ids", "n", "counts"]
        total = np.zeros(1 << 16, np.int64)
        end = np.array([END_ID], np.uint16)
        for batch, texts in chunks(batches, limit=1 << 18):
            found = encoder(path).encode(texts)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
            together = np.concatenate([x for ids in found for x in (ids, end)])
            total += np.bincount(together, minlength=1 << 16)
            planes = np.ascontiguousarray(together.view(np.uint8).reshape(-1, 2).T)
            cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
            packed = [squeeze.compress(planes[:, a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(packed, pa.binary()), pa.array(sizes), pa.nulls(len(sizes), counted)], names=names)
        used = np.flatnonzero(total)
        row = pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), pa.StructArray.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"]))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([0], pa.int64()), row], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids binary, n long, counts array<struct<id:int,n:long>>")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, length: how many ids each whole text has; a null or empty text has none.

    Each task has an encoder of its own, of a small memory, so that nothing stays in the worker.
    """

    def count(batches: Iterator[pa.RecordBatch]):
        mine = Encoder(path, COUNTING)
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in mine.encode(texts)], pa.int64())], names=["doc_id", "length"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, length long")


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return raw.reshape(2, -1).T.copy().view(np.uint16).ravel()


def global_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in the whole corpus; 65,536 numbers at most."""
    out = np.zeros(1 << 16, np.int64)
    each = tokens.where("counts is not null").select(F.explode("counts").alias("c")).select("c.id", "c.n")
    for r in each.groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most `most` bits, by package-merge: 2n - 2 of the lightest items over `most` levels of coins."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << most:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, leaves = weights, []
    for _ in range(most - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        leaves.append(rank < n)
    take, found = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in leaves[::-1]:
        own = int(leaf[:take].sum())
        found[:own] += 1
        take = 2 * (take - own)
    found[:take] += 1
    lengths[order] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def encode_blocks(documents: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """For each document the bytes of its blocks, and the byte offset at which each block begins."""
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    ids = np.concatenate(documents)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(documents)), blocks)
    order = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = np.repeat(np.cumsum(sizes) - sizes, blocks) + order * BLOCK  # of each block
    held = np.minimum(BLOCK, sizes[owner] - order * BLOCK)
    width = lengths[ids].astype(np.int64)
    total = np.concatenate(([0], np.cumsum(width)))
    size = (total[first + held] - total[first] + 7) // 8
    begin = np.cumsum(size) - size
    at = total[:-1] + np.repeat(begin * 8 - total[first], held)  # first bit of each code
    out = np.zeros(int(size.sum()) + 3, np.uint8)
    # a code of at most 16 bits lies within 3 bytes: place it in a 24-bit window and add by byte
    window = codes[ids] << (24 - (at & 7) - width).astype(np.uint32)
    byte = at >> 3
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount(byte + k, weights=(window >> np.uint32(shift)) & np.uint32(255), minlength=len(out)).astype(np.uint8)
    data = out.tobytes()
    cut = np.concatenate(([0], np.cumsum(blocks)))
    edge = np.append(begin, len(data) - 3)
    return [(data[edge[a] : edge[b]], begin[a:b] - edge[a]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def decoding_table(lengths: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every value of the next `most` bits."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    span = (1 << (most - lengths[used].astype(np.int64)))
    symbol = np.repeat(used, span).astype(np.uint16)
    width = np.repeat(lengths[used], span)
    short = (1 << most) - len(symbol)
    return np.append(symbol, np.zeros(short, np.uint16)), np.append(width, np.ones(short, np.uint8))


def decode_blocks(data: bytes, begin: np.ndarray, count: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Decode all blocks at once, one id of each at a step; `begin` are bit offsets, `count` ids in each block."""
    symbol, width = table
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    three = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    order = np.argsort(-count, kind="stable")
    at, left = begin[order].astype(np.int64), count[order]
    out = np.zeros((int(left[0]) if len(left) else 0, len(order)), np.uint16)
    alive = np.searchsorted(-left, -np.arange(1, len(out) + 1), side="right")
    for step in range(len(out)):
        k = alive[step]
        bits = at[:k]
        peek = (three[bits >> 3] >> (8 - (bits & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[step, :k] = symbol[peek]
        at[:k] += width[peek]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return out[rows, np.repeat(place, count)]


MAGIC = b"IDS2"
_TABLE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("checkpoints", pa.list_(pa.int64()))])


def file_head(lengths: np.ndarray) -> bytes:
    """MAGIC, the size of what follows, the compressed code lengths of all ids."""
    packed = zstandard.ZstdCompressor(level=3).compress(lengths.tobytes())
    return MAGIC + len(packed).to_bytes(4, "little") + packed


def file_tail(batches: list[pa.RecordBatch], at: int) -> bytes:
    """The table of documents, compressed, and the place `at` where it begins."""
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, _TABLE) as stream:
        for batch in batches:
            stream.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue()) + at.to_bytes(8, "little")


def read_head(source: Folder, name: str) -> np.ndarray:
    head = source.read(name, 0, 8)
    if head[:4] != MAGIC:
        raise ValueError(f"{name} is no file of ids")
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(name, 8, int.from_bytes(head[4:], "little"))), np.uint8)


def read_tail(source: Folder, name: str) -> pa.Table:
    size = source.size(name)
    at = int.from_bytes(source.read(name, size - 8, 8), "little")
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompressobj().decompress(source.read(name, at, size - 8 - at))).read_all()


def write_files(tokens: DataFrame, lengths: np.ndarray, folder: str) -> None:
    """A file for each range of ids, in order, and the folder's manifest: part, file, ids and documents of it.

    Rows are dealt by ranges of (id, hash of the ids), so rows that repeat an id
    or have none spread over files too.
    """
    rows = tokens.where("counts is null").select("doc_id", "ids", "n", F.xxhash64("ids").alias("_h"))
    files = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // FILE_IDS))
    shared = tokens.sparkSession.sparkContext.broadcast((canonical_codes(lengths), lengths))

    def write(batches: Iterator[pa.RecordBatch]):
        codes, lengths = shared.value
        out, name, at, ids, table = None, "", 0, 0, []
        for batch in batches:
            sizes, begin = batch.column(2).to_numpy(), 0
            while begin < len(batch):
                end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), TASK_IDS, side="right")))
                documents = [unpack(x) for x in batch.column(1).slice(begin, end - begin).to_pylist()]
                packed = encode_blocks(documents, codes, lengths)
                if out is None:
                    name, out = Folder(folder).create(".ids")
                    head = file_head(lengths)
                    out.write(head)
                    at = len(head)
                out.write(b"".join(p[0] for p in packed))
                held = np.array([len(p[0]) for p in packed], np.int64)
                ends = np.cumsum(held)
                n = batch.column(2).slice(begin, end - begin)
                columns = [batch.column(0).slice(begin, end - begin), n, pa.array(at + ends - held), pa.array(held), pa.array([(p[1] * 8).tolist() for p in packed], pa.list_(pa.int64()))]
                table.append(pa.RecordBatch.from_arrays(columns, schema=_TABLE))
                at, ids, begin = at + int(ends[-1]), ids + int(sizes[begin:end].sum()), end
        if out is not None:
            out.write(file_tail(table, at))
            out.close()
            part = [[TaskContext.get().partitionId()], [name], [ids], [sum(map(len, table))]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(part, [pa.int32(), pa.string(), pa.int64(), pa.int64()], strict=True)], names=["part", "file", "n", "documents"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("ids")]
    dealt = rows.repartitionByRange(files, *order[:2]).sortWithinPartitions(*order)
    dealt.select("doc_id", "ids", "n").mapInArrow(write, "part int, file string, n long, documents long").write.parquet(f"{folder}/manifest")


def decoded(spark: SparkSession, folder: str) -> Iterator:
    """The manifest of a folder, and a function that yields (table of documents, ids of all of them) of one of its files, some documents at a time."""
    manifest = spark.read.schema("part int, file string, n long, documents long").parquet(f"{folder}/manifest")

    def read(source: Folder, name: str):
        table, rows = decoding_table(read_head(source, name)), read_tail(source, name)
        sizes, begin = rows.column("n").to_numpy(), 0
        while begin < len(rows):
            end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), TASK_IDS, side="right")))
            some = rows.slice(begin, end - begin)
            offset, size = some.column("offset").to_numpy(), some.column("size").to_numpy()
            data = source.read(name, int(offset[0]), int(offset[-1] + size[-1] - offset[0]))  # documents are adjacent
            points = some.column("checkpoints").combine_chunks()
            blocks = np.diff(points.offsets.to_numpy())
            n = np.repeat(sizes[begin:end], blocks)
            order = np.arange(len(n)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            bits = points.flatten().to_numpy() + 8 * np.repeat(offset - offset[0], blocks)
            yield some, decode_blocks(data, bits, np.minimum(BLOCK, n - BLOCK * order), table)
            begin = end

    return manifest, read


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files of the folder alone."""
    manifest, read = decoded(spark, folder)
    # ids of earlier files: one row a file, summed up within sections of files and then over the sections
    section = F.floor(F.col("part") / SECTION)
    parts = manifest.withColumn("_section", section)
    sections = parts.groupBy("_section").agg(F.sum("n").alias("_all"))
    sections = sections.select("_section", (F.sum("_all").over(Window.orderBy("_section")) - F.col("_all")).alias("_outer"))
    inner = F.sum("n").over(Window.partitionBy("_section").orderBy("part")) - F.col("n")
    placed = parts.withColumn("_inner", inner).join(sections, "_section").select("part", "file", (F.col("_outer") + F.col("_inner")).alias("before"))
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]):
        source = Folder(folder)
        for batch in batches:
            for name, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for some, ids in read(source, name):
                    raw, n = ids.astype("<u4"), some.column("n").to_numpy()
                    cut = np.append(0, np.cumsum(n))
                    sums = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([some.column("doc_id").combine_chunks(), pa.array(before + cut[:-1]), pa.array(n), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    before += int(cut[-1])

    dealt = placed.repartitionByRange(files, "part").select("part", "file", "before")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids of every document."""
    manifest, read = decoded(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]):
        source = Folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for some, ids in read(source, name):
                    offsets = np.append(0, np.cumsum(some.column("n").to_numpy()))
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([some.column("doc_id").combine_chunks(), lists], names=["doc_id", "ids"])

    return manifest.repartitionByRange(max(1, manifest.count()), "part").select("file").mapInArrow(run, "doc_id long, ids array<int>")


def encode_corpus(docs: DataFrame, path: str) -> DataFrame:
    """Tokenise, count, write and read back."""
    spark = docs.sparkSession
    tokens = written(tokenize(docs, path), "tokens")
    folder = fresh_path(spark, "ids")
    write_files(tokens, code_lengths(global_counts(tokens)), folder)
    return read_files(spark, folder)
