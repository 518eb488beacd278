"""Vectorised text hashing for Arrow batches.

A batch of texts is laid out as one lower-cased UTF-8 buffer; tokens are found
by comparing neighbouring byte classes and hashed with a prefix polynomial, so
there is no Python object and no Python loop per token.

Token rule (the same everywhere in this package): a *word* is a maximal run of
letters, digits, underscore or non-ASCII bytes; a *mark* is a maximal run of
other non-space bytes. Case is folded with str.lower().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE, WORD, MARK = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters laid out at a time: its arrays stay within a core's cache.
CHUNK_BYTES = 1 << 17


def _classes() -> np.ndarray:
    out = np.full(256, MARK, dtype=np.uint8)
    out[128:] = WORD
    for c in range(128):
        if chr(c).isalnum() or chr(c) == "_":
            out[c] = WORD
        elif c <= 32 or c == 127:
            out[c] = SPACE
    return out


CLASS = _classes()
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hash columns."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


class Tokens:
    """Tokens of several texts: document index, hash, byte span, whether a word."""

    __slots__ = ("docs", "doc", "hash", "start", "end", "word", "buf", "_prefix")

    def __init__(self, texts: list[str | None], marks: bool = False):
        raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        self.docs = len(raw)
        buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw)))
        kind = CLASS[buf]
        if not marks:
            kind = (kind == WORD).astype(np.uint8)
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        bounds = np.concatenate(([0], edge, [len(kind)]))
        keep = kind[bounds[:-1]] != SPACE
        self.start, self.end = bounds[:-1][keep], bounds[1:][keep]
        self.word = kind[self.start] == WORD
        self.doc = np.searchsorted(ends, self.start, side="right").astype(np.int32)
        prefix = np.empty(len(buf) + 1, dtype=np.uint64)
        prefix[0] = 0
        np.cumsum(_TABLE[buf] * _power("up", _BASE, len(buf)), out=prefix[1:])
        self._prefix, self.buf = prefix, buf
        self.hash = self.span(self.start, self.end)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = _power("down", _INVERSE, len(self._prefix))
        return mix((self._prefix[end] - self._prefix[start]) * down[start] + (end - start).astype(np.uint64))

    def per_doc(self) -> np.ndarray:
        """Offsets of the tokens of each document, docs + 1 of them."""
        return np.searchsorted(self.doc, np.arange(self.docs + 1))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k tokens; one hash of the whole if there are fewer."""
    if len(hashes) == 0:
        return hashes
    if len(hashes) < k:
        out = hashes[:1] ^ np.uint64(len(hashes))
        for i in range(1, len(hashes)):
            out = pair(out, hashes[i : i + 1])
        return out
    out = hashes[: len(hashes) - k + 1]
    for i in range(1, k):
        out = pair(out, hashes[i : len(hashes) - k + 1 + i])
    return out


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about `limit` characters of text each; a longer text comes alone. Texts stay whole."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = column.nbytes / max(1, len(column))
        if sizes * len(column) <= limit:
            if len(column):
                yield batch, column.to_pylist()
            continue
        texts, begin, held = [], 0, 0
        for i in range(len(column)):
            value = column[i].as_py()
            n = len(value) if value else 0
            if texts and held + n > limit:
                yield batch.slice(begin, i - begin), texts
                texts, begin, held = [], i, 0
            texts.append(value)
            held += n
        if texts:
            yield batch.slice(begin, len(texts)), texts
