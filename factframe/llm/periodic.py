"""Periodic runs of words: maximal stretches that repeat with a period.

A run is a stretch of consecutive words whose smallest period is q, that is at
least max(LEAST_WORDS, MIN_EXP q) words long and that no neighbouring word
extends keeping q. The words of a text become whole numbers, the array is
compared with itself at every shift q up to n / MIN_EXP, and the true stretches
of the comparison are measured.

A true stretch that makes a run covers at least 3 step places, where step is a
third of its least length (q, with MIN_EXP 4). So a shift is first compared at
every step-th word, and only where three such places in a row agree is the
stretch around them measured word by word. This loses no run and makes a scan of
all shifts cost n log n comparisons where little repeats. A stretch inside a run
whose period divides q is that same run, so it is skipped.

Spark deals (document, range of shifts): a text of at most WHOLE_BYTES bytes is
one such piece, and many of them are scanned together; a longer one is cut into
ranges of its shifts, whose copies of the word numbers are dealt over all tasks,
and what the ranges find is brought together by document.

Words are the bytes between ASCII white space, compared exactly. Defined results:
null and empty texts have no runs and an empty collapsed text; repeated rows and
null ids are each a row of their own; an empty table gives an empty result;
other columns are kept, and result columns whose names are taken get an
underscore.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factframe.llm.common import Scratch, carried, free_name, with_row

MIN_EXP = 4
LEAST_WORDS = 6
#: Texts of more bytes are cut into ranges of shifts, of RANGE_SHIFTS or a RANGES-th of the words, if that is more.
WHOLE_BYTES = 1 << 16
RANGE_SHIFTS, RANGES = 1_024, 256
#: Bytes of text scanned together.
BATCH_BYTES = 1 << 21
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def least_length(q: int, min_exp: int = MIN_EXP, least_words: int = LEAST_WORDS) -> int:
    return max(least_words, min_exp * q)


def _measure(ids: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The true stretch [begin, end) around place `at` of the comparison at shift q, in steps of growing size."""
    end, size, last = at + 1, 64, len(ids) - q
    while end < last:
        stop = min(last, end + size)
        wrong = np.flatnonzero(ids[end:stop] != ids[end + q : stop + q])
        if len(wrong):
            end += int(wrong[0])
            break
        end, size = stop, 2 * size
    begin, size = at, 64
    while begin > 0:
        stop = max(0, begin - size)
        wrong = np.flatnonzero(ids[stop:begin] != ids[stop + q : begin + q])
        if len(wrong):
            begin = stop + int(wrong[-1]) + 1
            break
        begin, size = stop, 2 * size
    return begin, end


def scan(ids: np.ndarray, sizes: list[int], first: int = 1, last: int | None = None, min_exp: int = MIN_EXP, least_words: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, from shift `first` to `last`.

    `ids` holds the documents' word numbers one after another, longest document
    first; no number is in two documents, so no stretch leaves its document.
    Periods are smallest ones among the shifts scanned.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
    falling = -np.asarray(sizes, np.int64)
    for q in range(first, (max(sizes, default=0) // min_exp if last is None else last) + 1):
        least = least_length(q, min_exp, least_words)
        # documents long enough for a run of this period come first
        end = edges[int(np.searchsorted(falling, -least, side="right"))]
        if end < least:
            break
        step = max(1, (least - q) // 3)
        here = ids[:end]
        same = here[: end - q : step] == here[q::step]
        three = np.flatnonzero(same[2:] & same[1:-1] & same[:-2] if least - q >= 3 else same)
        k = 0
        while k < len(three):
            at = int(three[k]) * step
            document = bisect_right(edges, at) - 1
            base, known = edges[document], None
            for start, length, period in found[document]:
                if q % period == 0 and start <= at - base and at - base + q < start + length:
                    known = start + length - q
            if known is None:
                begin, stop = _measure(here, at, q)
                if stop - begin + q >= least:
                    found[document].append((begin - base, stop - begin + q, q))
            else:
                stop = base + known
            k = max(k + 1, int(np.searchsorted(three, -(-stop // step))))
    return found


def number_words(texts: list[list[bytes]]) -> np.ndarray:
    """Word numbers of all texts, one after another; a word has another number in another text."""
    out: list[int] = []
    for words in texts:
        mine: dict[bytes, int] = {}
        base = len(out)
        out += [base + mine.setdefault(w, len(mine)) for w in words]
    return np.array(out, np.int64)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most about BATCH_BYTES bytes; a longer text comes alone."""
    for batch in batches:
        ends = np.cumsum([len(x) for x in batch.column(1).to_pylist()])
        begin = 0
        while begin < len(batch):
            base = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + BATCH_BYTES, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _runs_column(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = [r for runs in found for r in runs]
    columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
    offsets = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUN)))


def periodic_runs(docs: DataFrame, text: str = "text", min_exp: int = MIN_EXP, least_words: int = LEAST_WORDS) -> DataFrame:
    """The table with `n_words`, `runs` (array of start, length, period, by start and period) and `collapsed` (string)."""
    if min_exp < 2:
        raise ValueError("a run repeats its period at least twice")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    names = {}
    for stem in ("n_words", "runs", "collapsed"):
        names[stem] = free_name(docs, stem)
    rows = docs.select(carried(docs), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("_text"))
    size = F.octet_length("_text")

    def whole(batches: Iterator[pa.RecordBatch]):
        for batch in _groups(batches):
            texts = [x.split() for x in batch.column(1).to_pylist()]
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
            sizes = [len(texts[i]) for i in order]
            found: list = [[]] * len(texts)
            for i, runs in zip(order, scan(number_words([texts[i] for i in order]), sizes, min_exp=min_exp, least_words=least_words), strict=True):
                found[i] = sorted(runs)
            joined = [collapse(w, r) for w, r in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), _runs_column(found), pa.array(joined, pa.binary())], names=["_row", "n_words", "runs", "collapsed"])

    def ranges(batches: Iterator[pa.RecordBatch]):
        """One row for each range of shifts, with the word numbers."""
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                numbers = number_words([data.split()])
                width, last = max(RANGE_SHIFTS, -(-len(numbers) // RANGES)), len(numbers) // min_exp
                packed = numbers.astype(np.int32).tobytes()
                for first in range(1, max(1, last) + 1, width):
                    part = [pa.array([key]), pa.array([first], pa.int64()), pa.array([min(last, first + width - 1)], pa.int64()), pa.array([len(numbers)], pa.int64()), pa.array([packed], pa.binary())]
                    yield pa.RecordBatch.from_arrays(part, names=["_key", "first", "last", "n_words", "ids"])

    def scan_range(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(len(batch)):
                key, first, last, n, ids = (c[i].as_py() for c in batch.columns)
                found = scan(np.frombuffer(ids, np.int32), [n], first, last, min_exp, least_words)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([n], pa.int64()), _runs_column(found)], names=["_key", "n_words", "runs"])

    def finish(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            runs = [[(r["start"], r["length"], r["period"]) for r in x] for x in batch.column(3).to_pylist()]
            joined = [collapse(w.split(), r) for w, r in zip(batch.column(1).to_pylist(), runs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(joined, pa.binary())], names=["_row", "n_words", "runs", "collapsed"])

    result = with_row(rows, f"n_words long, runs {RUNS}, collapsed binary")
    short = rows.where(size <= WHOLE_BYTES).mapInArrow(whole, result)
    # few rows: each gets a key of its own, which stays as it is once written
    long = scratch.written(rows.where(size > WHOLE_BYTES).withColumn("_key", F.expr("uuid()")), "long-texts")
    parts = long.select("_key", "_text").mapInArrow(ranges, "_key string, first long, last long, n_words long, ids binary")
    dealt = parts.repartition(F.xxhash64("_key", "first"))
    some = dealt.mapInArrow(scan_range, f"_key string, n_words long, runs {RUNS}")
    # of the same stretch at several shifts, the least one is its period
    each = some.select("_key", "n_words", F.explode_outer("runs").alias("r")).groupBy("_key", "n_words", "r.start", "r.length").agg(F.min("r.period").alias("period"))
    held = F.when(F.col("start").isNotNull(), F.struct("start", "length", "period"))
    together = each.groupBy("_key", "n_words").agg(F.sort_array(F.collect_list(held)).alias("runs"))
    rest = long.join(together, "_key").select("_row", "_text", "n_words", "runs").mapInArrow(finish, result)
    return short.unionByName(rest).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], F.col("n_words").alias(names["n_words"]), F.col("runs").alias(names["runs"]), F.col("collapsed").cast("string").alias(names["collapsed"]))
