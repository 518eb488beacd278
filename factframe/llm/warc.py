"""WARC archives and their index, merged from locally sorted runs.

Writing: equal payloads are found by SHA-1; of each group the row with the
largest id is the response and the others revisit it. Each task writes
compressed archives (one gzip member a record) into the shared folder and
returns its captures as a run sorted by URL key, timestamp and id.

Index: splitters from a sample of SPLITTERS captures a range cut every run into
ranges; the pieces of a range, still sorted, meet in one task and a loser tree
merges them. Beyond COARSE ranges the sample is cut in two levels: a bounded part
of it gives COARSE ranges, and tasks find the splitters inside each of them, so
the driver sorts SPLITTERS * COARSE captures at most and gets one splitter for
each RANGE_ROWS captures. Ranges are cut by the full key, so a URL with very many captures
spans several of them; range after range is one global order.

Reading: records are fetched by offset and parsed; the digest of a response is
computed again from the body that was read, and that of a revisit is the one
computed from a response's body; a record that disagrees raises an error.

A record's id is made of the page's id and the payload's digest.

Defined results: a null payload is empty; a null URL has an empty key and no
target header; a null id is a response unless another row of its group has an
id, and revisits that; rows that repeat the largest id are all responses;
payloads below `least_bytes` are all responses; an empty table gives an empty
index.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factframe.llm.common import bounded, fresh_path, unit_hash, written
from factframe.llm.files import Folder

ARCHIVE_BYTES = 32 << 20
RUN_ROWS = 20_000
RANGE_ROWS = 50_000
#: Captures sampled for each range.
SPLITTERS, COARSE = 20, 1_024
_KEYS = ["url_key", "timestamp", "page_id"]
_CAPTURE = "url_key string, timestamp string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower case; www, scheme, user, port and fragment dropped."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host = parts.hostname or ""
    except ValueError:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def page_of(name: str | None) -> int | None:
    """The page's id in a record's id."""
    number = name.split(":")[2] if name else ""
    return int(number) if number else None


def record(page_id: int | None, url: str | None, stamp: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with the payload, or a revisit with the HTTP header only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}"]
    if url:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    lines += [f"WARC-Date: {stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda h: {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in h.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, fields(http), body


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def order_key(url_key: str, timestamp: str, page_id: int | None) -> tuple:
    """The index's order; captures without an id come before those with one."""
    return url_key, timestamp, page_id is not None, page_id or 0


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Append _response: the id that a row's payload is stored under, null for rows that are responses themselves."""
    rows = pages.withColumn("_digest", F.unhex(F.sha1(F.coalesce(F.col("payload"), F.lit("").cast("binary")))))
    # only payloads that occur more than once are joined, and payloads move only where those are too many to broadcast
    groups = rows.groupBy(F.col("_digest").alias("_d")).agg(F.max("page_id").alias("_largest"), F.count("*").alias("_n")).where("_n > 1")
    small = F.coalesce(F.octet_length("payload"), F.lit(0)) < least_bytes
    joined = rows.join(bounded(groups.select("_d", "_largest")), F.col("_digest") == F.col("_d"), "left")
    return joined.withColumn("_response", F.when(small | F.col("page_id").eqNullSafe(F.col("_largest")), F.lit(None)).otherwise(F.col("_largest"))).drop("_digest", "_d", "_largest")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write page_id, url, timestamp (14 digits) and payload (binary); returns the sorted runs of captures."""

    def write(batches: Iterator[pa.RecordBatch]):
        target = Folder(folder)
        held, out, name, at = [], None, "", 0

        def run():
            out.close()
            held.sort(key=lambda c: order_key(*c[:3]))
            columns = list(zip(*held, strict=True))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*_KEYS, "file", "offset", "length"])

        for batch in batches:
            ids, urls, stamps, responses = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            for i in range(len(batch)):
                if out is None:
                    (name, out), at = target.create(".warc.gz"), 0
                data = _gzip(record(ids[i], urls[i], stamps[i], batch.column(3)[i].as_py() or b"", responses[i]))
                out.write(data)
                held.append((url_key(urls[i]), stamps[i], ids[i], name, at, len(data)))
                at += len(data)
                if at >= ARCHIVE_BYTES or len(held) >= RUN_ROWS:
                    yield run()
                    held, out = [], None
        if out is not None:
            yield run()

    rows = decide(pages.select("page_id", "url", "timestamp", "payload"), least_bytes)
    return written(rows.select("page_id", "url", "timestamp", "payload", "_response").mapInArrow(write, _CAPTURE), "captures")


def loser_tree_merge(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted lists: inner nodes hold losers, so each item costs one path of comparisons to the root."""
    runs = [r for r in runs if r]
    k = len(runs)
    if not k:
        return
    heads = [r[0] for r in runs]
    at = [0] * k
    live = [True] * k

    def beats(a: int, b: int) -> bool:
        if not live[a] or not live[b]:
            return live[a]
        return (heads[a], a) < (heads[b], b)

    tree = [0] * k  # tree[0] is the winner
    winner = [0] * (2 * k)
    for i in range(k):
        winner[k + i] = i
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    tree[0] = winner[1]
    while live[tree[0]]:
        best = tree[0]
        yield heads[best]
        at[best] += 1
        if at[best] < len(runs[best]):
            heads[best] = runs[best][at[best]]
        else:
            live[best] = False
        node = (best + k) // 2
        while node:
            if beats(tree[node], best):
                tree[node], best = best, tree[node]
            node //= 2
        tree[0] = best


def _quantiles(keys: list[tuple], parts: int) -> list[tuple]:
    """Different keys that cut the sorted ones into so many parts."""
    keys = sorted(keys)
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def range_splitters(captures: DataFrame, ranges: int, n: int) -> list[tuple]:
    """Keys that cut the captures into about equal ranges, from a sample."""
    if ranges <= 1:
        return []
    of = lambda share: captures.where(unit_hash("file", "offset") < min(1.0, share / max(1, n))).select(*_KEYS)
    coarse = min(ranges, COARSE)
    outer = _quantiles([order_key(*r) for r in of(SPLITTERS * coarse).collect()], coarse)
    if ranges <= COARSE:
        return outer
    shared, each = captures.sparkSession.sparkContext.broadcast(outer), -(-ranges // coarse)

    def place(batches: Iterator[pa.RecordBatch]):
        from bisect import bisect_right

        for batch in batches:
            where = [bisect_right(shared.value, order_key(*(r[c] for c in _KEYS))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *batch.columns], names=["coarse", *_KEYS])

    def inside(table: pa.Table) -> pa.Table:
        found = _quantiles([order_key(*(r[c] for c in _KEYS)) for r in table.to_pylist()], each)
        columns = list(zip(*found, strict=True)) or [()] * 4
        ids = [i if there else None for there, i in zip(columns[2], columns[3], strict=True)]
        return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(ids, pa.int64())], names=_KEYS)

    shape = "url_key string, timestamp string, page_id long"
    placed = of(SPLITTERS * ranges).mapInArrow(place, f"coarse int, {shape}")
    inner = [order_key(*r) for r in placed.groupBy("coarse").applyInArrow(inside, shape).collect()]
    return sorted({*outer, *inner})


def merge_index(captures: DataFrame) -> DataFrame:
    """range, position and the capture: globally ordered by url_key, timestamp, page_id over (range, position)."""
    n = captures.count()
    shared = captures.sparkSession.sparkContext.broadcast(range_splitters(captures, -(-n // RANGE_ROWS), n))
    key = lambda r: order_key(r["url_key"], r["timestamp"], r["page_id"])
    piece = pa.list_(pa.struct([(c, pa.string()) for c in _KEYS[:2]] + [("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]):
        from bisect import bisect_right

        for batch in batches:
            rows = batch.to_pylist()
            begin = 0
            while begin < len(rows):  # a file's rows are one sorted run
                end = begin
                while end < len(rows) and rows[end]["file"] == rows[begin]["file"]:
                    end += 1
                where = np.array([bisect_right(shared.value, key(r)) for r in rows[begin:end]])
                edges = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1], [True])))
                pieces = [rows[begin + a : begin + b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(where[edges[:-1]], pa.int32()), pa.array(pieces, piece)], names=["range", "piece"])
                begin = end

    def merge(table: pa.Table) -> pa.Table:
        runs = [[(*key(r), r["file"], r["offset"], r["length"]) for r in p] for p in table.column("piece").to_pylist()]
        rows = list(loser_tree_merge(runs))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        number = table.column("range")[0].as_py() if len(table) else 0
        ids = [i if there else None for there, i in zip(columns[2], columns[3], strict=True)]
        return pa.table([pa.array([number] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(ids, pa.int64()), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.int64())], names=["range", "position", *_KEYS, "file", "offset", "length"])

    pieces = captures.mapInArrow(cut, f"range int, piece array<struct<{_CAPTURE.replace(' ', ':').replace(',:', ',')}>>")
    return pieces.groupBy("range").applyInArrow(merge, f"range int, position int, {_CAPTURE}")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Fetch and parse every indexed record: the id, record type, refers_to, and size and digest of the payload as read."""
    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, timestamp string, range int, position int"

    def read(batches: Iterator[pa.RecordBatch]):
        source = Folder(folder)
        for batch in batches:
            out = []
            for r in sorted(batch.to_pylist(), key=lambda r: (r["file"], r["offset"])):
                warc, http, body = parse(zlib.decompress(source.read(r["file"], r["offset"], r["length"]), 31))
                stored = warc["warc-payload-digest"].removeprefix("sha1:")
                revisit = warc["warc-type"] == "revisit"
                if not revisit and (base64.b32encode(hashlib.sha1(body).digest()).decode() != stored or len(body) != int(http["content-length"])):
                    raise ValueError(f"the body of {warc['warc-record-id']} is not the one that was written")
                out.append((page_of(warc["warc-record-id"]), int(http["content-length"]), stored, warc["warc-type"], page_of(warc.get("warc-refers-to")), r["url_key"], r["timestamp"], r["range"], r["position"]))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in shape.split(", ")])

    read_back = written(index.select("range", "position", *_KEYS, "file", "offset", "length").mapInArrow(read, shape), "records")
    # what a revisit says of its payload is held against the body of the response that it refers to
    revisits = read_back.where("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("_to"), F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_n")).distinct()
    found = read_back.where("record_type = 'response'").select(F.col("page_id").alias("_to"), F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_n")).distinct()
    lost = wanted.join(found, ["_to", "_d", "_n"], "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no response holds the payload {lost[0]['_d']} of page {lost[0]['_to']}")
    return read_back


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, merge the index, and read everything back."""
    folder = fresh_path(pages.sparkSession, "warc")
    index = written(merge_index(write_archives(pages, folder, least_bytes)), "warc-index")
    return read_records(index, folder)
