"""Round trips: WARC, WebP, chat templates, token ids."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factframe.llm import chat, tokenids, warc, webp


def test_warc_round_trip(spark):
    rows = [(1, "http://www.B.example/x?q=1", "20240101000000", b"same"), (2, "http://a.example/", "20240101000001", b"same"), (3, None, "20240101000002", b""), (4, "http://b.example/x?q=1", "20230101000000", b""), (None, "http://c.example/\r\nX: y", "20240101000003", b"other"), (5, "bad url [", "20240101000004", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, timestamp string, payload binary")
    got = {r.page_id: r for r in warc.archive(pages).collect()}
    assert len(got) == 6
    assert (got[2].record_type, got[1].record_type, got[1].refers_to) == ("response", "revisit", 2)
    assert (got[5].record_type, got[3].refers_to, got[4].refers_to) == ("response", 5, 5)
    assert got[1].payload_bytes == 4 and got[1].payload_digest == got[2].payload_digest
    ordered = sorted(got.values(), key=lambda r: (r.range, r.position))
    keys = [(r.url_key, r.timestamp) for r in ordered]
    assert keys == sorted(keys) and got[1].url_key == got[4].url_key == "example,b)/x?q=1"
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_equals_brute_force(spark, sf_dir):
    """Every column of the query, from the table alone; with repeated and null ids, equal payloads and clashing columns."""
    import base64

    from factframe.llm import queries

    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    largest, want = {}, []
    for i, h in rows:
        largest[h or ""] = max(largest.get(h or "", i), i)
    for i, h in rows:
        raw, to = (h or "").encode(), largest[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == to else "revisit", None if i == to else to))
    got = queries.op1_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want)

    odd = [(7, "http://a.example/", "20240101000000", b"x"), (7, "http://a.example/", "20240101000000", b"x"), (None, None, "20240101000000", b"x"), (3, "u", "20240101000000", b"x"), (7, "v", "20240101000000", b"y"), (None, "w", "20240101000000", b"z"), (None, "w", "20240101000000", b"z")]
    frame = spark.createDataFrame(odd, "page_id long, url string, timestamp string, payload binary").withColumn("_digest", F.lit(1)).withColumn("file", F.lit("f"))
    got = sorted(((r.page_id is None, r.page_id), r.record_type, r.refers_to) for r in warc.archive(frame).collect())
    assert got == sorted([((False, 7), "response", None)] * 3 + [((False, 3), "revisit", 7), ((True, None), "revisit", 7)] + [((True, None), "response", None)] * 2)


def test_warc_finds_damage(spark, tmp_path):
    """A body that was changed after it was written, and a response that is gone."""
    pages = spark.createDataFrame([(1, "u", "20240101000000", b"aa"), (2, "u", "20240101000001", b"aa")], "page_id long, url string, timestamp string, payload binary")
    folder = f"file://{tmp_path}"
    index = warc.written(warc.merge_index(warc.write_archives(pages, folder)), "index")
    assert warc.read_records(index, folder).count() == 2
    with pytest.raises(ValueError):
        warc.read_records(index.where("page_id = 1"), folder)
    for f in tmp_path.iterdir():
        data = f.read_bytes()
        members, out = data, b""
        while members:
            un = zlib.decompressobj(31)
            out += warc._gzip(un.decompress(members).replace(b"\r\n\r\naa", b"\r\n\r\nab"))
            members = un.unused_data
        f.write_bytes(out)
    with pytest.raises(Exception, match="not the one that was written|Error"):
        warc.read_records(index, folder)


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "20240101000000", b"aa"), (2, "u", "20240101000000", b"aa")], "page_id long, url string, timestamp string, payload binary")
    assert warc.archive(pages, least_bytes=3).where("record_type = 'response'").count() == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=8).map(sorted), max_size=9))
def test_loser_tree(runs):
    assert list(warc.loser_tree_merge([list(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_index_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    rows = [("k" if i % 3 else f"k{i}", f"{i * 7919 % 500:014d}", i, f"f{i % 5}", i, 1) for i in range(400)]
    by_file = spark.createDataFrame(rows, warc._CAPTURE).repartition(5, "file").sortWithinPartitions("file", "url_key", "timestamp", "page_id")
    merged = warc.merge_index(by_file).orderBy("range", "position").collect()
    assert [(r.url_key, r.timestamp, r.page_id) for r in merged] == sorted((r[0], r[1], r[2]) for r in rows)
    assert len({r.range for r in merged}) > 3


def test_index_with_splitters_of_two_levels_and_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    monkeypatch.setattr(warc, "COARSE", 4)
    ids = lambda i: None if i % 9 == 0 else -1 if i % 9 == 1 else i
    rows = [(f"k{i % 7}", f"{i * 7919 % 50:014d}", ids(i), f"f{i % 5}", i, 1) for i in range(900)]
    by_file = spark.createDataFrame(rows, warc._CAPTURE).repartition(5, "file").sortWithinPartitions("file", "url_key", "timestamp", F.col("page_id").asc_nulls_first())
    merged = warc.merge_index(by_file).orderBy("range", "position").collect()
    assert [(r.url_key, r.timestamp, r.page_id) for r in merged] == sorted((r[:3] for r in rows), key=lambda r: warc.order_key(*r))
    sizes = {}
    for r in merged:
        sizes[r.range] = sizes.get(r.range, 0) + 1
    assert len(sizes) > 20 and max(sizes.values()) < 120


def samples(pixels):
    return np.ascontiguousarray(pixels.view(np.uint8).reshape(*pixels.shape, 4)[:, :, 2::-1]).tobytes()


def test_webp_payloads(monkeypatch):
    rng = random.Random(5)
    payloads = [bytes(rng.randrange(256) for _ in range(192 * n)) for n in (1, 2, 33)] + [b" " * 192, b"plain text " * 192, b"ab" * 4800, b"xyz" * 576, bytes(range(192)), b"one line of many that come back\n" * 768]
    payloads.append(b"".join(bytes([c]) * 3 for c in range(256)) * 8)  # grey: green subtracted
    stored = webp.encode(payloads)
    assert stored == webp.encode(payloads) and all(m == webp.encode([p])[0] for p, m in zip(payloads, stored))
    for payload, pixels in zip(payloads, webp.decode(stored), strict=True):
        assert samples(pixels) == payload
    # what the encoder chooses: a palette, a subtraction, back-references
    kinds = [[t[0] for t in webp._header(m, 21 * 8 + 32, 1, 1)[0].transforms] for m in stored]
    assert kinds[3] == [webp.PALETTE] and kinds[-1] == [webp.GREEN] and kinds[8] == []
    assert len(stored[8]) < len(payloads[8]) / 30 and len(stored[4]) < len(payloads[4]) / 4
    # more rows than the format has: the image gets wider, and is cut again
    monkeypatch.setattr(webp, "MOST_SIDE", 4)
    (wide,) = webp.decode(webp.encode([payloads[2]]))
    assert wide.shape[0] <= 4 and samples(wide)[: len(payloads[2])] == payloads[2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"abcabcab", b"x", b"0123456789", b"   ", b"\xff\x00"]), min_size=1, max_size=120))
def test_webp_any_payload(parts):
    payload = b"".join(parts)
    payload += b" " * (-len(payload) % 192)
    (pixels,) = webp.decode(webp.encode([payload]))
    assert samples(pixels) == payload


class Stream:
    """Writes one VP8L file from plain operations, for the decoder's tests."""

    def __init__(self, width, height):
        self.out, self.width, self.height = webp.BitWriter(), width, height
        self.out.put(width - 1, 14)
        self.out.put(height - 1, 14)
        self.out.put(0, 4)

    def file(self):
        body = b"\x2f" + self.out.value.to_bytes((self.out.n + 7) // 8 + 1, "little")
        pad = b"\0" * (len(body) & 1)
        return b"RIFF" + (len(body) + len(pad) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + pad

    def pixels(self, ops, cache_bits=0, main=True):
        """ops: ('pixel', argb), ('copy', length, distance code) or ('cache', index); 8-bit flat codes."""
        out = self.out
        out.put(1, 1), out.put(cache_bits, 4) if cache_bits else None
        if not cache_bits:
            out.value &= ~(1 << (out.n - 1))
        if main:
            out.put(0, 1)
        sizes = [280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40]
        lengths = [np.zeros(s, np.uint8) for s in sizes]
        lengths[0][:] = tokenids.code_lengths(np.ones(sizes[0], np.int64), 15)
        for k in (1, 2, 3):
            lengths[k][:] = 8
        lengths[4][:] = tokenids.code_lengths(np.ones(40, np.int64), 15)
        for n in lengths:
            webp.put_code(out, n)
        codes = [webp.reversed_codes(n) for n in lengths]
        put = lambda k, s: out.put(int(codes[k][s]), int(lengths[k][s]))

        def number(k, base, value):
            value -= 1
            if value < 4:
                put(k, base + value)
                return
            extra = value.bit_length() - 2
            prefix = 2 * (extra + 1) + ((value >> extra) & 1)
            put(k, base + prefix)
            out.put(value & ((1 << extra) - 1), extra)

        for op in ops:
            if op[0] == "pixel":
                a, r, g, b = webp._parts(op[1])
                put(0, g), put(1, r), put(2, b), put(3, a)
            elif op[0] == "copy":
                number(0, 256, op[1])
                number(4, 0, op[2])
            else:
                put(0, 280 + op[1])


def flat(file):
    return webp.decode([file])[0].ravel().tolist()


def test_webp_back_references_and_cache():
    first = [0xFF102030, 0xFF405060, 0xFF708090]
    s = Stream(4, 3)
    s.out.put(0, 1)
    slot = (first[1] * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - 4)
    # three pixels, the cached second, two from the row above (code 1 is one row up), then six from three back (120 + 3)
    s.pixels([*(("pixel", p) for p in first), ("cache", slot), ("copy", 2, 1), ("copy", 6, 123)], cache_bits=4)
    want = first + [first[1]]
    want += want[0:2]
    for _ in range(6):
        want.append(want[-3])
    assert flat(s.file()) == want


def test_webp_long_lengths():
    s = Stream(50, 40)
    s.out.put(0, 1)
    s.pixels([("pixel", 0xFF010203), ("copy", 1999, 121)])
    assert flat(s.file()) == [0xFF010203] * 2000


def spec_prediction(mode, left, top, corner, right):
    """The format's predictions channel by channel, written from its text and apart from the decoder."""
    split = lambda p: [p >> s & 255 for s in (24, 16, 8, 0)]
    sides = list(zip(*map(split, (left, top, corner, right))))  # (L, T, TL, TR) of each channel
    half = lambda a, b: (a + b) // 2
    clip = lambda v: min(255, max(0, v))
    if mode == 11:
        by_left = sum(abs(t - c) for _, t, c, _ in sides)
        by_top = sum(abs(x - c) for x, _, c, _ in sides)
        return left if by_left < by_top else top
    rule = {
        0: lambda L, T, C, R: None, 1: lambda L, T, C, R: L, 2: lambda L, T, C, R: T, 3: lambda L, T, C, R: R, 4: lambda L, T, C, R: C,
        5: lambda L, T, C, R: half(half(L, R), T), 6: lambda L, T, C, R: half(L, C), 7: lambda L, T, C, R: half(L, T), 8: lambda L, T, C, R: half(C, T),
        9: lambda L, T, C, R: half(T, R), 10: lambda L, T, C, R: half(half(L, C), half(T, R)), 12: lambda L, T, C, R: clip(L + T - C),
        13: lambda L, T, C, R: clip(half(L, T) + int((half(L, T) - C) / 2)),
    }[mode]
    if mode == 0:
        return 0xFF000000
    a, r, g, b = (rule(*s) for s in sides)
    return a << 24 | r << 16 | g << 8 | b


def test_webp_predictions_by_hand():
    """One pixel of each rule, worked out on paper."""
    left, top, corner, right = 0xFF0A1420, 0xFF1E0A10, 0xFF140A08, 0xFF280600
    want = {0: 0xFF000000, 1: left, 2: top, 3: right, 4: corner, 5: 0xFF1B0B10, 6: 0xFF0F0F14, 7: 0xFF140F18, 8: 0xFF190A0C, 9: 0xFF230808, 10: 0xFF190B0E, 12: 0xFF141428, 13: 0xFF141120}
    for mode, value in want.items():
        assert webp.predict(mode, left, top, corner, right) == value == spec_prediction(mode, left, top, corner, right), mode


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictor(mode):
    rng = random.Random(mode)
    width, height = 5, 4
    want = [rng.randrange(1 << 32) for _ in range(width * height)]
    residue = []
    for i, p in enumerate(want):
        y, x = divmod(i, width)
        guess = (want[i - 1] if x else 0xFF000000) if y == 0 else want[i - width] if x == 0 else spec_prediction(mode, want[i - 1], want[i - width], want[i - width - 1], want[i - width + 1])
        residue.append(webp._join((a - b) & 255 for a, b in zip(webp._parts(p), webp._parts(guess))))
    s = Stream(width, height)
    s.out.put(1, 1), s.out.put(webp.PREDICTOR, 2), s.out.put(0, 3)
    s.pixels([("pixel", 0xFF000000 | mode << 8)] * 2, main=False)
    s.out.put(0, 1)
    s.pixels([("pixel", p) for p in residue])
    assert flat(s.file()) == want


def test_webp_cross_colour_green_and_palette():
    rng = random.Random(2)
    want = [rng.randrange(1 << 32) for _ in range(16)]
    green_red, green_blue, red_blue = 0x12, 0xF0, 0x21
    signed = lambda v: v - 256 if v > 127 else v
    sent = []
    for p in want:
        a, r, g, b = webp._parts(p)
        b = (b - ((signed(green_blue) * signed(g)) >> 5) - ((signed(red_blue) * signed(r)) >> 5)) & 255
        r = (r - ((signed(green_red) * signed(g)) >> 5)) & 255
        sent.append(webp._join((a, (r - g) & 255, g, (b - g) & 255)))
    s = Stream(4, 4)
    s.out.put(1, 1), s.out.put(webp.CROSS, 2), s.out.put(0, 3)
    s.pixels([("pixel", webp._join((255, red_blue, green_blue, green_red)))], main=False)
    s.out.put(1, 1), s.out.put(webp.GREEN, 2)
    s.out.put(0, 1)
    s.pixels([("pixel", p) for p in sent])
    assert flat(s.file()) == want

    colours = [0xFF0000FF, 0xFF00FF00, 0xFFFF0000]
    index = [rng.randrange(3) for _ in range(15)]
    s = Stream(5, 3)
    s.out.put(1, 1), s.out.put(webp.PALETTE, 2), s.out.put(2, 8)
    deltas = [webp._join((a - b) & 255 for a, b in zip(webp._parts(c), webp._parts(p))) for c, p in zip(colours, [0, *colours])]
    s.pixels([("pixel", d) for d in deltas], main=False)
    s.out.put(0, 1)
    rows = [index[y * 5 : y * 5 + 5] for y in range(3)]
    packed = [sum(v << (2 * k) for k, v in enumerate(row[i : i + 4])) for row in rows for i in (0, 4)]
    s.pixels([("pixel", 0xFF000000 | v << 8) for v in packed])
    assert flat(s.file()) == [colours[i] for i in index]


def test_webp_column(spark, odd_documents, no_documents):
    """Every column against plain code, for nulls, empty, long and repeated texts."""
    got = webp.read_features(webp.store(odd_documents)).collect()
    pad = lambda b: b + b" " * (-len(b) % 192 if b else 192)
    want = []
    for r in odd_documents.collect():
        raw = (r.text or "").encode()
        p = pad(raw)
        media = webp.encode([p])[0]
        want.append((r.doc_id or -1, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"64x{len(p) // 192} text {len(p.rstrip())} crc {zlib.crc32(p)}"))
    assert sorted((r.doc_id or -1, *r[1:]) for r in got) == sorted(want)
    assert webp.read_features(webp.store(no_documents)).count() == 0
    pixels = webp.read_pixels(webp.store(odd_documents)).where("doc_id = 6").collect()[0]
    assert (pixels.height, pixels.width) == (1, 64) and bytes(pixels.samples) == b"ok" + b" " * 190


def test_chat_escapes_are_reversible(spark):


    rng, parts = random.Random(4), ["<", "[", "\\", "s>", "/s>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "|", "|>", "<|im_end|>", "<|im_start|>", "im_start", "\n", "a", "é", "\\n", "\\s"]
    rows = [(i // 5, i % 5, rng.choice(["user", "assistant", "".join(rng.choices(parts, k=3))]), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for i in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chat(chat.canonical_turns(df))
    read = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
    for c in read:
        mine = [r for r in rows if r[0] == c.conv_id]
        assert [(t.role, t.text) for t in c.turns] == [(m[2], m[3]) for m in mine]
        assert c.loss == "".join(m[3] for m in mine if m[2] == "assistant")
        assert c.formatted.count("<|im_start|>") == c.formatted.count("<|im_end|>") == len(mine) and "</s>" not in c.formatted and "[INST]" not in c.formatted


def test_chat_layouts(spark):
    messages = spark.sql("select 7L as conv_id, array(named_struct('role', 'user', 'content', 'hi'), named_struct('role', 'assistant', 'content', null)) as messages, 'x' as extra")
    assert [(r.turn, r.role, r.text) for r in chat.canonical_turns(messages).orderBy("turn").collect()] == [(0, "user", "hi"), (1, "assistant", "")]
    mixed = spark.sql("select * from values (1L, 'p', 'r', null, null, null), (2L, null, null, 'do', null, 'done'), (3L, null, null, 'do', 'this', 'done'), (4L, null, null, null, null, null) as t(conv_id, prompt, response, instruction, input, output)")
    got = {(r.conv_id, r.turn): r.text for r in chat.canonical_turns(mixed).collect()}
    assert got == {(1, 0): "p", (1, 1): "r", (2, 0): "do", (2, 1): "done", (3, 0): "do\n\nthis", (3, 1): "done"}
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))


def test_chat_keeps_records_of_tables_that_mix_turn_rows(spark):
    kind = "conv_id long, turn long, role string, text string, messages array<struct<role string, content string>>"
    rows = [(1, 0, "user", "a", None), (1, 1, None, None, None), (2, None, None, None, [("user", "hi"), ("assistant", None)]), (3, None, None, None, None), (4, 0, "user", "x", [("user", "y")]), (5, 7, None, None, [("user", "z")])]
    df = spark.createDataFrame(rows, kind)
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns(df).collect())
    assert got == [(1, 0, "user", "a"), (1, 1, "", ""), (2, 0, "user", "hi"), (2, 1, "assistant", ""), (5, 0, "user", "z")]
    left = chat.unmatched_records(df)
    assert left.columns == df.columns and sorted(r.conv_id for r in left.collect()) == [3, 4]


def test_chat_fingerprints_of_rows_select_mappings(spark):
    """Every part of a layout's paths selects it; parts of two layouts and nothing select none."""
    layouts = [x for x in chat.LAYOUTS if x.name in ("prompt_response", "instruction", "messages")]
    mappings = chat.row_mappings(layouts)
    assert len(mappings) == 3 + 7 + 3 and mappings[chat.fingerprint(("output",))] == "instruction"
    assert chat.fingerprint(("prompt", "output")) not in mappings and chat.fingerprint(()) not in mappings
    kind = "conv_id long, prompt string, response string, messages array<struct<role string, content string>>"
    rows = [(1, "p", None, None), (2, None, None, [("user", None)]), (3, None, None, []), (4, None, None, [(None, None)]), (5, "p", "r", [("user", "x")]), (6, None, None, None)]
    df = spark.createDataFrame(rows, kind)
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns(df).collect())
    assert got == [(1, 0, "user", "p"), (1, 1, "assistant", ""), (2, 0, "user", "")]
    assert sorted(r.conv_id for r in chat.unmatched_records(df).collect()) == [3, 4, 5, 6]


def test_chat_keeps_records_with_one_side_null(spark):
    pairs = spark.createDataFrame([(1, "p", None), (2, None, "r"), (3, None, None)], "conv_id long, prompt string, response string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.canonical_turns(pairs).collect()}
    assert got == {(1, 0): ("user", "p"), (1, 1): ("assistant", ""), (2, 0): ("user", ""), (2, 1): ("assistant", "r")}
    assert [r.conv_id for r in chat.unmatched_records(pairs).collect()] == [3]
    tasks = spark.createDataFrame([(1, "do", None, None), (2, None, "this", "done")], "conv_id long, instruction string, input string, output string")
    got = {(r.conv_id, r.turn): r.text for r in chat.canonical_turns(tasks).collect()}
    assert got == {(1, 0): "do", (1, 1): "", (2, 0): "this", (2, 1): "done"}


def test_chat_odd_rows(spark):
    rows = [(None, None, None, None), (1, 0, "user", "same"), (1, 0, "user", "same"), (1, None, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_n", F.lit(1))
    made = {r.conv_id: r for r in chat.format_chat(chat.canonical_turns(df)).collect()}
    assert set(made) == {None, 1} and made[1].formatted.count("same") == 2 and made[1].loss_spans[0].length == 100_000
    assert chat.format_chat(chat.canonical_turns(df.limit(0))).count() == 0


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def fresh(path):
    """The library by itself, not the encoder's."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_encoder_equals_library(path, fresh):
    e = tokenids.Encoder(path)
    texts = ["don't we've I'M they'll he'd 's 't", "''s .'s 1're \n'll  've\t'd", "'", "'s", "x'", "o'clock 'tis ''", "a  b\n\n c \n", "it's 'll don't", "x\t\ty  \n", "日本 a", "12 34a!? ..   x", " ", "\n", "é 1½ ‘ok’", "<|endoftext|> x", "   x", "end  "]
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in e.encode(texts)] == want == [x.tolist() for x in e.encode(texts)]


def test_encoder_finds_added_tokens_as_a_fresh_library_does(path, fresh):
    e = tokenids.Encoder(path)
    assert "<|endoftext|>" in e.added
    texts = ["<|endoftext|> x", "a b<|endoftext|><|endoftext|>c", "日 <|endoftext|>", "it's <|endoftext|>", "<|endoftext|", "<|endoftext| >", "plain text"]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [50256, 2124]
    assert [x.tolist() for x in e.encode(texts)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list(" \n\tabstrevmldé1½.!—''日本\u00a0\u3000\U0001f600")), max_size=25))
def test_encoder_equals_library_on_any_text(path, fresh, text):
    e = tokenids.encoder(path)
    assert [x.tolist() for x in e.encode([text, "s", text])] == [fresh.encode(t, add_special_tokens=False).ids for t in (text, "s", text)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=300))
def test_codes_are_prefix_free_and_limited(counts):
    lengths = tokenids.code_lengths(np.array(counts), 9)
    used = lengths[lengths > 0].astype(float)
    assert (lengths > 0).tolist() == [c > 0 for c in counts] and used.max(initial=0) <= 9 and (2.0**-used).sum() <= 1


def test_blocks_decode_alone():
    rng = np.random.default_rng(0)
    documents = [rng.zipf(1.3, n).clip(0, 5000).astype(np.uint16) for n in (1, 1024, 1025, 5000)]
    lengths = tokenids.code_lengths(np.bincount(np.concatenate(documents), minlength=1 << 16))
    table = tokenids.decoding_table(lengths)
    for ids, (data, begin) in zip(documents, tokenids.encode_blocks(documents, tokenids.canonical_codes(lengths), lengths)):
        count = np.minimum(1024, len(ids) - 1024 * np.arange(len(begin)))
        assert (tokenids.decode_blocks(data, begin * 8, count, table) == ids).all()
        last = tokenids.decode_blocks(data, begin[-1:] * 8, count[-1:], table)
        assert (last == ids[1024 * (len(begin) - 1) :]).all()


def test_memory_of_pretokens():
    rng = np.random.default_rng(2)
    memory, known = tokenids.Memory(3), {}
    for _ in range(40):
        keys, checks = (rng.integers(0, 50, 30).astype(np.uint64) << np.uint64(s) for s in (59, 0))  # many equal slots
        found = memory.find(keys, checks)
        pairs = list(zip(keys.tolist(), checks.tolist()))
        assert found.tolist() == [known.get(p, -1) for p in pairs]
        fresh = sorted({p for p in pairs if p not in known})
        memory.add(*(np.array(c, np.uint64) for c in (zip(*fresh) if fresh else ([], []))))
        known |= {p: len(known) + i for i, p in enumerate(fresh)}


def test_token_files(spark, path, fresh, odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(tokenids, "FILE_IDS", 50_000)
    got = sorted(tokenids.encode_corpus(odd_documents, path).collect(), key=lambda r: r.start)
    texts = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in odd_documents.collect())
    at = 0
    for r, (doc_id, text) in zip(got, texts, strict=True):
        ids = np.array([*fresh.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenids.encode_corpus(no_documents, path).count() == 0


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_texts_whose_hashes_agree_keep_their_ids(path, fresh, n):
    a, b = thue_morse(n)
    want = [fresh.encode(t, add_special_tokens=False).ids for t in (a, b, "and " + b + " so")]
    for texts, ids in (([a, b, "and " + b + " so"], want), ([b, a], want[1::-1])):
        e = tokenids.Encoder(path)
        assert [x.tolist() for x in e.encode(texts)] == ids
        assert [x.tolist() for t in texts for x in e.encode([t])] == ids


def test_equal_hashes_of_all_pretokens_still_give_the_library_s_ids(path, fresh, monkeypatch):
    monkeypatch.setattr(tokenids.Encoder, "_hashes", lambda self, points, start, end: [(end - start).astype(np.uint64) << np.uint64(60)] * 2)
    texts = ["the cat sat on a mat", "one two six ten", None, "it's 12 o'clock"]
    assert [x.tolist() for x in tokenids.Encoder(path).encode(texts)] == [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]


def least_cost(weights, most):
    """Least total length of any prefix code of at most `most` bits: all ways to fill the leaves, by depth."""
    from functools import cache

    ordered = sorted(weights, reverse=True)

    @cache
    def best(i, depth, free):
        # `free` nodes are open at this depth; commonest ids take the shortest codes
        if i == len(ordered):
            return 0
        if free <= 0 or depth > most:
            return float("inf")
        options = [best(i, depth + 1, 2 * free)] if free < len(ordered) else []
        if free:
            options.append(ordered[i] * depth + best(i + 1, depth, free - 1))
        return min(options, default=float("inf"))

    return best(0, 1, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 200), min_size=2, max_size=8))
def test_limited_codes_are_optimal(counts):
    lengths = tokenids.code_lengths(np.array(counts), 4).astype(int)
    assert int((lengths * counts).sum()) == least_cost(counts, 4)


def test_a_folder_is_read_with_nothing_else(spark, path, fresh, odd_documents, tmp_path):
    folder = f"file://{tmp_path}/ids"
    tokens = tokenids.tokenize(odd_documents, path).cache()
    tokenids.write_files(tokens, tokenids.code_lengths(tokenids.global_counts(tokens)), folder)
    tokens.unpersist()
    stray = tmp_path / "ids" / "of-a-retried-task.ids"
    stray.write_bytes(b"half a file")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in tokenids.read_ids(spark.newSession(), folder).collect())
    want = sorted((-1 if r.doc_id is None else r.doc_id, [*fresh.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in odd_documents.collect())
    assert got == want


def test_long_runs_of_blanks_are_quick(spark):
    import time

    rows = spark.createDataFrame([(1, "a" + " " * 80_000 + "b"), (2, "a" + " " * 100), (3, None)], "doc_id long, text string")
    stored = webp.store(rows)
    stored.count()
    begin = time.time()
    features = {r["doc_id"]: r["feature"].split(" crc")[0] for r in webp.read_features(stored).collect()}
    assert time.time() - begin < 20  # with a worker's start
    assert (features[1].split()[-1], features[2].split()[-1], features[3].split()[-1]) == ("80002", "1", "0")


def test_a_palette_at_any_size():
    payload = b"abcab" * 19_200
    (large,) = webp.encode([payload])
    assert len(large) < len(payload) / 3
    pixels = webp.decode([large])[0]
    assert np.ascontiguousarray(pixels.view(np.uint8).reshape(*pixels.shape, 4)[:, :, 2::-1]).tobytes()[: len(payload)] == payload
