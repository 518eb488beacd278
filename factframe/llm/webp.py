"""Lossless WebP (VP8L) columns: an encoder for payloads and a full decoder.

The decoder reads RIFF containers and the whole lossless format: prefix codes
(simple and normal, several groups by entropy image), back-references, colour
cache, and the predictor, cross-colour, subtract-green and palette transforms.
Streams with equal headers share their tables and are decoded in step, one
symbol of each at a time, so array operations run over all images of a batch;
images of like size go together, so a long one does not hold up short ones.

The encoder stores bytes as RGB samples, one file a payload, WIDTH pixels a row
(more where the format's bound on rows asks for it; the last rows are then
filled up, and cut off again by the payload's size). It repeats runs of MATCH
pixels or more by back-references, subtracts green from red and blue where that
makes a payload shorter, and gives payloads of at most 16 different pixels a
palette. Prefix codes are fixed, so headers are shared; equal bytes give equal
files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factframe.llm.common import written
from factframe.llm.hashing import chunks, mix
from factframe.llm.tokenids import canonical_codes, code_lengths

WIDTH = 64
PAD = WIDTH * 3
#: Most rows and columns of an image.
MOST_SIDE = 1 << 14
#: Shortest and longest run of pixels that a back-reference repeats.
MATCH, MOST_MATCH = 8, 4096
SAMPLED = 8
#: Widest code of the format.
PEEK = 15
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
# Fixed values of the format: the order of code-length codes, and the offsets (x, y) of short distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Reads a stream bit by bit, least significant first; used for headers only."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        first = self.at >> 3
        value = int.from_bytes(self.data[first : first + (n >> 3) + 2], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with their bits reversed, as the stream holds them."""
    codes = canonical_codes(lengths)
    out = np.zeros(len(codes), np.uint32)
    for bit in range(PEEK):
        out |= ((codes >> np.uint32(bit)) & np.uint32(1)) << np.maximum(lengths.astype(np.int64) - 1 - bit, 0).astype(np.uint32) * (lengths > bit)
    return out


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every value of the next PEEK bits; one used symbol takes no bits."""
    symbol, width = np.zeros(1 << PEEK, np.int32), np.zeros(1 << PEEK, np.int64)
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        symbol[:] = used[0]
        return symbol, width
    codes = reversed_codes(lengths)
    for s in used.tolist():
        n = int(lengths[s])
        symbol[int(codes[s]) :: 1 << n] = s
        width[int(codes[s]) :: 1 << n] = n
    return symbol, width


def _read_symbol(bits: Bits, table) -> int:
    peek = Bits(bits.data, bits.at).read(PEEK)
    bits.at += int(table[1][peek])
    return int(table[0][peek])


def read_code(bits: Bits, size: int) -> np.ndarray:
    """Code lengths of one alphabet."""
    lengths = np.zeros(size, np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lengths
    of_lengths = np.zeros(19, np.uint8)
    for i in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[i]] = bits.read(3)
    table = decode_table(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left > 0:
        left -= 1
        s = _read_symbol(bits, table)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
        else:
            value, n = (before, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3) if s == 17 else 11 + bits.read(7))
            lengths[at : at + n] = value
            at += n
    return lengths


@dataclass
class Plan:
    """Everything before the pixels of an entropy-coded image."""

    cache_bits: int = 0
    group_bits: int = 0
    groups: np.ndarray | None = None  # group of each block, row by row
    symbols: np.ndarray | None = None  # (groups * 5, 2**PEEK)
    widths: np.ndarray | None = None
    across: int = 0


@dataclass
class Header:
    width: int
    height: int
    transforms: list[tuple[int, int, np.ndarray | None]] = field(default_factory=list)
    coded_width: int = 0
    plan: Plan | None = None


def read_plan(bits: Bits, width: int, height: int, main: bool) -> Plan:
    plan = Plan(cache_bits=bits.read(4) if bits.read(1) else 0)
    count = 1
    if main and bits.read(1):
        plan.group_bits = bits.read(3) + 2
        plan.across = -(-width >> plan.group_bits)
        plan.across = (width + (1 << plan.group_bits) - 1) >> plan.group_bits
        down = (height + (1 << plan.group_bits) - 1) >> plan.group_bits
        plan.groups = (_small_image(bits, plan.across, down) >> np.uint32(8)).astype(np.int64) & 0xFFFF
        count = int(plan.groups.max()) + 1
    tables = [decode_table(read_code(bits, size)) for _ in range(count) for size in (280 + (1 << plan.cache_bits if plan.cache_bits else 0), 256, 256, 256, 40)]
    plan.symbols, plan.widths = np.stack([t[0] for t in tables]), np.stack([t[1] for t in tables])
    return plan


def _small_image(bits: Bits, width: int, height: int) -> np.ndarray:
    plan = read_plan(bits, width, height, main=False)
    pixels, ends = decode_pixels(bits.data, np.array([bits.at]), [plan], np.array([width]), np.array([width * height]))
    bits.at = int(ends[0])
    return pixels[0]


def read_header(bits: Bits, width: int, height: int) -> Header:
    head = Header(width, height, coded_width=width)
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS):
            size = bits.read(3) + 2
            block = lambda n: (n + (1 << size) - 1) >> size
            head.transforms.append((kind, size, _small_image(bits, block(head.coded_width), block(height))))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = _small_image(bits, n, 1).view(np.uint8).reshape(-1, 4)
            colours = np.cumsum(colours, axis=0, dtype=np.uint8)
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            head.transforms.append((kind, packed, np.ascontiguousarray(colours).view(np.uint32).ravel()))
            head.coded_width = (head.coded_width + (1 << packed) - 1) >> packed
        else:
            head.transforms.append((kind, 0, None))
    head.plan = read_plan(bits, head.coded_width, height, main=True)
    return head


def windows(data: bytes) -> np.ndarray:
    """The four bytes from each byte of a stream on, as one number."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(12, np.uint8)]).astype(np.uint32)
    return raw[:-3] | (raw[1:-2] << 8) | (raw[2:-1] << 16) | (raw[3:] << 24)


def decode_pixels(data: bytes, at: np.ndarray, plans: list[Plan], width: np.ndarray, count: np.ndarray, four: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """ARGB pixels of several images that share one plan (one bit offset, width and pixel count each), and where each ends; `four` are the data's windows."""
    plan = plans[0]
    order = np.argsort(-count, kind="stable")
    lanes, most = len(order), int(count.max())
    at, width, todo = at[order].astype(np.int64), width[order].astype(np.int64), count[order]
    four = windows(data) if four is None else four
    near = np.array(NEAR, np.int64)
    place = np.empty(lanes, np.int64)
    place[order] = np.arange(lanes)

    def number(who, prefix):
        """Value of a length or distance prefix with its extra bits."""
        prefix = np.asarray(prefix, np.int64)
        extra = np.maximum((prefix - 2) >> 1, 0)
        low = (four[at[who] >> 3] >> (at[who] & 7).astype(np.uint32)).astype(np.int64) & ((1 << np.minimum(extra, 24)) - 1)
        low = np.where(extra > 0, low, 0)
        at[who] += extra
        return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + low + 1)

    if plan.groups is None and not plan.cache_bits:
        found, ends = _decode_symbols(plan, four, number, at, width, todo, near)
        return [found[p] for p in place], ends[place]
    flat_symbols, flat_widths = plan.symbols.ravel(), plan.widths.ravel()
    free = [not plan.widths[k::5].any() for k in range(5)]
    only = [int(plan.symbols[k, 0]) for k in range(5)]
    out = np.zeros((most, lanes), np.uint32)
    copies, distance = np.zeros(lanes, np.int64), np.ones(lanes, np.int64)
    cache = np.zeros((1 << plan.cache_bits, lanes), np.uint32) if plan.cache_bits else None
    alive = np.searchsorted(-todo, -np.arange(1, most + 1), side="right")

    def look(who, base, kind):
        if free[kind] and plan.groups is None:
            return only[kind]
        peek = (four[at[who] >> 3] >> (at[who] & 7).astype(np.uint32)) & np.uint32((1 << PEEK) - 1)
        index = peek.astype(np.int64) + ((base + kind) << PEEK)
        at[who] += flat_widths[index]
        return flat_symbols[index]

    for step in range(most):
        k = int(alive[step])
        copying = np.flatnonzero(copies[:k] > 0)
        who = np.flatnonzero(copies[:k] == 0)
        if len(who):
            base = np.zeros(len(who), np.int64)
            if plan.groups is not None:
                y, x = np.divmod(step, width[who])
                base = plan.groups[(y >> plan.group_bits) * plan.across + (x >> plan.group_bits)] * 5
            green = np.broadcast_to(look(who, base, 0), len(who))
            literal = green < 256
            if literal.any():
                some, b = who[literal], base[literal]
                red, blue, alpha = look(some, b, 1), look(some, b, 2), look(some, b, 3)
                out[step, some] = np.asarray(alpha, np.uint32) << 24 | np.asarray(red, np.uint32) << 16 | green[literal].astype(np.uint32) << 8 | np.asarray(blue, np.uint32)
            back = (green >= 256) & (green < 280)
            if back.any():
                some, b = who[back], base[back]
                copies[some] = number(some, green[back] - 256)
                code = number(some, np.broadcast_to(look(some, b, 4), len(some)))
                x, y = near[np.minimum(code, 120) - 1].T
                distance[some] = np.where(code > 120, code - 120, np.maximum(x + y * width[some], 1))
                copying = np.concatenate([copying, some])
            cached = green >= 280
            if cached.any():
                out[step, who[cached]] = cache[green[cached] - 280, who[cached]]
        if len(copying):
            out[step, copying] = out[step - distance[copying], copying]
            copies[copying] -= 1
        if plan.cache_bits:
            slot = (out[step, :k] * np.uint32(0x1E35A7BD)) >> np.uint32(32 - plan.cache_bits)
            cache[slot, np.arange(k)] = out[step, :k]
    return [np.ascontiguousarray(out[: int(n), p]) for n, p in zip(count, place, strict=True)], at[place]


def _decode_symbols(plan: Plan, four: np.ndarray, number, at: np.ndarray, width: np.ndarray, todo: np.ndarray, near: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Pixels of images whose symbols don't depend on their place: first all symbols, in step, then the repeats of each image."""
    lanes = len(todo)
    seen, copies = np.zeros((int(todo.max()), lanes), np.uint32), {}
    live, made, steps = np.arange(lanes), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    # a symbol and its width in one entry
    green_of, red_of, blue_of, alpha_of, distance_of = ((plan.symbols[k] | plan.widths[k] << 16).astype(np.int32) for k in range(5))
    peek, low = np.uint64((1 << PEEK) - 1), np.int32(0xFFFF)
    opaque = not plan.widths[3].any()
    solid = np.uint32(int(plan.symbols[3, 0]) << 24)
    whole, step = True, 0  # as long as no lane has ended, a slice stands for all of them
    while len(live):
        who = slice(0, lanes) if whole else live
        bits = at[who]
        byte = bits >> 3
        window = (four[byte].astype(np.uint64) | four[byte + 4].astype(np.uint64) << np.uint64(32)) >> (bits & 7).astype(np.uint64)
        green = green_of[window & peek]
        used = green >> 16
        green &= low
        red = red_of[(window >> used.astype(np.uint64)) & peek]
        both = used + (red >> 16)
        blue = blue_of[(window >> both.astype(np.uint64)) & peek]
        end = both + (blue >> 16)
        argb = (red & low) << 16 | green << 8 | (blue & low)
        if opaque:
            argb = argb.astype(np.uint32) | solid
        else:
            bits_alpha = bits + end
            alpha = alpha_of[(four[bits_alpha >> 3] >> (bits_alpha & 7).astype(np.uint32)) & np.uint32((1 << PEEK) - 1)]
            argb, end = argb.astype(np.uint32) | (alpha & low).astype(np.uint32) << np.uint32(24), end + (alpha >> 16)
        if int(green.max()) < 256:
            seen[step, who] = argb
            at[who] = bits + end
            made[who] += 1
        else:
            back = green >= 256
            some, literal = live[back], live[~back]
            seen[step, literal], at[literal] = argb[~back], (bits + end)[~back]
            made[literal] += 1
            at[some] = (bits + used)[back]
            length = number(some, green[back] - 256)
            start = at[some]
            prefix = distance_of[(four[start >> 3] >> (start & 7).astype(np.uint32)) & np.uint32((1 << PEEK) - 1)]
            at[some] += prefix >> 16
            code = number(some, prefix & low)
            x, y = near[np.minimum(code, 120) - 1].T
            distance = np.where(code > 120, code - 120, np.maximum(x + y * width[some], 1))
            for lane, n, d in zip(some.tolist(), length.tolist(), distance.tolist(), strict=True):
                copies.setdefault(lane, []).append((step, n, d))
            made[some] += length
        step += 1
        ended = made[who] >= todo[who]
        if ended.any():
            steps[live[ended]] = step
            live, whole = live[~ended], False
    out = []
    for lane in range(lanes):
        symbols, n = seen[: steps[lane], lane], int(todo[lane])
        if lane not in copies:
            out.append(np.ascontiguousarray(symbols[:n]))
            continue
        pixels, filled, last = np.zeros(n, np.uint32), 0, 0
        for where, length, distance in [*copies[lane], (int(steps[lane]), 0, 1)]:
            pixels[filled : filled + where - last] = symbols[last:where]
            filled, last = filled + where - last, where + 1
            length = min(length, n - filled)
            if length > 0:
                pixels[filled : filled + length] = np.resize(pixels[filled - distance : filled][:length], length)
                filled += length
        out.append(pixels)
    return out, at


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, (p >> 16) & 255, (p >> 8) & 255, p & 255


def _join(parts) -> int:
    a, r, g, b = parts
    return a << 24 | r << 16 | g << 8 | b


def _average(p: int, q: int) -> int:
    return _join((x + y) >> 1 for x, y in zip(_parts(p), _parts(q), strict=True))


def predict(mode: int, left: int, top: int, top_left: int, top_right: int) -> int:
    """The format's fourteen predictions of a pixel from its neighbours."""
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode < 11:
        return {
            5: lambda: _average(_average(left, top_right), top),
            6: lambda: _average(left, top_left),
            7: lambda: _average(left, top),
            8: lambda: _average(top_left, top),
            9: lambda: _average(top, top_right),
            10: lambda: _average(_average(left, top_left), _average(top, top_right)),
        }[mode]()
    sides = list(zip(_parts(left), _parts(top), _parts(top_left), strict=True))
    if mode == 11:
        return left if sum(abs(t - c) for _, t, c in sides) < sum(abs(x - c) for x, _, c in sides) else top
    if mode == 12:
        return _join(_clamp(x + t - c) for x, t, c in sides)
    middle = zip(_parts(_average(left, top)), _parts(top_left), strict=True)
    return _join(_clamp(m + int((m - c) / 2)) for m, c in middle)


def _unpredict(pixels: np.ndarray, width: int, size: int, modes: np.ndarray) -> np.ndarray:
    across = (width + (1 << size) - 1) >> size
    out = pixels.tolist()
    for i in range(len(out)):
        y, x = divmod(i, width)
        if y == 0:
            guess = out[i - 1] if x else 0xFF000000
        elif x == 0:
            guess = out[i - width]
        else:
            mode = (int(modes[(y >> size) * across + (x >> size)]) >> 8) & 15
            guess = predict(mode, out[i - 1], out[i - width], out[i - width - 1], out[i - width + 1])
        out[i] = _join((p + q) & 255 for p, q in zip(_parts(out[i]), _parts(guess), strict=True))
    return np.array(out, np.uint32)


def _uncross(pixels: np.ndarray, width: int, size: int, elements: np.ndarray) -> np.ndarray:
    across = (width + (1 << size) - 1) >> size
    y, x = np.divmod(np.arange(len(pixels)), width)
    e = elements[(y >> size) * across + (x >> size)]
    signed = lambda v, shift: ((v >> np.uint32(shift)) & np.uint32(255)).astype(np.uint8).view(np.int8).astype(np.int32)
    green, red, blue = signed(pixels, 8), signed(pixels, 16), signed(pixels, 0)
    red = (red + ((signed(e, 0) * green) >> 5)) & 255
    again = red.astype(np.uint8).view(np.int8).astype(np.int32)
    blue = (blue + ((signed(e, 8) * green) >> 5) + ((signed(e, 16) * again) >> 5)) & 255
    return (pixels & np.uint32(0xFF00FF00)) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def invert(pixels: np.ndarray, head: Header) -> np.ndarray:
    """Undo the transforms, last first."""
    widths, width = [], head.width
    for kind, size, _ in head.transforms:
        widths.append(width)
        if kind == PALETTE:
            width = (width + (1 << size) - 1) >> size
    for (kind, size, extra), full in zip(head.transforms[::-1], widths[::-1], strict=True):
        if kind == PREDICTOR:
            pixels = _unpredict(pixels, full, size, extra)
        elif kind == CROSS:
            pixels = _uncross(pixels, full, size, extra)
        elif kind == GREEN:
            green = (pixels >> np.uint32(8)) & np.uint32(255)
            both = (pixels & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green)
            pixels = (pixels & np.uint32(0xFF00FF00)) | (both & np.uint32(0x00FF00FF))
        else:
            green = ((pixels >> np.uint32(8)) & np.uint32(255)).reshape(head.height, -1)
            each = 8 >> size
            index = (green[:, :, None] >> (np.arange(1 << size) * each).astype(np.uint32)) & np.uint32((1 << each) - 1)
            index = index.reshape(head.height, -1)[:, :full].ravel()
            pixels = np.append(extra, np.zeros(max(0, 256 - len(extra)), np.uint32))[index]
    return pixels


_headers: dict[int, dict[int, tuple[Header, int]]] = {}


def _header(data: bytes, at: int, width: int, height: int) -> tuple[Header, int, object]:
    """Header, its end in bits, and a key that equal headers share; headers without data of their own or groups are remembered by their bits."""
    for n, known in _headers.items():
        mask = Bits(data, at).read(n)
        if mask in known:
            head, plan_key = known[mask]
            return Header(width, height, head.transforms, width, head.plan), at + n, plan_key
    bits = Bits(data, at)
    head = read_header(bits, width, height)
    n = bits.at - at
    key: object = (id(head), n)
    if all(kind == GREEN for kind, _, _ in head.transforms) and head.plan.groups is None:
        if sum(map(len, _headers.values())) > 64:
            _headers.clear()
        _headers.setdefault(n, {})[Bits(data, at).read(n)] = (head, (id(head), n))
    return head, bits.at, key


def decode(files: list[bytes]) -> list[np.ndarray]:
    """(height, width) arrays of ARGB pixels of several files."""
    found, by_key = [], {}
    data, start = b"".join(files), 0
    for i, f in enumerate(files):
        if f[:4] != b"RIFF" or f[8:16] != b"WEBPVP8L" or f[20] != 0x2F:
            raise ValueError("not a lossless WebP file")
        bits = Bits(f, 21 * 8)
        width, height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(4)
        head, end, key = _header(f, bits.at, width, height)
        found.append((head, start * 8 + end))
        by_key.setdefault(key, []).append(i)
        start += len(f)
    out: list = [None] * len(files)
    four = windows(data)
    for same in by_key.values():
        sizes: dict[int, list[int]] = {}
        for i in same:
            sizes.setdefault((found[i][0].coded_width * found[i][0].height).bit_length(), []).append(i)
        for group in sizes.values():
            heads = [found[i][0] for i in group]
            pixels, _ = decode_pixels(data, np.array([found[i][1] for i in group]), [heads[0].plan], np.array([h.coded_width for h in heads]), np.array([h.coded_width * h.height for h in heads]), four)
            for i, head, p in zip(group, heads, pixels, strict=True):
                out[i] = invert(p, head).reshape(head.height, head.width)
    return out


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def length_symbols(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(symbol, extra value, extra bits) that spell code lengths, with runs."""
    out, i, before = [], 0, 8
    while i < len(lengths):
        run = 1
        while i + run < len(lengths) and lengths[i + run] == lengths[i]:
            run += 1
        value = int(lengths[i])
        if value == 0 and run >= 3:
            run = min(run, 138)
            out.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
        elif value and value == before and run >= 3:
            run = min(run, 6)
            out.append((16, run - 3, 2))
        else:
            run = 1
            out.append((value, 0, 0))
            before = value or before
        i += run
    return out


def put_code(out: BitWriter, lengths: np.ndarray) -> None:
    """A normal code, its lengths spelled under a Huffman code of at most 7 bits."""
    spelled = length_symbols(lengths)
    of_lengths = code_lengths(np.bincount([s for s, _, _ in spelled], minlength=19), 7)
    out.put(0, 1)
    out.put(15, 4)  # all nineteen
    for s in LENGTH_ORDER:
        out.put(int(of_lengths[s]), 3)
    out.put(0, 1)
    reverse, alone = reversed_codes(of_lengths), np.count_nonzero(of_lengths) == 1
    for s, value, n in spelled:
        out.put(int(reverse[s]), 0 if alone else int(of_lengths[s]))
        out.put(value, n)


def put_one(out: BitWriter, symbol: int) -> None:
    """A simple code of one symbol."""
    out.put(1 | 0 << 1 | 1 << 2, 3)
    out.put(symbol, 8)


def text_code() -> np.ndarray:
    """Code lengths that favour text: Huffman lengths of pseudo-counts after letter frequencies, per 10,000."""
    counts = np.ones(256, np.int64)
    counts[128:192] = 12
    counts[0xC2:0xF0] = 2
    counts[0xC3] = 250
    frequency = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (1270, 910, 820, 750, 700, 670, 630, 610, 600, 430, 400, 280, 280, 240, 240, 220, 200, 200, 190, 150, 100, 80, 15, 15, 10, 7), strict=True))
    for c, n in frequency.items():
        counts[ord(c)], counts[ord(c.upper())] = n, max(1, n // 40)
    for c, n in ((" ", 1800), ("\n", 50), (".", 120), (",", 100)):
        counts[ord(c)] = n
    return code_lengths(counts, 12)


def _copy_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code lengths of the green alphabet with its 24 length prefixes, and of the 40 distance prefixes."""
    counts = np.zeros(280, np.int64)
    counts[:256] = (1 << 14 - text_code().astype(np.int64)) * 16
    counts[256:] = 16
    return code_lengths(counts, 14), code_lengths(np.ones(40, np.int64), 8)


def _residual_code() -> np.ndarray:
    """Code lengths for differences: the nearer to zero, the shorter."""
    away = np.minimum(np.arange(256), 256 - np.arange(256))
    return code_lengths(np.maximum(1, 20_000 // (1 + away) ** 2), 12)


@dataclass(frozen=True)
class Fixed:
    """A header with its codes: bits, their number, and (code, width) of the green, red, blue and distance alphabets."""

    value: int
    bits: int
    codes: tuple
    widths: tuple


def _fixed(subtract: bool) -> Fixed:
    green, distance = _copy_codes()
    side = _residual_code() if subtract else text_code()
    out = BitWriter()
    if subtract:
        out.put(1 | GREEN << 1, 3)
    out.put(0, 3)  # no more transforms, no colour cache, one group
    for lengths in (green, side, side):
        put_code(out, lengths)
    put_one(out, 255)
    put_code(out, distance)
    alphabets = (green, side, side, distance)
    return Fixed(out.value, out.n, tuple(reversed_codes(x) for x in alphabets), tuple(x.astype(np.int64) for x in alphabets))


_PLAIN, _SUBTRACTED = _fixed(False), _fixed(True)


def prefix_number(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, extra bits) of a length or a distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    extra = value.bit_length() - 2
    return 2 * (extra + 1) + ((value >> extra) & 1), value & ((1 << extra) - 1), extra


def repeats(pixels: np.ndarray, owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of runs that stand earlier in the same payload, from left to right; places among all pixels.

    begin and end are the bounds of each payload, owner the payload of each
    pixel. One run of MATCH pixels in SAMPLED, chosen by its hash, is looked for;
    what is found grows to both sides.
    """
    if len(pixels) < MATCH:
        return []
    run = pixels.astype(np.uint64)
    for step in (1, 2, 4):  # of two, four and eight pixels
        run = mix(run[:-step] * np.uint64(0x9E3779B97F4A7C15) + run[step:])
    inside = np.flatnonzero((owner[: len(run)] == owner[MATCH - 1 :]) & (run % np.uint64(SAMPLED) == 0))
    key = mix(run[inside] + owner[inside].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    before = dict(zip(inside[order[again + 1]].tolist(), inside[order[again]].tolist(), strict=True))
    found, free = [], 0
    for at in sorted(before):
        if at < free:
            continue
        source, first = before[at], int(begin[owner[at]])
        left = min(at - max(free, first), source - first)
        differ = np.flatnonzero(pixels[at - left : at] != pixels[source - left : source])
        left = left - 1 - int(differ[-1]) if len(differ) else left
        at, source = at - left, source - left
        room = min(MOST_MATCH, int(end[owner[at]]) - at)
        differ = np.flatnonzero(pixels[at : at + room] != pixels[source : source + room])
        length = int(differ[0]) if len(differ) else room
        if length >= MATCH:
            found.append((at, length, at - source))
            free = at + length
    return found


def _shape(pixels: int) -> tuple[int, int]:
    """Width and height that hold so many pixels: a multiple of WIDTH for one row, more where there would be too many rows."""
    width = WIDTH * -(-pixels // (WIDTH * MOST_SIDE))
    return width, -(-pixels // width)


def _riff(body: bytes) -> bytes:
    pad = len(body) & 1
    return b"RIFF" + (len(body) + pad + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + b"\0" * pad


def with_palette(pixels: np.ndarray, width: int, height: int) -> bytes:
    """A file of at most 16 different pixels: a palette and packed indices under flat codes."""
    colours, index = np.unique(pixels, return_inverse=True)
    packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
    out = BitWriter()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)
    out.put(1 | PALETTE << 1, 3)
    out.put(len(colours) - 1, 8)
    flat = np.full(256, 8, np.uint8)
    codes = reversed_codes(flat)

    def image(parts: np.ndarray, channels: int, main: bool) -> None:
        out.put(0, 2 if main else 1)
        put_code(out, np.append(flat, np.zeros(24, np.uint8)))
        for k in (1, 2):
            put_code(out, flat) if channels > k else put_one(out, 0)
        put_one(out, 255)
        put_one(out, 0)
        out.put(int.from_bytes(codes[parts.ravel()].astype(np.uint8).tobytes(), "little"), 8 * parts.size)  # eight bits each

    deltas = np.diff(colours.view(np.uint8).reshape(-1, 4)[:, [1, 2, 0]], axis=0, prepend=np.zeros((1, 3), np.uint8))  # green, red, blue; alpha is held below
    # alpha of the first colour is 255 and does not change, so its differences are 255 and then 0: the palette's first entry is spelled by itself
    out_alpha = len(colours) > 1
    if out_alpha:
        out.put(0, 1)
        put_code(out, np.append(flat, np.zeros(24, np.uint8)))
        put_code(out, flat)
        put_code(out, flat)
        two = np.zeros(256, np.uint8)
        two[[0, 255]] = 1
        put_code(out, two)
        put_one(out, 0)
        alpha = reversed_codes(two)
        for k, row in enumerate(deltas.tolist()):
            for value in row:
                out.put(int(codes[value]), 8)
            out.put(int(alpha[0 if k else 255]), 1)
    else:
        image(deltas, 3, main=False)
    out.put(0, 1)  # no more transforms
    each, per = 8 >> packed, 1 << packed
    rows = np.zeros((height, -(-width // per) * per), np.uint32)
    rows[:, :width] = index.reshape(height, width)
    image((rows.reshape(height, -1, per) << (np.arange(per) * each).astype(np.uint32)).sum(2), 1, main=True)
    return _riff(b"\x2f" + out.value.to_bytes((out.n + 7) // 8 + 1, "little"))


def encode(payloads: list[bytes]) -> list[bytes]:
    """One file for each payload; sizes are positive multiples of PAD."""
    shapes = [_shape(len(p) // 3) for p in payloads]
    sizes = np.array([w * h for w, h in shapes], np.int64)  # in pixels
    end = np.cumsum(sizes)
    begin = end - sizes
    owner = np.repeat(np.arange(len(payloads)), sizes)
    whole = np.frombuffer(b"".join(p + b"\0" * (3 * int(n) - len(p)) for p, n in zip(payloads, sizes, strict=True)), np.uint8).reshape(-1, 3)
    pixels = np.uint32(0xFF000000) | whole[:, 0].astype(np.uint32) << 16 | whole[:, 1].astype(np.uint32) << 8 | whole[:, 2]
    green, red, blue = whole[:, 1], whole[:, 0], whole[:, 2]
    less_red, less_blue = red - green, blue - green
    value, width = (np.stack([table[k][x] for k, x in enumerate((green, red, blue))], axis=1) for table in (_PLAIN.codes, _PLAIN.widths))
    plain = np.add.reduceat(width.sum(1), begin) + _PLAIN.bits
    subtract = np.add.reduceat(_SUBTRACTED.widths[0][green] + _SUBTRACTED.widths[1][less_red] + _SUBTRACTED.widths[2][less_blue], begin) + _SUBTRACTED.bits < plain
    for i in np.flatnonzero(subtract):
        part = slice(int(begin[i]), int(end[i]))
        for k, x in enumerate((green, less_red, less_blue)):
            value[part, k], width[part, k] = _SUBTRACTED.codes[k][x[part]], _SUBTRACTED.widths[k][x[part]]
    for at, length, distance in repeats(pixels, owner, begin, end):
        f = _SUBTRACTED if subtract[owner[at]] else _PLAIN
        (a, x, n), (b, y, m) = prefix_number(length), prefix_number(distance + 120)
        value[at : at + length], width[at : at + length] = 0, 0
        # the four parts take the place of the first pixels' samples
        value[at], width[at] = (f.codes[0][256 + a], x, f.codes[3][b]), (f.widths[0][256 + a], n, f.widths[3][b])
        value[at + 1, 0], width[at + 1, 0] = y, m
    value, width = value.ravel(), width.ravel()
    total = np.concatenate(([0], np.cumsum(width)))
    bits = total[3 * end] - total[3 * begin]
    top = 32 + np.where(subtract, _SUBTRACTED.bits, _PLAIN.bits)
    stream = (top + bits + 7) // 8 + 1  # with the signature byte
    padded = stream + (stream & 1)
    first = np.concatenate(([0], np.cumsum(padded + 20)[:-1]))
    at = total[:-1] + np.repeat((first + 21) * 8 + top - total[3 * begin], 3 * sizes)
    spread, byte = value.astype(np.uint64) << (at & 7).astype(np.uint64), at >> 3
    out = np.zeros(int(first[-1] + padded[-1] + 20) + 4, np.uint8)
    for k in range(4):
        part = (spread >> np.uint64(8 * k)) & np.uint64(255)
        some = np.flatnonzero(part) if k == 3 else slice(None)
        out += np.bincount(byte[some] + k, weights=part[some], minlength=len(out)).astype(np.uint8)
    files, few = [], [len(np.unique(pixels[a:b])) <= 16 for a, b in zip(begin, end, strict=True)]
    for i, (b, n, (w, h)) in enumerate(zip(first.tolist(), stream.tolist(), shapes, strict=True)):
        if few[i]:
            files.append(with_palette(pixels[begin[i] : end[i]], w, h))
            continue
        f, even = _SUBTRACTED if subtract[i] else _PLAIN, n + (n & 1)
        head = b"RIFF" + (even + 12).to_bytes(4, "little") + b"WEBPVP8L" + n.to_bytes(4, "little") + b"\x2f"
        lead = np.frombuffer(head + ((w - 1) | (h - 1) << 14 | f.value << 32).to_bytes((int(top[i]) + 7) // 8, "little"), np.uint8)
        out[b : b + len(lead)] |= lead
        files.append(out[b : b + even + 20].tobytes())
    return files


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's bytes, padded with blanks, as lossless WebP; written to the shared folder.

    Null and empty texts are one row of blanks; repeated rows are stored each; null ids pass through.
    """

    def write(batches: Iterator[pa.RecordBatch]):
        for batch, texts in chunks(batches, limit=1 << 20):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            media = encode([r + b" " * (PAD - len(r) % PAD if len(r) % PAD or not r else 0) for r in raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "doc_id long, n_bytes long, media binary"), "webp")


def read_pixels(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, height, width, samples (the red, green and blue of all pixels, row by row) of every stored value."""
    shape = "doc_id long, n_bytes long, media binary, height int, width int, samples binary"

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            column, begin = batch.column(2), 0
            while begin < len(batch):
                media, held = [], 0
                while begin + len(media) < len(batch) and held < 12 << 20:
                    media.append(column[begin + len(media)].as_py())
                    held += len(media[-1])
                images = decode(media)
                samples = [np.ascontiguousarray(p.view(np.uint8).reshape(*p.shape, 4)[:, :, 2::-1]).tobytes() for p in images]
                part = batch.slice(begin, len(media))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([p.shape[0] for p in images], pa.int32()), pa.array([p.shape[1] for p in images], pa.int32()), pa.array(samples, pa.binary())], names=[c.split()[0] for c in shape.split(", ")])
                begin += len(media)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, shape)


def read_features(stored: DataFrame) -> DataFrame:
    """What the pixel arrays of every stored value hold: sizes, digests and a feature string (the image's width and height, bytes of text before its blanks, the payload's crc32).

    The payload is the samples up to the padded size of the text.
    """
    size = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / PAD)) * PAD
    payload = F.substr(F.col("samples"), F.lit(1), size.cast("int"))
    rows = read_pixels(stored).withColumn("payload", payload)
    text = F.octet_length(F.rtrim(F.col("payload").cast("string")))  # bytes before the blanks at its end
    feature = F.concat_ws(" ", F.concat_ws("x", "width", "height"), F.lit("text"), text.cast("string"), F.lit("crc"), F.crc32("payload").cast("string"))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substr(F.col("payload"), F.octet_length("payload") - 15, F.lit(16))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
