"""Media columns: progressive JPEG files decoded to RGB tensors with numpy.

Scans of spectral selection and successive approximation are accumulated into coefficient arrays; the coefficients are
dequantized, inverse-transformed, chroma is upsampled and the colours converted. Entropy-coded segments between restart markers
are lanes: the lanes of all files of a batch advance together, a symbol at a time (a block at a time in refinement scans).

A payload of bytes is held in such a file losslessly: its bytes are the quantized coefficients, byte b as b where b > 127, else b - 255,
so that each has eight magnitude bits. Blocks fill MCUs of 4:2:0 images (four of Y, one of Cb, one of Cr).
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import batches_of, table, written


def zigzag() -> np.ndarray:
    """Natural place of each coefficient in scan order: along the diagonals of the block, up and down in turn."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


NATURAL = zigzag()
UNIT = 576
EVERY = 4  # MCUs between restart markers


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman(kind: int, by_length: dict[int, list[int]]) -> bytes:
    return segment(0xC4, bytes([kind, *(len(by_length.get(i, [])) for i in range(1, 17))]) + bytes(s for i in range(1, 17) for s in by_length.get(i, [])))


DC_LENGTH = 4
TABLES = huffman(0x00, {DC_LENGTH: list(range(12))}) + huffman(0x10, {1: [0x07], 2: [0x00]}) + huffman(0x11, {1: [0x00], 2: [0x01]})
#: components, Ss, Se, Ah, Al, AC table
SCANS = [((0, 1, 2), 0, 0, 0, 1, 0), ((0,), 1, 5, 0, 1, 0), ((0,), 6, 63, 0, 1, 0), ((1,), 1, 63, 0, 1, 0), ((2,), 1, 63, 0, 1, 0), ((0, 1, 2), 0, 0, 1, 0, 0), ((0,), 1, 63, 1, 0, 1), ((1,), 1, 63, 1, 0, 1), ((2,), 1, 63, 1, 0, 1)]


def joined_intervals(rows: np.ndarray, per: int) -> bytes:
    """Rows of whole bytes as entropy-coded data: stuffed, a restart marker after each per rows."""
    n = len(rows)
    out = []
    for i in range(0, n, per):
        out.append(rows[i : i + per].tobytes().replace(b"\xff", b"\xff\x00"))
    return b"".join(x + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(out) else b"") for i, x in enumerate(out))


def packed(values: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> list[bytes]:
    """Bits of values (sizes[i] low bits each, 16 at most), each group padded with ones to whole bytes. Groups run on without gaps."""
    out = []
    bounds = np.searchsorted(groups, np.arange(int(groups[-1]) + 2))
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        bits = (values[i:j, None] >> np.arange(15, -1, -1)) & 1
        x = bits[np.arange(15, -1, -1) < sizes[i:j, None]].astype(np.uint8)
        out.append(np.packbits(np.append(x, np.ones(-len(x) % 8, np.uint8))).tobytes())
    return out


def with_markers(parts: list[bytes]) -> bytes:
    return b"".join(p.replace(b"\xff", b"\xff\x00") + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))


def store_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload; the comment says how long that is. Blocks beyond it repeat byte 255."""
    mcus = -(-len(payload) // 384)
    wide = max(1, min(int(mcus**0.5), 4000))
    high = -(-mcus // wide)
    n = wide * high
    data = np.full(n * 384, 255, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    mcu = data.reshape(n, 6, 64)
    # blocks of a component in rows: an MCU has two columns and rows of Y
    y = mcu[:, :4].reshape(high, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    planes = [y, np.ascontiguousarray(mcu[:, 4]), np.ascontiguousarray(mcu[:, 5])]
    head = b"\xff\xd8" + segment(0xFE, b"payload %d" % len(payload)) + segment(0xDB, b"\0" + b"\1" * 64)
    head += segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + TABLES + segment(0xDD, struct.pack(">H", EVERY))
    out = [head]
    dc = mcu[:, :, 0].astype(np.int32)
    dc = np.where(dc > 127, dc, dc - 255)
    group = np.repeat(np.arange(n) // EVERY, 6)
    for comps, first, last, before, low, ac in SCANS:
        out.append(segment(0xDA, bytes([len(comps), *(b for c in comps for b in (c + 1, ac)), first, last, before << 4 | low])))
        if first == 0 and not before:
            v = dc >> 1
            diff = np.empty_like(v)
            opens = np.arange(n) % EVERY == 0
            diff[:, 1:4] = v[:, 1:4] - v[:, :3]
            diff[:, 0] = v[:, 0] - np.where(opens, 0, np.append(0, v[:-1, 3]))
            for c in (4, 5):
                diff[:, c] = v[:, c] - np.where(opens, 0, np.append(0, v[:-1, c]))
            d = diff.ravel()
            size = np.ceil(np.log2(np.abs(d) + 1)).astype(np.int32)
            out.append(with_markers(packed((size << size) | (np.where(d < 0, d - 1, d) & ((1 << size) - 1)), size + DC_LENGTH, group)))
        elif first == 0:
            out.append(with_markers(packed((dc & 1).ravel(), np.ones(6 * n, np.int32), group)))
        elif not before:
            b = planes[comps[0]][:, first : last + 1]
            out.append(joined_intervals(b >> 1, EVERY))  # code 0, then seven bits
        else:
            b = planes[comps[0]][:, 1:]
            bits = np.zeros((len(b), 64), np.uint8)
            bits[:, 1:] = np.where(b > 127, b & 1, 1 - (b & 1))  # code 0 ends the run of zeros, then a correction for each
            out.append(joined_intervals(np.packbits(bits, axis=1), EVERY))
    return b"".join([*out, b"\xff\xd9"])


@dataclass
class Scan:
    comps: tuple[int, ...]
    first: int
    last: int
    before: int
    low: int
    tables: tuple[bytes, ...]
    restart: int
    start: int
    end: int


@dataclass
class Picture:
    width: int
    height: int
    sampling: tuple[tuple[int, int], ...]
    quant: tuple[bytes, ...]
    comment: bytes
    scans: list[Scan] = field(default_factory=list)

    @cached_property
    def layout(self) -> tuple[tuple[int, int], list[tuple[int, int]]]:
        """Columns and rows of MCUs, and of the blocks that a scan of each component alone holds."""
        h, v = max(s[0] for s in self.sampling), max(s[1] for s in self.sampling)
        return (-(-self.width // (8 * h)), -(-self.height // (8 * v))), [(-(-(-(-self.width * a // h)) // 8), -(-(-(-self.height * b // v)) // 8)) for a, b in self.sampling]

    def mcus(self) -> tuple[int, int]:
        return self.layout[0]

    def grid(self, c: int) -> tuple[int, int]:
        """Columns and rows of blocks of a component, in whole MCUs."""
        w, h = self.mcus()
        return w * self.sampling[c][0], h * self.sampling[c][1]

    def shown(self, c: int) -> tuple[int, int]:
        """Columns and rows of blocks that a scan of this component alone holds."""
        return self.layout[1][c]


def parse(raw: bytes, base: int, stops: np.ndarray) -> Picture:
    """Headers of one file. stops: places, counted from the batch's start, of markers that end entropy-coded data."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, quant, tables, restart, comment, pic, ids = 2, {}, {}, 0, b"", None, []
    while raw[at + 1] != 0xD9:
        marker, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.pack(">64H", *struct.unpack(">64H" if wide else ">64B", body[1 : 129 if wide else 65]))
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xC2:
            _, h, w, n = struct.unpack_from(">BHHB", body)
            ids = [body[6 + 3 * i] for i in range(n)]
            pic = Picture(w, h, tuple((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)), tuple(quant[body[8 + 3 * i]] for i in range(n)), comment)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("only progressive Huffman-coded JPEG is read here")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            n = body[0]
            comps = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            first, last, how = body[1 + 2 * n : 4 + 2 * n]
            used = tuple(tables.get(body[2 + 2 * i] >> 4, b"") for i in range(n)) if first == 0 else (tables[0x10 | body[2] & 15],)
            end = int(stops[np.searchsorted(stops, base + at)])
            pic.scans.append(Scan(comps, first, last, how >> 4, how & 15, used, restart, base + at, end))
            at = end - base
    return pic


_lookups: dict[bytes, np.ndarray] = {}


def lookup(spec: bytes) -> np.ndarray:
    """For each 16 bits: code length << 8 | symbol; 0 where no code fits."""
    if spec not in _lookups:
        out = np.zeros(65536, np.int64)
        code, at = 0, 16
        for size in range(1, 17):
            for _ in range(spec[size - 1]):
                out[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | spec[at]
                code += 1
                at += 1
            code <<= 1
        _lookups[spec] = out
    return _lookups[spec]


class Lanes:
    """Bits of the restart intervals of some scans, and for each lane where it starts."""

    def __init__(self, data: np.ndarray, restarts: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        lo, hi = np.searchsorted(restarts, starts), np.searchsorted(restarts, ends)
        n = hi - lo + 1
        self.owner = np.repeat(np.arange(len(starts)), n)
        self.number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        inner = restarts[np.repeat(lo, n) + self.number - 1] if len(restarts) else np.zeros(n.sum(), np.int64)
        begin = np.where(self.number == 0, starts[self.owner], inner + 2)
        after = restarts[np.minimum(np.repeat(lo, n) + self.number, len(restarts) - 1)] if len(restarts) else begin
        stop = np.where(self.number == n[self.owner] - 1, ends[self.owner], after)
        size = stop - begin
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        b = data[at]
        keep = ~((b == 0) & (data[at - 1] == 0xFF) & (at > np.repeat(begin, size)))
        real = np.append(0, np.cumsum(keep))
        self.bit = real[np.cumsum(size) - size] * 8
        b = np.append(b[keep], np.full(16, 0xFF, np.uint8))
        self.bytes = b
        w = b[:-7].astype(np.uint64)
        for i in range(1, 8):
            w = (w << np.uint64(8)) | b[i : len(b) - 7 + i]
        self.words = w

    def peek(self, bit: np.ndarray) -> np.ndarray:
        """The next 57 bits and more, at the top of a word."""
        return self.words[np.minimum(bit >> 3, len(self.words) - 1)] << (bit & 7).astype(np.uint64)

    def get(self, bit: np.ndarray) -> np.ndarray:
        return (self.bytes[np.minimum(bit >> 3, len(self.bytes) - 1)] >> (7 - (bit & 7)).astype(np.uint8)) & 1


def extra(word: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    """size bits after skip bits."""
    return (((word << skip.astype(np.uint64)) >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)


def signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits) * (size > 0)


def places(pics: list[Picture], bases: list[np.ndarray], owner: np.ndarray, c: int, number: np.ndarray, alone: bool) -> np.ndarray:
    """Index, among the batch's blocks of component c, of the number-th block that a scan of it alone holds."""
    grid = np.array([p.grid(c)[0] for p in pics])[owner]
    shown = np.array([p.shown(c)[0] for p in pics])[owner]
    return bases[c][owner] + number // shown * grid + number % shown


def dc_scan(s: Scan, pics: list[Picture], lanes: Lanes, coef: list[np.ndarray], bases: list[np.ndarray], counts: np.ndarray) -> None:
    per = s.restart or int(counts.max())
    owner, bit = lanes.owner, lanes.bit.copy()
    todo = np.minimum(counts[owner] - lanes.number * per, per)
    mcu_cols = np.array([p.mcus()[0] for p in pics])[owner]
    alone = len(s.comps) == 1
    steps = [(i, c, x, y) for i, c in enumerate(s.comps) for y in range(1 if alone else pics[0].sampling[c][1]) for x in range(1 if alone else pics[0].sampling[c][0])]
    before = np.zeros((len(owner), len(s.comps)), np.int64)
    for t in range(int(todo.max(initial=0))):
        live = np.flatnonzero(todo > t)
        unit = lanes.number[live] * per + t
        for i, c, x, y in steps:
            if alone:
                at = places(pics, bases, owner[live], c, unit, True)
            else:
                h, v = pics[0].sampling[c]
                at = bases[c][owner[live]] + (unit // mcu_cols[live] * v + y) * (mcu_cols[live] * h) + unit % mcu_cols[live] * h + x
            if s.before:
                coef[c][at, 0] |= (lanes.get(bit[live]).astype(np.int64) << s.low).astype(coef[c].dtype)
                bit[live] += 1
                continue
            w = lanes.peek(bit[live])
            code = lookup(s.tables[i])[(w >> np.uint64(48)).astype(np.int64)]
            size = code & 15
            before[live, i] += signed(extra(w, code >> 8, size), size)
            coef[c][at, 0] = before[live, i] << s.low
            bit[live] += (code >> 8) + size


def ac_first(s: Scan, pics: list[Picture], lanes: Lanes, coef: list[np.ndarray], bases: list[np.ndarray], counts: np.ndarray) -> None:
    c = s.comps[0]
    per = s.restart or int(counts.max())
    flat = coef[c].reshape(-1)
    table = lookup(s.tables[0])
    first = lanes.number * per
    todo = np.minimum(counts[lanes.owner] - first, per)
    live = np.flatnonzero(todo > 0)
    owner, bit, first, todo = lanes.owner[live], lanes.bit[live], first[live], todo[live]
    done, k = np.zeros(len(live), np.int64), np.full(len(live), s.first)
    at = places(pics, bases, owner, c, first, True) * 64
    while len(owner):
        w = lanes.peek(bit)
        code = table[(w >> np.uint64(48)).astype(np.int64)]
        length, run, size = code >> 8, (code >> 4) & 15, code & 15
        if not length.all():
            raise ValueError("a code that the table lacks")
        value = size > 0
        k += run
        v = signed(extra(w, length, size), size) << s.low
        if value.all():
            flat[at + NATURAL[k]] = v
            bit += length + size
            k += 1
            ended = k > s.last
            skip = ended.astype(np.int64)
        else:
            i = np.flatnonzero(value)
            flat[at[i] + NATURAL[k[i]]] = v[i]
            stop = ~value & (run < 15)
            more = np.where(stop, run, 0)
            skip = np.where(stop, (1 << more) + extra(w, length, more), 0)
            bit += length + np.where(value, size, more)
            k += 1
            skip[~stop] = k[~stop] > s.last
            ended = skip > 0
        if ended.any():
            done += skip
            k[ended] = s.first
            go = done < todo
            if not go.all():
                owner, bit, first, todo, done, k, at, ended = (x[go] for x in (owner, bit, first, todo, done, k, at, ended))
            at[ended] = places(pics, bases, owner[ended], c, first[ended] + done[ended], True) * 64


def ac_refine(s: Scan, pics: list[Picture], lanes: Lanes, coef: list[np.ndarray], bases: list[np.ndarray], counts: np.ndarray) -> None:
    c = s.comps[0]
    per = s.restart or int(counts.max())
    table, band = lookup(s.tables[0]), NATURAL[s.first : s.last + 1]
    one = 1 << s.low
    first = lanes.number * per
    todo = np.minimum(counts[lanes.owner] - first, per)
    live = np.flatnonzero(todo > 0)
    owner, bit, first, todo = lanes.owner[live], lanes.bit[live].copy(), first[live], todo[live]
    done, k, ends = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    col = np.arange(len(band))
    while len(owner):
        at = places(pics, bases, owner, c, first + done, True)
        block = coef[c][at[:, None], band]
        old = (block != 0) & (col >= k[:, None])
        fresh = ends == 0
        w = lanes.peek(bit)
        code = np.where(fresh, table[(w >> np.uint64(48)).astype(np.int64)], 0)
        length, run, size = code >> 8, (code >> 4) & 15, code & 15
        stop = fresh & (size == 0) & (run < 15)
        more = np.where(stop, run, 0)
        ends = np.where(stop, (1 << more) + extra(w, length, more), ends)
        sign = extra(w, length, size)
        bit = bit + length + np.where(stop, more, size)
        zero = (block == 0) & (col >= k[:, None])
        whole = ends > 0
        hit = (np.cumsum(zero, 1) == run[:, None] + 1) & zero & ~whole[:, None]
        found = hit.any(1)
        to = np.where(found, hit.argmax(1), len(band))
        old &= col < to[:, None]
        read = np.cumsum(old, 1)
        fix = lanes.get(bit[:, None] + read - 1).astype(bool) & old & ((np.abs(block) & one) == 0)
        block = block + np.where(fix, np.where(block > 0, one, -one), 0)
        bit = bit + read[:, -1]
        new = np.flatnonzero(found & (size > 0))
        block[new, to[new]] = np.where(sign[new] > 0, one, -one)
        coef[c][at[:, None], band] = block
        k = to + 1
        over = k >= len(band)
        ends = np.where(whole, ends - 1, ends)
        done = done + over
        k[over] = 0
        go = done < todo
        if not go.all():
            owner, bit, first, todo, done, k, ends = (x[go] for x in (owner, bit, first, todo, done, k, ends))


def coefficients(files: list[bytes]) -> tuple[list[Picture], list[list[np.ndarray]]]:
    """Headers, and quantized coefficients [block, 64] of each component in natural order, of each file."""
    data = np.frombuffer(b"".join(files) + b"\0\0", np.uint8)
    bases = np.cumsum([0, *map(len, files)])[:-1]
    ff = np.flatnonzero(data[:-1] == 0xFF)
    then = data[ff + 1]
    rst = (then >= 0xD0) & (then <= 0xD7)
    restarts, stops = ff[rst], ff[(then != 0) & ~rst]
    pics = [parse(f, int(b), stops) for f, b in zip(files, bases, strict=True)]
    most = max((len(p.sampling) for p in pics), default=0)
    sizes = [np.array([np.prod(p.grid(c)) if c < len(p.sampling) else 0 for p in pics]) for c in range(most)]
    firsts = [np.cumsum(s) - s for s in sizes]
    coef = [np.zeros((int(s.sum()), 64), np.int16) for s in sizes]
    for j in range(max((len(p.scans) for p in pics), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, p in enumerate(pics):
            if j < len(p.scans):
                s = p.scans[j]
                groups.setdefault((s.comps, s.first, s.last, s.before, s.low, s.tables, s.restart, p.sampling), []).append(i)
        for members in groups.values():
            s, own = pics[members[0]].scans[j], [pics[i] for i in members]
            at = [f[members] for f in firsts]
            lanes = Lanes(data, restarts, np.array([p.scans[j].start for p in own]), np.array([p.scans[j].end for p in own]))
            if len(s.comps) == 1:
                counts = np.array([math.prod(p.shown(s.comps[0])) for p in own])
            else:
                counts = np.array([math.prod(p.mcus()) for p in own])
            (dc_scan if s.first == 0 else ac_refine if s.before else ac_first)(s, own, lanes, coef, at, counts)
    return pics, [[coef[c][firsts[c][i] : firsts[c][i] + sizes[c][i]] for c in range(len(p.sampling))] for i, p in enumerate(pics)]


# Cosines in fixed point; all sums stay below 2**53, so that floats hold them exactly and their order doesn't matter.
COSINES = np.round(np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.125**0.5) for x in range(8)] for u in range(8)]) * 2**13)


def tensor(pic: Picture, coef: list[np.ndarray]) -> np.ndarray:
    """RGB (or grey, one channel) [height, width, channel] of 8-bit samples."""
    h, v = max(s[0] for s in pic.sampling), max(s[1] for s in pic.sampling)
    planes = []
    for c, blocks in enumerate(coef):
        q = np.empty(64)
        q[NATURAL] = np.frombuffer(pic.quant[c], ">u2")
        x = (blocks * q).reshape(-1, 8) @ COSINES  # rows
        x = np.ascontiguousarray(x.reshape(-1, 8, 8).transpose(0, 2, 1)).reshape(-1, 8) @ COSINES  # columns
        cols, rows = pic.grid(c)
        x = np.clip(np.floor(x / 2**26 + 128.5), 0, 255).reshape(rows, cols, 8, 8).transpose(0, 3, 1, 2).reshape(rows * 8, cols * 8)
        a, b = v // pic.sampling[c][1], h // pic.sampling[c][0]
        x = x if a == 1 else np.repeat(x, a, 0)
        x = x if b == 1 else np.repeat(x, b, 1)
        planes.append(x[: pic.height, : pic.width])
    if len(planes) == 1:
        return planes[0].astype(np.uint8)[:, :, None]
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)


def read_payload(pic: Picture, coef: list[np.ndarray]) -> bytes:
    """The bytes that store_payload held."""
    wide, high = pic.mcus()
    mcu = np.empty((wide * high, 6, 64), np.uint8)
    back = [np.where(x > 0, x, x + 255).astype(np.uint8)[:, NATURAL] for x in coef]
    mcu[:, :4] = back[0].reshape(high, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    mcu[:, 4], mcu[:, 5] = back[1], back[2]
    return mcu.tobytes()[: int(pic.comment.split()[1])]


def decoded(files: list[bytes | None]) -> list[tuple[Picture | None, list[np.ndarray] | None, str | None]]:
    """Picture, coefficients and error of each file: null has neither, what can't be read has an error. Files are read side by side."""
    there = [m for m in files if m is not None]
    try:
        got = [(p, c, None) for p, c in zip(*coefficients(there), strict=True)] if there else []
    except Exception:  # one of them can't be read: each is read for itself
        got = []
        for m in there:
            try:
                (p,), (c,) = coefficients([m])
                got.append((p, c, None))
            except Exception as e:
                got.append((None, None, f"{type(e).__name__}: {e}"))
    done = iter(got)
    return [(None, None, None) if m is None else next(done) for m in files]


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, width, height, channels, the RGB tensor as row-major bytes, and an error. Null media give null tensors; a file that can't be read gives a null tensor and an error."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            raw = [None if m is None else bytes(m) for m in pdf.m]
            for a, b in batches_of([m or b"" for m in raw], 2_000_000):
                rows = []
                for p, c, error in decoded(raw[a:b]):
                    try:
                        rows.append((None, error) if p is None else (tensor(p, c), None))
                    except Exception as e:
                        rows.append((None, f"{type(e).__name__}: {e}"))
                shape = lambda k: pd.array([None if x is None else x.shape[k] for x, _ in rows], "Int32")  # noqa: E731, B023
                yield pd.DataFrame({"doc_id": pdf.i[a:b].to_numpy(), "width": shape(1), "height": shape(0), "channels": shape(2), "tensor": [None if x is None else x.tobytes() for x, _ in rows], "error": [e for _, e in rows]})

    return media.select(F.col(id_col).cast("long").alias("i"), F.col(media_col).alias("m")).mapInPandas(run, "doc_id long, width int, height int, channels int, tensor binary, error string")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text as UTF-8, filled with bytes 255 to a positive multiple of 576, in a progressive JPEG. Null is an empty text."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = pdf.t.tolist()
            for a, b in batches_of([t or "" for t in texts], 4_000_000):
                raw = [(t or "").encode("utf-8", "replace") for t in texts[a:b]]
                yield pd.DataFrame({"doc_id": pdf.i[a:b], "n_bytes": [len(r) for r in raw], "media": [store_payload(r + b"\xff" * (-len(r) % UNIT or (0 if r else UNIT))) for r in raw]})

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInPandas(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """What is read back from the stored files: payload checks, and size, channel means and deviations of the RGB tensor. Of a file that can't be read only size and sum are known, and the error is its feature."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            raw = [bytes(m) for m in pdf.media]
            for a, b in batches_of(raw, 1_000_000):
                out = []
                for i, n, m, (p, c, error) in zip(pdf.doc_id[a:b], pdf.n_bytes[a:b], raw[a:b], decoded(raw[a:b]), strict=True):
                    if p is None:
                        out.append((i, n, None, None, None, len(m), hashlib.sha256(m).hexdigest(), error))
                        continue
                    payload, rgb = read_payload(p, c), tensor(p, c).reshape(-1, 3)
                    total, square = rgb.sum(0, dtype=np.int64), [int(np.dot(x, x)) for x in rgb.T.astype(np.float64)]
                    mean = total / len(rgb)
                    spread = [max(q / len(rgb) - m * m, 0) ** 0.5 for q, m in zip(square, mean, strict=True)]
                    feature = f"{p.width}x{p.height} " + " ".join(f"{x:.4f}/{y:.4f}" for x, y in zip(mean, spread, strict=True))
                    out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in FEATURES.split(", ")]).astype({"payload_bytes": "Int64", "tail_crc32": "Int64"})

    return media.mapInPandas(run, FEATURES)


def op5_progressive_jpeg(spark, sf_dir: str) -> DataFrame:
    """Every text as the coefficients of a progressive JPEG, written to a media table, read back and decoded."""
    return media_features(written(store_texts(table(spark, sf_dir, "documents")), "media"))
