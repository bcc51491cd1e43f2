"""Baseline JPEG in numpy: a decoder for any baseline file, and an encoder that stores bytes losslessly as coefficients.

The decoder parses markers, splits the scan at restart markers and Huffman-decodes all restart intervals of all files of a batch
in step: one table look-up per interval and symbol, for all intervals at once. DC coefficients alone give the luminance thumbnail.

The encoder writes a payload of 64-byte groups as one grey image: a group is the 64 quantised coefficients of a block in zigzag
order (bytes as signed numbers; quantisation 1), each block a restart interval. A comment holds the payload's length.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

PAYLOAD = b"payload-bytes="
#: Blocks that are coded at a time.
BLOCKS = 1 << 13


def _canonical(symbols: Sequence[tuple[int, Sequence[int]]]) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """(length, symbols) groups as DHT counts and values, and code and length by symbol."""
    counts, values = [0] * 16, []
    code_of, length_of = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code = at = 0
    for length, group in symbols:
        code <<= length - at
        at = length
        for s in group:
            counts[length - 1] += 1
            values.append(s)
            code_of[s], length_of[s] = code, length
            code += 1
    return bytes(counts), bytes(values), code_of, length_of


#: Code lengths that suit text: bytes 64-127 have 7 bits, 32-63 have 6.
DC = _canonical([(1, [7]), (2, [6]), (3, [0]), (7, [1, 2, 3, 4, 5, 8, 9, 10, 11])])
AC = _canonical([(1, [7]), (2, [6]), (3, [0]), (6, [1, 2, 3, 4, 5, 8]), (12, [16 * r + s for r in range(1, 16) for s in range(1, 9)] + [0xF0])])
_SIZE = np.array([int(abs(v)).bit_length() for v in range(-128, 128)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def grid(blocks: int) -> tuple[int, int]:
    """Columns and rows of blocks for so many blocks."""
    w = max(1, math.isqrt(max(0, blocks - 1)) + 1)
    return w, max(1, -(-blocks // w))


def _headers(columns: int, rows: int, payload_bytes: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _segment(0xFE, PAYLOAD + str(payload_bytes).encode()),
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, columns * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + DC[0] + DC[1]),
        _segment(0xC4, b"\x10" + AC[0] + AC[1]),
        _segment(0xDD, b"\x00\x01"),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def _entropy(coefficients: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Codes blocks of 64 coefficients as restart intervals. first: the number of each block in its image. Returns the bytes, with
    a restart marker after each block, and where each block ends, marker included."""
    n = len(coefficients)
    value = coefficients.astype(np.int64)
    value_at = value.ravel()
    # Events in order of (block, place): DC, then for each other coefficient that is not 0 its zero runs and itself, then the end.
    block, place = np.nonzero(coefficients[:, 1:])
    place = place + 1
    before = np.concatenate(([0], place[:-1]))
    new = np.concatenate(([True], block[1:] != block[:-1])) if len(block) else np.zeros(0, bool)
    run = place - np.where(new, 0, before[: len(place)]) - 1
    v = value_at[block * 64 + place]
    size = _SIZE[v + 128]
    symbol = (run & 15) * 16 + size
    bits = np.where(v < 0, v + (1 << size) - 1, v)
    dc = value[:, 0]
    dc_size = _SIZE[dc + 128]
    last = np.zeros(n, np.int64)
    last[block] = place  # the greatest place wins: places ascend within a block
    ended = np.flatnonzero(last < 63)
    zrl = np.flatnonzero(run >= 16)
    zrl_times = run[zrl] // 16
    order = np.concatenate([np.arange(n) * 256, block * 256 + place * 2 + 1, ended * 256 + 255, np.repeat(block[zrl] * 256 + place[zrl] * 2, zrl_times)])
    code = np.concatenate([
        (DC[2][dc_size] << dc_size) | np.where(dc < 0, dc + (1 << dc_size) - 1, dc),
        (AC[2][symbol] << size) | bits,
        np.full(len(ended), AC[2][0]),
        np.full(int(zrl_times.sum()), AC[2][0xF0]),
    ])
    length = np.concatenate([DC[3][dc_size] + dc_size, AC[3][symbol] + size, np.full(len(ended), AC[3][0]), np.full(int(zrl_times.sum()), AC[3][0xF0])])
    rank = np.argsort(order, kind="stable")
    code, length, owner = code[rank], length[rank], order[rank] >> 8
    block_bits = np.bincount(owner, length, n).astype(np.int64)
    block_bytes = (block_bits + 7) >> 3
    begin = np.concatenate(([0], np.cumsum(block_bytes)))
    ends = np.cumsum(length)
    block_start_bits = np.concatenate(([0], np.cumsum(block_bits)))[:-1]
    at = ends - length - block_start_bits[owner] + begin[owner] * 8
    word = code << (32 - length - (at & 7))
    q = at >> 3
    heads = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    merged = np.bitwise_or.reduceat(word, heads)
    where = q[heads]
    out = np.zeros(begin[-1] + 4, np.uint8)
    for i in range(4):
        out[where + i] |= ((merged >> (24 - 8 * i)) & 255).astype(np.uint8)
    out = out[: begin[-1]]
    out[begin[1:] - 1] |= ((1 << (block_bytes * 8 - block_bits)) - 1).astype(np.uint8)  # filled with ones
    # Stuffed zeros after 255, and the markers.
    full = out == 255
    shift = np.cumsum(full)
    of_byte = np.repeat(np.arange(n), block_bytes)
    to = np.arange(len(out)) + shift - full + 2 * of_byte
    final = np.zeros(len(out) + int(shift[-1]) + 2 * n, np.uint8)
    final[to] = out
    stop = begin[1:] + shift[begin[1:] - 1] + 2 * np.arange(n)
    final[stop] = 0xFF
    final[stop + 1] = 0xD0 + (first & 7)
    return final.tobytes(), stop + 2


def encode_payloads(payloads: Sequence[bytes]) -> list[bytes]:
    """Each payload (its length a positive multiple of 64) as a JPEG file."""
    out: list[list[bytes]] = []
    jobs: list[tuple[int, int, np.ndarray]] = []  # file, first block, blocks
    for i, p in enumerate(payloads):
        if not p or len(p) % 64:
            raise ValueError("a payload has a positive multiple of 64 bytes")
        w, h = grid(len(p) // 64)
        out.append([_headers(w, h, len(p))])
        data = np.zeros((w * h, 64), np.int8)
        data.reshape(-1)[: len(p)] = np.frombuffer(p, np.int8)
        jobs += [(i, a, data[a : a + BLOCKS]) for a in range(0, w * h, BLOCKS)]
    at = 0
    while at < len(jobs):
        group, n = [], 0
        while at < len(jobs) and (not group or n + len(jobs[at][2]) <= BLOCKS):
            group.append(jobs[at])
            n += len(jobs[at][2])
            at += 1
        coded, ends = _entropy(np.concatenate([g[2] for g in group]), np.concatenate([np.arange(g[1], g[1] + len(g[2])) for g in group]))
        a = k = 0
        for i, _, data in group:
            k += len(data)
            out[i].append(coded[a : int(ends[k - 1])])
            a = int(ends[k - 1])
    return [b"".join(parts)[:-2] + b"\xff\xd9" for parts in out]  # no marker after the last block


@dataclass
class Component:
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class File:
    """A parsed baseline file."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)  # class * 16 + number -> counts and values
    interval: int = 0
    comments: list[bytes] = field(default_factory=list)
    scan: tuple[int, int] = (0, 0)
    ids: list[int] = field(default_factory=list)

    @property
    def mcus(self) -> tuple[int, int]:
        if len(self.components) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = max(c.h for c in self.components), max(c.v for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def pattern(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.components) == 1:
            return [0]
        return [i for i, c in enumerate(self.components) for _ in range(c.h * c.v)]


class JpegError(ValueError):
    pass


def parse(data: bytes) -> File:
    """Markers up to the scan. Progressive, lossless and arithmetic files are refused."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    f, i = File(), 2
    while True:
        if i + 4 > len(data) or data[i] != 0xFF:
            raise JpegError("marker expected")
        marker = data[i + 1]
        if marker == 0xFF:
            i += 1
            continue
        size = int.from_bytes(data[i + 2 : i + 4], "big")
        body = data[i + 4 : i + 2 + size]
        i += 2 + size
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                if wide > 1 or len(body) < 1 + 64 * (1 + wide):
                    raise JpegError("a quantisation table is cut short")
                f.quants[k] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            if f.components or len(body) < 6 or len(body) < 6 + 3 * body[5]:
                raise JpegError("the frame header is cut short or repeated")
            _, f.height, f.width, n = struct.unpack(">BHHB", body[:6])
            for k in range(n):
                c, hv, q = body[6 + 3 * k : 9 + 3 * k]
                if not (1 <= hv >> 4 <= 4 and 1 <= hv & 15 <= 4) or c in f.ids:
                    raise JpegError("sampling factors or numbers of components are wrong")
                f.ids.append(c)
                f.components.append(Component(hv >> 4, hv & 15, q))
            if not 1 <= n <= 4:
                raise JpegError("one to four components are expected")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise JpegError(f"not baseline: marker {marker:x}")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n or n > 256:
                    raise JpegError("a code table is cut short")
                f.tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            if len(body) < 2:
                raise JpegError("the restart interval is cut short")
            f.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            f.comments.append(body)
        elif marker == 0xDA:
            if not f.width or not f.height or not body or body[0] != len(f.components) or len(body) < 1 + 2 * body[0]:
                raise JpegError("one scan of all components is expected")
            for k in range(body[0]):
                if body[1 + 2 * k] not in f.ids:
                    raise JpegError("the scan names an unknown component")
                c = f.components[f.ids.index(body[1 + 2 * k])]
                c.dc, c.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
                if c.dc not in f.tables or 16 + c.ac not in f.tables or c.quant not in f.quants:
                    raise JpegError("a table is missing")
            f.scan = (i, len(data))
            # A block has two codes of a bit each at least.
            if f.mcus[0] * f.mcus[1] * len(f.pattern) * 2 > 8 * (len(data) - i):
                raise JpegError("the scan is too short for the image")
            return f


_luts: dict[bytes, np.ndarray] = {}


def _lut(table: bytes) -> np.ndarray:
    """By the next 16 bits: length * 256 + symbol; 0 where no code fits."""
    if table not in _luts:
        out, code, at = np.zeros(65536, np.int32), 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                a = code << (16 - length)
                if a >= 65536:
                    raise JpegError("a code table has too many codes")
                out[a : a + (1 << (16 - length))] = length * 256 + table[at]
                at += 1
                code += 1
            code <<= 1
        if len(_luts) > 64:
            _luts.clear()
        _luts[table] = out
    return _luts[table]


def _intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffed zeros and markers, and where its intervals begin and end."""
    full = np.flatnonzero(scan[:-1] == 255)
    nxt = scan[full + 1]
    other = np.flatnonzero((nxt != 0) & ((nxt < 0xD0) | (nxt > 0xD7)) & (nxt != 255))
    end = int(full[other[0]]) if len(other) else len(scan)
    full, nxt = full[full < end], nxt[full < end]
    keep = np.ones(end, bool)
    keep[full[nxt == 0] + 1] = False
    marks = full[(nxt >= 0xD0) & (nxt <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    place = np.concatenate(([0], np.cumsum(keep)))
    return scan[:end][keep], np.concatenate((place[marks], place[-1:]))


def decode(files: Sequence[tuple[File, bytes]]) -> list[np.ndarray]:
    """Quantised coefficients in zigzag order, one row per block in the order of the scan, for each file."""
    parts, begins, stops, counts, rows, patterns = [], [], [], [], [], []
    lanes_of, base, row = [], 0, 0
    tables: dict[bytes, int] = {}
    for f, data in files:
        raw, ends = _intervals(np.frombuffer(data, np.uint8)[f.scan[0] : f.scan[1]])
        pattern = f.pattern
        total = f.mcus[0] * f.mcus[1]
        per = f.interval or total
        lanes = -(-total // per)
        if lanes != len(ends):
            raise JpegError(f"{len(ends)} restart intervals, {lanes} expected")
        parts += [raw, np.full(8, 255, np.uint8)]
        b = np.concatenate(([0], ends[:-1])) + base
        n = np.full(lanes, per, np.int64)
        n[-1] = total - per * (lanes - 1)
        begins.append(b)
        stops.append(ends + base)
        counts.append(n * len(pattern))
        rows.append(row + np.concatenate(([0], np.cumsum(n[:-1]))) * len(pattern))
        lanes_of.append(np.full(lanes, len(patterns)))
        patterns.append([(tables.setdefault(f.tables[c.dc], len(tables)), tables.setdefault(f.tables[16 + c.ac], len(tables)), i) for i in pattern for c in [f.components[i]]])
        base += len(raw) + 8
        row += total * len(pattern)
    buf = np.concatenate(parts).astype(np.uint64)
    word = (buf[:-4] << np.uint64(32)) | (buf[1:-3] << np.uint64(24)) | (buf[2:-2] << np.uint64(16)) | (buf[3:-1] << np.uint64(8)) | buf[4:]
    word = word.astype(np.int64)
    lut = np.concatenate([_lut(t) for t in tables])
    out = np.zeros((row, 64), np.int16)
    flat = out.reshape(-1)
    widest = max(map(len, patterns))
    dc_of, ac_of, comp_of = (np.zeros((len(patterns), widest), np.int64) for _ in range(3))
    for i, pat in enumerate(patterns):
        for j, (d, a, c) in enumerate(pat):
            dc_of[i, j], ac_of[i, j], comp_of[i, j] = d << 16, a << 16, c
    width = np.array([len(p) for p in patterns])
    p, stop = np.concatenate(begins) * 8, np.concatenate(stops) * 8
    left, r = np.concatenate(counts), np.concatenate(rows)
    image = np.concatenate(lanes_of)
    j, k = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    predicted = np.zeros((len(p), 4), np.int64)
    lane = np.arange(len(p))
    plain = widest == 1
    dc_table, ac_table = dc_of[image, 0], ac_of[image, 0]
    while len(p):
        peek = (word[p >> 3] >> (8 - (p & 7))) & 0xFFFFFFFF
        first = k == 0
        code = lut[np.where(first, dc_table, ac_table) + (peek >> 16)]
        length, symbol = code >> 8, code & 255
        if not length.all():
            raise JpegError("no such code")
        size = symbol & 15
        used = length + size
        bits = (peek >> (32 - used)) & ((1 << size) - 1)
        v = np.where((bits << 1) >> size == 0, bits - (1 << size) + 1, bits)
        v[size == 0] = 0
        p = p + used
        if first.any():
            if plain:
                at, c = np.flatnonzero(first), 0
            else:
                at = np.flatnonzero(first)
                c = comp_of[image[at], j[at]]
            predicted[lane[at], c] += v[at]
            v[at] = predicted[lane[at], c]
            symbol = np.where(first, 15, symbol)  # neither an end nor a run
            k = np.where(first, 0, k + (code >> 4 & 15))
        else:
            k = k + (symbol >> 4)
        stored = (size > 0) | first
        if not stored.all():
            if (k[stored] > 63).any():
                raise JpegError("a run beyond the block")
            flat[r[stored] * 64 + k[stored]] = v[stored]
            k = np.where(symbol == 0, 63, k)
        else:
            if (k > 63).any():
                raise JpegError("a run beyond the block")
            flat[r * 64 + k] = v
        k = k + 1
        done = k > 63
        if done.any():
            k[done] = 0
            r = r + done
            left = left - done
            if not plain:
                j = np.where(done, (j + 1) % width[image], j)
                dc_table, ac_table = dc_of[image, j], ac_of[image, j]
            over = left == 0
            if over.any():
                if (p[over] > stop[over]).any():
                    raise JpegError("the scan ends early")
                on = ~over
                p, stop, left, r, image, j, k, lane, dc_table, ac_table = (x[on] for x in (p, stop, left, r, image, j, k, lane, dc_table, ac_table))
    sizes = [f.mcus[0] * f.mcus[1] * len(f.pattern) for f, _ in files]
    return np.split(out, np.cumsum(sizes)[:-1])


def thumbnail(f: File, coefficients: np.ndarray) -> np.ndarray:
    """Mean luminance of each 8 x 8 block, from DC alone: rows by columns, 0 to 255."""
    columns, rows = f.mcus
    c = f.components[0]
    dc = coefficients[:, 0].astype(np.float64) * float(f.quants[c.quant][0]) / 8 + 128
    if len(f.components) == 1:
        grid_ = dc.reshape(rows, columns)
    else:
        own = dc.reshape(rows, columns, len(f.pattern))[:, :, : c.h * c.v].reshape(rows, columns, c.v, c.h)
        grid_ = own.transpose(0, 2, 1, 3).reshape(rows * c.v, columns * c.h)
        h, v = max(x.h for x in f.components), max(x.v for x in f.components)
        grid_ = grid_[: -(-f.height * c.v // (8 * v)), : -(-f.width * c.h // (8 * h))]
    return np.clip(grid_, 0, 255)


def resize(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Box means; a side that is too short repeats its nearest lines."""
    def edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.arange(m) * n // m
        return low, np.maximum(np.arange(1, m + 1) * n // m, low + 1)

    total = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    total[1:, 1:] = a.cumsum(0).cumsum(1)
    (a0, a1), (b0, b1) = edges(a.shape[0], rows), edges(a.shape[1], columns)
    box = total[np.ix_(a1, b1)] - total[np.ix_(a0, b1)] - total[np.ix_(a1, b0)] + total[np.ix_(a0, b0)]
    return box / np.outer(a1 - a0, b1 - b0)


def _number(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits.ravel()).tobytes(), "big")


def thumbnail_hashes(thumb: np.ndarray) -> tuple[int, int]:
    """Average hash and difference hash, 64 bits each."""
    square, wide = np.rint(resize(thumb, 8, 8) * 256), np.rint(resize(thumb, 8, 9) * 256)
    return _number(square > square.mean()), _number(wide[:, 1:] > wide[:, :-1])


def payload_of(f: File, coefficients: np.ndarray) -> bytes:
    """The bytes that encode_payloads() stored."""
    n = next((c[len(PAYLOAD) :] for c in f.comments if c.startswith(PAYLOAD)), b"")
    if not n.isdigit() or int(n) > coefficients.size or len(f.components) != 1:
        raise JpegError("the file has no payload")
    n = int(n)
    return coefficients.astype(np.int8).tobytes()[:n]
