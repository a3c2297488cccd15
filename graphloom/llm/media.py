"""AVI motion-JPEG columns: RIFF chunks and index, baseline intra frames, shots by adaptive histogram differences.

Frames of all rows of a batch are coded and decoded side by side: each restart interval is a stream of its own, and
one numpy step handles the next symbol of every stream.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, pieces, scratch, table

FPS, ACROSS, GROUP = 25, 64, 1 << 16
#: Order in which a block's coefficients are stored: along the diagonals, in turn up and down.
ZIGZAG = np.asarray([8 * y + x for s in range(15) for y, x in (sorted(((y, s - y) for y in range(8) if 0 <= s - y < 8), reverse=s % 2 == 0))])
#: Our frames' Huffman tables, as (codes of each length from 1 to 16, symbols): difference sizes 0 to 8, end of block.
DC_TABLE = ([0, 1, 5, 1, 1, 1] + [0] * 10, [4, 0, 1, 2, 3, 7, 6, 8, 5])
AC_TABLE = ([1] + [0] * 15, [0])


def _with_rest(symbols: str) -> list[int]:
    """The symbols given in hexadecimal, then all other AC symbols in ascending order."""
    first = list(bytes.fromhex(symbols))
    return first + sorted({0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))} - set(first))


#: The typical Huffman tables of the JPEG standard (annex K.3), which motion-JPEG frames without tables use.
TYPICAL_DC = {
    0: ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))),
    1: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12))),
}
TYPICAL_AC = {
    0: ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], _with_rest("01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82")),
    1: ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], _with_rest("00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1")),
}
_UNREADABLE = (ValueError, KeyError, IndexError, ZeroDivisionError, RecursionError, struct.error)


def huffman(counts, symbols) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol -> (code, length)."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts, symbols) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window: the symbol that it starts with (-1: none) and its length."""
    symbol, size = np.full(1 << 16, -1, np.int32), np.ones(1 << 16, np.int32)
    for s, (code, length) in huffman(counts, symbols).items():
        a = code << (16 - length)
        symbol[a : a + (1 << (16 - length))], size[a : a + (1 << (16 - length))] = s, length
    return symbol, size


def extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value that ``size`` bits stand for."""
    return np.where((bits >> np.maximum(size - 1, 0)) & 1, bits, bits - (1 << size) + 1) * (size > 0)


class Tables:
    """Look-up tables of one pair of Huffman tables. ``fused``: where a window holds a whole block of a DC difference
    and an end of block, the difference and all bits of it (0 bits: no such block)."""

    def __init__(self, dc, ac):
        self.dc, self.ac = lookup(*dc), lookup(*ac)
        window = np.arange(1 << 16)
        size, length = np.maximum(self.dc[0], 0), self.dc[1]
        bits = (window >> np.maximum(16 - length - size, 0)) & ((1 << size) - 1)
        self.fused = extend(bits, size).astype(np.int32)
        rest = (window << (length + size)) & 0xFFFF
        total = length + size + self.ac[1][rest]
        self.bits = np.where((self.dc[0] >= 0) & (self.ac[0][rest] == 0) & (total <= 16), total, 0).astype(np.int32)


_TABLES: dict = {}


def tables_of(dc, ac) -> Tables:
    key = (tuple(dc[0]), tuple(dc[1]), tuple(ac[0]), tuple(ac[1]))
    if key not in _TABLES:
        if len(_TABLES) > 8:
            _TABLES.clear()
        _TABLES[key] = Tables(dc, ac)
    return _TABLES[key]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_header(rows: int) -> bytes:
    """A grey frame of rows * ACROSS blocks: DC in steps of one sample level, a restart after each row of blocks."""
    table_bytes = lambda kind, t: bytes([kind, *t[0], *t[1]])
    return b"\xff\xd8" + _segment(0xDB, bytes([0, 8] + [1] * 63)) + _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * ACROSS, 1) + bytes([1, 0x11, 0])) + _segment(0xC4, table_bytes(0, DC_TABLE)) + _segment(0xC4, table_bytes(0x10, AC_TABLE)) + _segment(0xDD, struct.pack(">H", ACROSS)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _code_rows(levels: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of each row of ACROSS block levels, stuffed, without markers."""
    codes = huffman(*DC_TABLE)
    value, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        value[d + 255] = ((code << size) | ((d if d > 0 else d + (1 << size) - 1) if size else 0)) << 1  # and end of block, a 0
        length[d + 255] = n + size + 1
    out: list[bytes] = []
    for at in range(0, len(levels), GROUP):
        v = levels[at : at + GROUP].astype(np.int16)
        d = np.diff(v, axis=1, prepend=np.int16(128)) + 255
        n, c = length[d], value[d]
        ends = np.cumsum(n, axis=1)
        bits, width = ends[:, -1], int(ends[:, -1].max() + 7) // 8 + 3
        raw = np.zeros((len(v), width), np.uint8)
        flat, base = raw.reshape(-1), np.arange(len(v)) * width
        for j in range(ACROSS):
            start = ends[:, j] - n[:, j]
            word = c[:, j] << (24 - n[:, j] - (start & 7))
            i = base + (start >> 3)
            flat[i] |= (word >> 16).astype(np.uint8)
            flat[i + 1] |= (word >> 8).astype(np.uint8)
            flat[i + 2] |= word.astype(np.uint8)
        size = (bits + 7) >> 3
        fill = (-bits) & 7
        flat[base + size - 1] |= ((1 << fill) - 1).astype(np.uint8)
        keep = flat[(np.arange(width) < size[:, None]).reshape(-1)]
        stops = np.cumsum(size)
        ff = np.flatnonzero(keep == 255)
        data = np.insert(keep, ff + 1, 0).tobytes()
        stops = stops + np.searchsorted(ff, stops, "left")
        starts = np.concatenate([[0], stops[:-1]])
        out += [data[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def encode(payloads: list[bytes], lengths: list[int]) -> list[bytes]:
    """AVI files that hold each payload (of a positive multiple of ACROSS bytes) without loss: a byte is the level of
    one 8 x 8 block, which a baseline DC coefficient stores exactly. A ``plen`` chunk keeps the payload's and the
    text's length, as the last frame can be longer than what is left."""
    shapes, levels = [], []
    for p in payloads:
        units = len(p) // ACROSS
        frames = -(-units // ACROSS)
        rows = -(-units // frames)
        shapes.append((frames, rows))
        levels.append(np.frombuffer(p + bytes(frames * rows * ACROSS - len(p)), np.uint8).reshape(-1, ACROSS))
    coded, at, out = _code_rows(np.concatenate(levels)) if levels else [], 0, []
    for p, (frames, rows), n in zip(payloads, shapes, lengths):
        movi, index, header, position = [], [], _frame_header(rows), 4
        for _ in range(frames):
            body = [header]
            for r in range(rows):
                body += [coded[at + r], bytes([0xFF, 0xD0 + r % 8]) if r < rows - 1 else b"\xff\xd9"]
            at += rows
            jpeg = b"".join(body)
            movi.append(_chunk(b"00dc", jpeg))
            index.append(struct.pack("<4sIII", b"00dc", 0x10, position, len(jpeg)))
            position += len(movi[-1])
        w, h = 8 * ACROSS, 8 * rows
        avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, 0, w, h, 0, 0, 0, 0)
        strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, 0, 0xFFFFFFFF, 0, 0, 0, w, min(h, 32767))
        strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 8, b"MJPG", w * h, 0, 0, 0, 0)
        head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
        body = b"AVI " + head + _chunk(b"plen", struct.pack("<QQ", len(p), n)) + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
        out.append(_chunk(b"RIFF", body))
    return out


def parse(media: bytes) -> dict:
    """What an AVI file holds: frame bytes in order (by idx1, else by walking movi; those of further RIFF segments, which
    idx1 does not list, by walking them), seconds a frame, own chunks. A frame dropped in recording has no bytes."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    found: dict = {"spf": 1 / FPS, "frames": [], "chunks": {}}
    movi, index, walk, later = None, None, [], []

    def read(a: int, b: int, frames: list) -> None:
        nonlocal movi, index
        while a + 8 <= b:
            name, size = media[a : a + 4], struct.unpack_from("<I", media, a + 4)[0]
            body, end = a + 8, min(a + 8 + size, b)
            if name == b"LIST":
                if media[body : body + 4] == b"movi" and movi is None:
                    movi = body
                read(body + 4, end, frames)
            elif name == b"RIFF" and media[body : body + 4] == b"AVIX":
                read(body + 4, end, later)
            elif name == b"avih" and size >= 4:
                found["spf"] = struct.unpack_from("<I", media, body)[0] / 1e6
            elif name == b"idx1":
                index = (body, end)
            elif name[2:] in (b"dc", b"db"):
                frames.append((body, end))
            else:
                found["chunks"][name] = media[body:end]
            a = body + size + (size & 1)

    read(12, len(media), walk)
    if index and movi is not None:
        entries = [e for e in struct.iter_unpack("<4sIII", media[index[0] : index[1] - (index[1] - index[0]) % 16]) if e[0][2:] in (b"dc", b"db")]
        base = movi if entries and media[movi + entries[0][2] : movi + entries[0][2] + 4] == entries[0][0] else 0  # offsets count from movi, or from the file
        found["frames"] = [media[base + at + 8 : base + at + 8 + size] for _, _, at, size in entries]
    else:
        found["frames"] = [media[a:b] for a, b in walk]
    found["frames"] += [media[a:b] for a, b in later]
    return found


def parse_frame(jpeg: bytes) -> dict:
    """A baseline frame's size, tables, components and streams (one for each restart interval, unstuffed)."""
    out: dict = {"quant": {}, "dc": dict(TYPICAL_DC), "ac": dict(TYPICAL_AC), "restart": 0}
    at = 2
    while at + 4 <= len(jpeg):
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker in (0xC0, 0xC1):
            out["bits"], out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only baseline frames are read")
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                out["ac" if body[0] >> 4 else "dc"][body[0] & 15] = (counts, list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            out["scan"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            raw = np.frombuffer(jpeg, np.uint8, offset=at)
            ff = np.flatnonzero(raw[:-1] == 255)
            after = raw[ff + 1]
            stop = ff[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))]
            end = int(stop[0]) if len(stop) else len(raw)
            cuts = ff[(after >= 0xD0) & (after <= 0xD7) & (ff < end)].tolist()
            data = raw[:end].tobytes()
            out["streams"] = [data[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip([0, *[c + 2 for c in cuts]], [*cuts, end])]
            return out
    raise ValueError("a frame without a scan")


def _decode_streams(streams: list[bytes], blocks: np.ndarray, pattern: list[int], tables: list[Tables]):
    """DC values (streams x blocks) and the AC coefficients that are not 0, as (stream, block, zigzag index, value).

    ``pattern`` is the component of each block of a unit, ``tables`` is by component; each stream has blocks[i] blocks.
    """
    n, most = len(streams), int(blocks.max(initial=0))
    sizes = np.fromiter(map(len, streams), np.int64, n)
    base = np.concatenate([[0], np.cumsum(sizes + 4)])[:-1]
    raw = np.frombuffer(b"".join(s + b"\xff\xff\xff\xff" for s in streams), np.uint8).astype(np.int64) if n else np.zeros(0, np.int64)
    limit = 8 * (base + sizes)
    position, done, k = 8 * base, np.zeros(n, np.int64), np.zeros(n, np.int64)
    predicted = np.zeros((n, max(pattern) + 1), np.int64)
    dc, ac = np.zeros((n, most), np.int16), []
    which = np.asarray(pattern)
    live = np.flatnonzero(blocks > 0)

    def window(p, wide: int = 16):
        i = p >> 3
        word = raw[i] << 24 | raw[i + 1] << 16 | raw[i + 2] << 8 | raw[i + 3]
        return (word >> (32 - wide - (p & 7))) & ((1 << wide) - 1)

    single = len(set(pattern)) == 1
    while len(live):
        p = position[live]
        if (p > limit[live]).any():
            raise ValueError("a stream ends early")
        w = window(p)
        component = which[done[live] % len(which)]
        if single:
            bits, difference = tables[0].bits[w], tables[0].fused[w]
        else:
            bits, difference = np.choose(component, [t.bits[w] for t in tables]), np.choose(component, [t.fused[w] for t in tables])
        whole = (bits > 0) & (k[live] == 0)
        rows = live[whole] if not whole.all() else live
        c = component[whole] if len(rows) < len(live) else component
        if len(rows):
            value = predicted[rows, c] + (difference[whole] if len(rows) < len(live) else difference)
            predicted[rows, c] = value
            dc[rows, done[rows]] = value
            position[rows] += bits[whole] if len(rows) < len(live) else bits
            done[rows] += 1
        if len(rows) < len(live):  # one symbol of each of the others
            rows, w, c = live[~whole], w[~whole], component[~whole]
            first = k[rows] == 0
            symbol, length = np.choose(c, [np.where(first, t.dc[0][w], t.ac[0][w]) for t in tables]), np.choose(c, [np.where(first, t.dc[1][w], t.ac[1][w]) for t in tables])
            if (symbol < 0).any():
                raise ValueError("a code that no table has")
            position[rows] += length
            size = np.where(first, symbol, symbol & 15)
            value = extend(window(position[rows]) >> (16 - size), size)
            position[rows] += size
            a = rows[first]
            predicted[a, c[first]] += value[first]
            dc[a, done[a]] = predicted[a, c[first]]
            at = k[rows] + np.where(first, 0, symbol >> 4)
            put = ~first & (size > 0)
            if (at[put] > 63).any():
                raise ValueError("too many coefficients")
            if put.any():
                ac.append((rows[put], done[rows[put]], at[put], value[put]))
            k[rows] = np.where(first, 1, np.where(symbol == 0, 64, at + 1))
            ended = rows[k[rows] > 63]
            done[ended] += 1
            k[ended] = 0
        live = live[done[live] < blocks[live]]
    return dc, [np.concatenate(x) for x in zip(*ac)] if ac else None


def _units(f: dict) -> tuple[int, int, list[int]]:
    """Units across and down, and the component of each block of a unit."""
    wide, high = max(p[1] for p in f["parts"]), max(p[2] for p in f["parts"])
    if len(f["parts"]) == 1:
        wide = high = 1
        return -(-f["width"] // 8), -(-f["height"] // 8), [0]
    return -(-f["width"] // (8 * wide)), -(-f["height"] // (8 * high)), [i for i, p in enumerate(f["parts"]) for _ in range(p[1] * p[2])]


def decode_levels(jpegs: list[bytes], frames: list[dict] | None = None) -> list[np.ndarray]:
    """Each frame's first component at one eighth of its size: every block's mean level, 0 to 255. Frames with the same
    tables and components are decoded together."""
    frames = frames or [parse_frame(j) for j in jpegs]
    alike: dict = {}
    for i, f in enumerate(frames):
        tables = [tables_of(f["dc"][f["scan"][p[0]][0]], f["ac"][f["scan"][p[0]][1]]) for p in f["parts"]]
        across, down, pattern = _units(f)
        f["units"] = (across, down, pattern)
        alike.setdefault((tuple(map(id, tables)), tuple(pattern)), (tables, pattern, []))[2].append(i)
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(frames)
    for tables, pattern, members in alike.values():
        streams, blocks = [], []
        for i in members:
            across, down, _ = frames[i]["units"]
            units = across * down
            step = frames[i]["restart"] or units
            own = [min(step, units - a) * len(pattern) for a in range(0, units, step)]
            if len(own) > len(frames[i]["streams"]):
                raise ValueError("a frame lacks streams")
            streams += frames[i]["streams"][: len(own)]
            blocks += own
        dc, ac = _decode_streams(streams, np.asarray(blocks, np.int64), pattern, tables)
        at = 0
        for i in members:
            f = frames[i]
            across, down, _ = f["units"]
            n = len(range(0, across * down, f["restart"] or across * down))
            own = np.concatenate([dc[at + j, : blocks[at + j]] for j in range(n)]) if n > 1 and len(set(blocks[at : at + n])) > 1 else dc[at : at + n, : blocks[at]].reshape(-1)
            f["dc_values"], f["ac_values"] = own, None
            if ac is not None:
                mine = (ac[0] >= at) & (ac[0] < at + n)
                starts = np.concatenate([[0], np.cumsum(blocks[at : at + n])])
                f["ac_values"] = (starts[ac[0][mine] - at] + ac[1][mine], ac[2][mine], ac[3][mine])
            at += n
            part = f["parts"][0]
            first = own.reshape(-1, len(pattern))[:, : part[1] * part[2] if len(pattern) > 1 else 1].astype(np.int64)
            level = np.clip(np.rint(first * int(f["quant"][part[3]][0]) / 8) + 128, 0, 255).astype(np.uint8)
            if len(pattern) > 1:
                level = level.reshape(down, across, part[2], part[1]).transpose(0, 2, 1, 3).reshape(down * part[2], across * part[1])
                level = level[: -(-f["height"] // 8), : -(-f["width"] // 8)]
            out[i] = level.reshape(-(-f["height"] // 8), -(-f["width"] // 8))
    return out


def decode_pixels(jpegs: list[bytes]) -> list[np.ndarray]:
    """Each frame's first component (grey, or luminance) in full size, by the inverse cosine transform."""
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)
    frames = [parse_frame(j) for j in jpegs]
    decode_levels([], frames) if frames else None
    out = []
    for f in frames:
        across, down, pattern = f["units"]
        coefficients = np.zeros((len(f["dc_values"]), 64))
        coefficients[:, 0] = f["dc_values"]
        if f["ac_values"]:
            coefficients[f["ac_values"][0], f["ac_values"][1]] = f["ac_values"][2]
        part = f["parts"][0]
        each = part[1] * part[2] if len(pattern) > 1 else 1
        own = coefficients.reshape(-1, len(pattern), 64)[:, :each].reshape(-1, 64) * f["quant"][part[3]]
        natural = np.zeros_like(own)
        natural[:, ZIGZAG] = own
        pixels = np.clip(np.rint(basis @ natural.reshape(-1, 8, 8) @ basis.T) + 128, 0, 255).astype(np.uint8)
        v, h = (part[2], part[1]) if len(pattern) > 1 else (1, 1)
        grid = pixels.reshape(down, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)
        out.append(grid[: f["height"], : f["width"]])
    return out


def shots(levels: list[np.ndarray], bins: int = 32, around: int = 6, floor: float = 0.08, factor: float = 3.0) -> list[tuple[int, int]]:
    """[first, last) frames of each shot. A cut is where the histogram difference of two frames is above ``floor`` and
    above the mean plus ``factor`` deviations of the differences around it."""
    if not levels:
        return []
    h = np.stack([np.bincount(x.reshape(-1) * bins >> 8 if x.dtype != np.uint8 else (x.reshape(-1).astype(np.int64) * bins) >> 8, minlength=bins) / max(1, x.size) for x in levels])
    d = np.abs(np.diff(h, axis=0)).sum(1) / 2
    cuts = [0]
    for i in range(len(d)):
        near = np.concatenate([d[max(0, i - around) : i], d[i + 1 : i + 1 + around]])
        if d[i] > floor + (near.mean() + factor * near.std() if len(near) else 0):
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], len(levels)]))


def levels_of(frames: list[bytes]) -> tuple[list[np.ndarray], list[bool]]:
    """Each frame's levels, and whether it is damaged. Empty frames, which are dropped ones, and damaged ones repeat the
    frame before them; at the start, the first that can be read. ValueError if there is none."""

    def alone(jpeg: bytes) -> np.ndarray | None:
        try:
            return decode_levels([jpeg])[0]
        except _UNREADABLE:
            return None

    some = [j for j in frames if j]
    try:
        read = decode_levels(some)
    except _UNREADABLE:
        read = [alone(j) for j in some]
    last = next((x for x in read if x is not None), None)
    if last is None:
        raise ValueError("no frame that can be read")
    each, out, damaged = iter(read), [], []
    for j in frames:
        own = next(each) if j else None
        last = last if own is None else own
        out.append(last)
        damaged.append(bool(j) and own is None)
    return out, damaged


_CLIP = {"clip": pa.int32(), "first_frame": pa.int32(), "last_frame": pa.int32(), "start_s": pa.float64(), "end_s": pa.float64(), "level": pa.float64(), "damaged": pa.int32(), "error": pa.string()}
_CLIPS = "clips array<struct<clip:int,first_frame:int,last_frame:int,start_s:double,end_s:double,level:double,damaged:int,error:string>>"


def _clip_rows(media: bytes) -> list[dict]:
    try:
        file = parse(media)
        levels, damaged = levels_of(file["frames"])
    except _UNREADABLE as e:
        return [{"error": f"{type(e).__name__}: {e}"}]
    spf = file["spf"]
    return [{"clip": i, "first_frame": a, "last_frame": b, "start_s": a * spf, "end_s": b * spf, "level": float(np.mean([x.mean() for x in levels[a:b]])), "damaged": sum(damaged[a:b])} for i, (a, b) in enumerate(shots(levels))]


def clips(media: DataFrame, column: str = "media", errors: bool = False) -> DataFrame:
    """``media`` without ``column``, one row for each shot of each AVI value: clip number, frames [first, last), times,
    mean level, and how many of its frames are damaged (``levels_of``). Null media give no row. What is not a readable
    motion-JPEG AVI gives no row either, or with ``errors`` one with the reason in the column error and a null clip.
    Frames are decoded whole; columns of ``media`` that are named like one of these are replaced."""
    names = [n for n in _CLIP if errors or n != "error"]
    rest = [c for c in media.columns if c != column and c.lower() not in names]

    def read(batches):
        for batch in batches:
            found = [None if v is None else _clip_rows(v) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.struct(list(_CLIP.items()))))], ["rest", "clips"])

    packed = media.select(F.col(f"`{column}`").alias("media"), F.struct(F.lit(0).alias("of"), *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    shape = StructType([packed.schema["rest"], *StructType.fromDDL(_CLIPS)])
    shown = packed.mapInArrow(lean(read), shape).select("rest", F.explode("clips").alias("clip"))
    shown = shown if errors else shown.filter("clip.error IS NULL")
    return shown.select(*[F.col("rest")[c].alias(c) for c in rest], *[F.col("clip")[n].alias(n) for n in names])


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media: each whole text (null: empty) as UTF-8, filled with bytes 0 up to a positive multiple of 64,
    as a motion-JPEG AVI. Repeated rows stay; an empty table gives an empty one; other columns are ignored."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1).cast(pa.binary())]
                filled = [t + bytes(-len(t) % ACROSS if t else ACROSS) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encode(filled, [len(t) for t in texts]), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id bigint, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """Payload digests and features of what ``store`` made, all from the decoded frames."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "media"):
                files = [parse(m) for m in part.column(1).to_pylist()]
                levels = decode_levels([f for file in files for f in file["frames"]])
                at, rows = 0, []
                for doc, m, file in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), files):
                    own = levels[at : at + len(file["frames"])]
                    at += len(own)
                    size, n = struct.unpack("<QQ", file["chunks"][b"plen"])
                    payload = b"".join(x.tobytes() for x in own)[:size]
                    found = shots(own)
                    feature = f"frames={len(own)};rows={own[0].shape[0]};clips=" + ",".join(f"{round(1000 * a * file['spf'])}-{round(1000 * b * file['spf'])}ms@{np.mean([x.mean() for x in own[a:b]]):.3f}" for a, b in found)
                    rows.append((doc, n, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    shape = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.mapInArrow(lean(run), shape)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a written table of motion-JPEG AVI files and back."""
    media, path = store(table(spark, sf_dir, "documents")), scratch(spark, "media")
    media.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(path)
    return read_back(spark.read.schema(media.schema).parquet(path))
