"""Baseline JPEG, both ways: entropy coding bit by bit, everything else over all blocks at once.

Sequential Huffman-coded files of 8 bits with one or three components, any sampling
factors, restart intervals and several scans are read; progressive, arithmetic, lossless and
four-component ones are refused with the reason. Chroma is repeated to the size of the image.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: The place of each coefficient of a block in the order in which they are stored.
ZIGZAG = np.array([v * 8 + u for u, v in sorted(((u, v) for v in range(8) for u in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 == 0 else p[1]))])
_K = np.arange(8)
#: Rows are the cosines of each frequency, so that ``COS.T @ block @ COS`` is the inverse transform.
COS = np.where(_K == 0, np.sqrt(1 / 8), 1 / 2)[:, None] * np.cos((2 * _K + 1) * _K[:, None] * np.pi / 16)
#: Markers.
SOI, EOI, SOS, DQT, DHT, DRI, ADOBE, BASELINE, EXTENDED, FRAMES = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xEE, 0xC0, 0xC1, {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    width: int = 0
    height: int = 0
    blocks: np.ndarray | None = None


class Bits:
    """The bits of one interval between markers."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def fill(self, wanted: int) -> None:
        while self.n < wanted:
            more = self.data[self.at : self.at + 8]
            if not more:
                raise ValueError("the JPEG data ends early")
            self.held, self.n, self.at = self.held << 8 * len(more) | int.from_bytes(more), self.n + 8 * len(more), self.at + len(more)

    def value(self, size: int) -> int:
        """A coefficient of ``size`` bits; those that begin with 0 are negative."""
        if not size:
            return 0
        self.fill(size)
        self.n -= size
        found, self.held = self.held >> self.n, self.held & (1 << self.n) - 1
        return found if found >> size - 1 else found - (1 << size) + 1

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            if not self.n:
                self.fill(1)
            self.n -= 1
            code, self.held = code << 1 | self.held >> self.n, self.held & (1 << self.n) - 1
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("a JPEG code that is in no table")


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """Symbols by (length, code): codes of a length count up, and double with the length."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[length, code] = symbol
            code += 1
        code, at = code << 1, at + n
    return out


def _segments(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(marker, its bytes, where it ends)."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no JPEG marker where one should be")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == EOI:
            return
        (size,) = struct.unpack(">H", data[at + 2 : at + 4])
        at = yield marker, data[at + 4 : at + 2 + size], at + 2 + size


def _scan(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The intervals of a scan between restart markers, and where the next marker is."""
    intervals = []
    for found in re.finditer(rb"\xff([^\x00\xff])", data[at:]):
        intervals.append(found.start())
        if not 0xD0 <= found[1][0] <= 0xD7:
            break
    else:
        intervals.append(len(data) - at)
    starts = [0, *(x + 2 for x in intervals[:-1])]
    return [data[at + a : at + b] for a, b in zip(starts, intervals, strict=True)], at + intervals[-1]


class Decoder:
    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.quantised, self.tables, self.parts, self.restart, self.adobe = {}, {}, [], 0, None
        walk, after = _segments(data), None
        try:
            while True:
                marker, body, end = walk.send(after) if after is not None else next(walk)
                after = end
                if marker == DQT:
                    self._quantisation(body)
                elif marker == DHT:
                    self._huffman(body)
                elif marker == DRI:
                    (self.restart,) = struct.unpack(">H", body[:2])
                elif marker == ADOBE and body[:5] == b"Adobe":
                    self.adobe = body[11]
                elif marker in FRAMES:
                    self._frame(marker, body)
                elif marker == SOS:
                    intervals, after = _scan(data, end)
                    self._entropy(body, intervals)
        except StopIteration:
            pass
        except (struct.error, IndexError, KeyError):
            raise ValueError("a JPEG header that can't be read") from None
        if not self.parts or any(p.blocks is None for p in self.parts):
            raise ValueError("a JPEG file without an image")

    def _quantisation(self, body: bytes) -> None:
        while body:
            wide, n = body[0] >> 4, 64 * (1 + (body[0] >> 4))
            self.quantised[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float64)
            body = body[1 + n :]

    def _huffman(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            self.tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def _frame(self, marker: int, body: bytes) -> None:
        depth, self.h, self.w, n = struct.unpack(">BHHB", body[:6])
        if marker not in (BASELINE, EXTENDED) or depth != 8 or n not in (1, 3) or not self.h or not self.w:
            raise ValueError("a JPEG of a kind that isn't read: progressive, arithmetic, or of other than 8 bits and 1 or 3 components")
        self.parts = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
        self.most_h, self.most_v = max(p.h for p in self.parts), max(p.v for p in self.parts)
        self.across, self.down = -(-self.w // (8 * self.most_h)), -(-self.h // (8 * self.most_v))
        for p in self.parts:
            p.width, p.height = -(-self.w * p.h // self.most_h), -(-self.h * p.v // self.most_v)

    def _entropy(self, body: bytes, intervals: list[bytes]) -> None:
        used = [(next(p for p in self.parts if p.ident == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
        alone = len(used) == 1
        for p, _ in used:
            p.blocks = np.zeros((self.down * p.v, self.across * p.h, 64), np.int32)
        if alone:
            p = used[0][0]
            cols, places = -(-p.width // 8), lambda unit: [(0, unit // cols, unit % cols)]
            units = cols * -(-p.height // 8)
        else:
            units = self.across * self.down
            cells = [(k, y, x) for k, (p, _) in enumerate(used) for y in range(p.v) for x in range(p.h)]
            places = lambda unit: [(k, unit // self.across * used[k][0].v + y, unit % self.across * used[k][0].h + x) for k, y, x in cells]
        each = self.restart or units
        if len(intervals) < -(-units // each):
            raise ValueError("the JPEG data ends early")
        tables = [(self.tables[t >> 4], self.tables[16 | t & 15]) for _, t in used]
        for number, interval in zip(range(0, units, each), intervals, strict=False):
            bits, before = Bits(interval), [0] * len(used)
            for unit in range(number, min(number + each, units)):
                for k, y, x in places(unit):
                    row = used[k][0].blocks[y, x]
                    dc, ac = tables[k]
                    before[k] += bits.value(bits.symbol(dc))
                    row[0] = before[k]
                    at = 1
                    while at < 64:
                        symbol = bits.symbol(ac)
                        if not symbol & 15 and symbol != 0xF0:
                            break
                        at += symbol >> 4
                        if at > 63:
                            raise ValueError("a JPEG block of more than 64 coefficients")
                        row[at] = bits.value(symbol & 15)
                        at += 1

    def plane(self, p: Component) -> np.ndarray:
        rows, cols, _ = p.blocks.shape
        placed = np.zeros((rows, cols, 64))
        placed[:, :, ZIGZAG] = p.blocks * self.quantised[p.table]
        values = COS.T @ placed.reshape(rows, cols, 8, 8) @ COS + 128
        plane = values.transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        y, x = np.arange(self.h) * p.v // self.most_v, np.arange(self.w) * p.h // self.most_h
        return plane[y[:, None], x]

    def image(self) -> np.ndarray:
        planes = [np.clip(np.round(self.plane(p)), 0, 255) for p in self.parts]
        if len(planes) == 3 and self.adobe != 0 and [p.ident for p in self.parts] != [*b"RGB"]:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
        return np.clip(np.round(np.stack(planes, axis=2)), 0, 255).astype(np.uint8)


def decode(data: bytes) -> dict:
    """A frame of 8-bit grey or RGB; ValueError has the reason if it can't be had."""
    image = Decoder(data).image()
    h, w, channels = image.shape
    return {"w": w, "h": h, "channels": channels, "dtype": "uint8", "is_mask": False, "samples": image.ravel().astype(np.float32)}


def _lengths(counts: Counter) -> tuple[bytes, bytes]:
    """(symbols of each length, symbols) of the shortest prefix code of at most 16 bits that leaves the code of all ones free."""
    heap = [(n, k, [k]) for k, n in counts.items()] + [(0, 256, [256])]
    depth = Counter()
    heapq.heapify(heap)
    while len(heap) > 1:
        (n, _, a), (m, k, b) = heapq.heappop(heap), heapq.heappop(heap)
        depth.update(a + b)
        heapq.heappush(heap, (n + m, k, a + b))
    sizes = Counter(depth.values())
    for length in range(max(sizes), 16, -1):
        while sizes[length]:
            shorter = max(k for k in range(1, length - 1) if sizes[k])
            sizes[length] -= 2
            sizes[length - 1] += 1
            sizes[shorter + 1] += 2
            sizes[shorter] -= 1
    longest = max(k for k in sizes if sizes[k])
    sizes[longest] -= 1
    order = sorted((k for k in depth if k != 256), key=lambda k: (depth[k], k))
    return bytes(sizes[k] for k in range(1, 17)), bytes(order)


def _symbols(blocks: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(0 or 1 for the table, symbol, value) of a component's blocks in their order."""
    before = 0
    for row in blocks.tolist():
        dc, before = row[0] - before, row[0]
        yield 0, abs(dc).bit_length(), dc
        run = 0
        last = max((k for k in range(1, 64) if row[k]), default=0)
        for value in row[1 : last + 1]:
            if value:
                while run > 15:
                    yield 1, 0xF0, 0
                    run -= 16
                yield 1, run << 4 | abs(value).bit_length(), value
                run = 0
            else:
                run += 1
        if last < 63:
            yield 1, 0, 0


def encode(image: np.ndarray, quality: int = 90, sampling: tuple[int, int] = (1, 1), restart: int = 0) -> bytes:
    """A baseline file of (rows, columns) or (rows, columns, 1 or 3) 8-bit samples; ``sampling`` is how luma exceeds chroma across and down."""
    image = image[:, :, None] if image.ndim == 2 else image
    h, w, n = image.shape
    planes = [image[:, :, c].astype(np.float64) for c in range(n)]
    if n == 3:
        r, g, b = planes
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    (sx, sy) = sampling if n == 3 else (1, 1)
    across, down = -(-w // (8 * sx)), -(-h // (8 * sy))
    steps = np.clip(np.round((8 + 2.5 * np.add.outer(_K, _K)) * (100 - quality) / 50), 1, 255).ravel()[ZIGZAG]
    units = []
    for c, plane in enumerate(planes):
        plane = np.pad(plane, ((0, down * 8 * sy - h), (0, across * 8 * sx - w)), mode="edge")
        px, py = (sx, sy) if c == 0 else (1, 1)
        if c and (sx, sy) != (1, 1):
            plane = plane.reshape(down * 8, sy, across * 8, sx).mean((1, 3))
        cells = plane.reshape(down, py, 8, across, px, 8).transpose(0, 3, 1, 4, 2, 5).reshape(-1, 8, 8) - 128
        stored = np.round((COS @ cells @ COS.T).reshape(-1, 64)[:, ZIGZAG] / steps).astype(int)
        units.append(stored.reshape(down * across, px * py, 64))
    each = restart or down * across
    intervals = [[list(_symbols(u[k : k + each].reshape(-1, 64))) for u in units] for k in range(0, down * across, each)]
    counts = [Counter(s for part in intervals for c in part for t, s, _ in c if t == k) for k in (0, 1)]
    tables = [_lengths(x) for x in counts]
    codes = [{s: format(code, f"0{length}b") for (length, code), s in _codes(*t).items()} for t in tables]
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    out = b"\xff\xd8" + segment(DQT, b"\0" + bytes(steps.astype(np.uint8)))
    out += segment(BASELINE, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, sx << 4 | sy if c == 0 else 0x11, 0]) for c in range(n)))
    out += segment(DHT, b"".join(bytes([k << 4]) + b"".join(t) for k, t in enumerate(tables))) + (segment(DRI, struct.pack(">H", restart)) if restart else b"")
    out += segment(SOS, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + b"\0\x3f\0")
    for k, part in enumerate(intervals):
        written = []
        streams = [_blocks(c) for c in part]
        for _ in range(min(each, down * across - k * each)):
            for c, stream in enumerate(streams):
                for _ in range(units[c].shape[1]):
                    written += [codes[t][s] + _bits(v) for t, s, v in next(stream)]
        text = "".join(written)
        text += "1" * (-len(text) % 8)
        out += int(text or "0", 2).to_bytes(len(text) // 8).replace(b"\xff", b"\xff\x00")
        out += bytes([0xFF, 0xD0 + k % 8]) if k < len(intervals) - 1 else b""
    return out + b"\xff\xd9"


def _bits(value: int) -> str:
    size = abs(value).bit_length()
    return format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def _blocks(symbols: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A component's symbols block by block."""
    starts = [k for k, s in enumerate(symbols) if s[0] == 0]
    for a, b in zip(starts, [*starts[1:], len(symbols)], strict=True):
        yield symbols[a:b]
