"""TIFF pages as frames: a Python data source.

``spark.read.format("tiff_frames").load(glob)`` plans one partition per file and
page range: from two headers and a binary search where a file's pages stand a constant
stride apart (``sources.pages``), else from all its headers. Tasks read only their own
strips or tiles, those end to end with one read, and check that each page stands where
the plan puts it. Of many files the small ones are planned by the tasks that read them, many
a task (``store.divided``). Strips and tiles may be plain, PackBits, LZW or Deflate, differenced,
and of one channel each. With ``option("headers", "true")`` none is read. A
``frame_idx = n`` filter is pushed into the page range. A file or page that can't be
read is a row with the reason. Paths are those of any store that Arrow reads.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from rasterlake.sources import codecs, pages, store

FRAME_FIELDS = "media_id string, frame_idx int, w int, h int, channels int, dtype string, is_mask boolean, samples array<float>"
HEADER_FIELDS = "media_id string, frame_idx int, off long, next_off long, w int, h int, bits int, spp int, compression int, photometric int, sample_format int, planar int, predictor int, tiled boolean, strip_offsets array<long>, strip_counts array<long>"
PAGES_PER_PARTITION = 64
#: Files whose headers are read at a time when partitions are planned.
PLANNERS = 8

#: TIFF tags that are read.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SPP, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = (
    256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339,
)
TAGS = {WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SPP, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT}
#: Bytes of the field types SHORT, LONG and LONG8, and of BYTE.
FIELD = {1: "B", 3: "H", 4: "I", 16: "Q"}
#: A directory of more entries is no directory.
MOST_ENTRIES = 4096
#: Sample types by bits and sample format.
TYPES = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (16, 3): "f2", (32, 3): "f4", (64, 3): "f8"}


@dataclass(frozen=True)
class Header:
    """One page: where it stands, what it holds, where its strips are."""

    off: int
    next_off: int
    tags: dict[int, tuple[int, ...]]

    def one(self, tag: int, default: int = 0) -> int:
        return self.tags[tag][0] if self.tags.get(tag) else default

    @property
    def shape(self) -> tuple:
        return tuple((k, v) for k, v in sorted(self.tags.items()) if k not in (STRIP_OFFSETS, TILE_OFFSETS))

    @property
    def places(self) -> tuple[int, ...]:
        """Where the strips or tiles stand."""
        return self.tags.get(TILE_OFFSETS) or self.tags.get(STRIP_OFFSETS, ())


class Tiff:
    """Headers and pages of an open classic or Big TIFF."""

    def __init__(self, read):
        """``read(offset, n)`` returns n bytes, fewer at the end."""
        self.read = read
        head = read(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack(f"{self.order}H", head[2:4])[0] if self.order and len(head) >= 8 else 0
        if kind not in (42, 43):
            raise ValueError("no TIFF signature")
        self.big = kind == 43
        if self.big and struct.unpack(f"{self.order}HH", head[4:8]) != (8, 0):
            raise ValueError("BigTIFF offsets of an unknown size")
        self.first = struct.unpack(f"{self.order}{'Q' if self.big else 'I'}", head[8:16] if self.big else head[4:8])[0]

    def header(self, off: int) -> Header | None:
        count_size, entry_size, inline = (8, 20, 8) if self.big else (2, 12, 4)
        pointer = "Q" if self.big else "I"
        raw = self.read(off, count_size)
        if len(raw) < count_size:
            return None
        (n,) = struct.unpack(f"{self.order}{'Q' if self.big else 'H'}", raw)
        if n > MOST_ENTRIES:
            return None
        body = self.read(off + count_size, n * entry_size + inline)
        if len(body) < n * entry_size + inline:
            return None
        tags = {}
        for k in range(n):
            entry = body[k * entry_size : (k + 1) * entry_size]
            tag, kind = struct.unpack(f"{self.order}HH", entry[:4])
            (count,) = struct.unpack(f"{self.order}{pointer}", entry[4 : 4 + inline])
            if kind in FIELD and tag in TAGS:
                size = count * struct.calcsize(FIELD[kind])
                at = entry[4 + inline :][:size] if size <= inline else self.read(struct.unpack(f"{self.order}{pointer}", entry[4 + inline :])[0], size)
                if len(at) == size:
                    tags[tag] = struct.unpack(f"{self.order}{count}{FIELD[kind]}", at)
        return Header(off, struct.unpack(f"{self.order}{pointer}", body[n * entry_size :])[0], tags)

    def headers(self) -> Iterator[Header]:
        """Every page by its pointer; a chain that breaks off or runs in a circle is an error, after the pages before it."""
        off, seen = self.first, set()
        while off:
            page = None if off in seen else self.header(off)
            if page is None:
                raise ValueError(f"the chain of pages ends wrongly after {len(seen)}")
            seen.add(off)
            yield page
            off = page.next_off

    def decode(self, page: Header) -> dict:
        """The frame of a page; raises ValueError with the reason if it can't be had."""
        bits, spp, kind = page.one(BITS, 1), page.one(SPP, 1), page.one(SAMPLE_FORMAT, 1)
        w, h, mask = page.one(WIDTH), page.one(HEIGHT), page.one(BITS, 1) == 1 and page.one(SPP, 1) == 1
        if not mask and (bits, kind) not in TYPES:
            raise ValueError("unsupported sample format")
        if page.one(COMPRESSION, 1) not in codecs.DECODERS:
            raise ValueError(f"no decoder for compression {page.one(COMPRESSION)}")
        if page.one(PLANAR, 1) == 1 and page.one(COMPRESSION, 1) == codecs.NONE and page.one(PREDICTOR, 1) == 1 and not page.one(TILE_WIDTH):
            values = self._plain(page, w, h, spp, None if mask else np.dtype(TYPES[bits, kind]))
        else:
            values = self._segments(page, w, h, spp, None if mask else np.dtype(TYPES[bits, kind]))
        if mask:
            values = values ^ (page.one(PHOTOMETRIC) == 0)
        dtype = "uint8" if mask else {"u1": "uint8", "u2": "uint16"}.get(TYPES[bits, kind], "float32")
        return {"w": w, "h": h, "channels": spp, "dtype": dtype, "is_mask": mask, "samples": values.ravel().astype(np.float32)}

    def _pieces(self, offsets: tuple[int, ...], counts: tuple[int, ...]) -> Iterator[bytes]:
        """Each strip's or tile's bytes; those that lie end to end come with one read."""
        start = 0
        while start < len(offsets):
            stop = start + 1
            while stop < len(offsets) and offsets[stop] == offsets[stop - 1] + counts[stop - 1]:
                stop += 1
            data = self.read(offsets[start], sum(counts[start:stop]))
            for at, n in zip(offsets[start:stop], counts[start:stop], strict=True):
                yield data[at - offsets[start] : at - offsets[start] + n]
            start = stop

    def _plain(self, page: Header, w: int, h: int, spp: int, kind: np.dtype | None) -> np.ndarray:
        """Strips that hold the samples as they are, one after another."""
        data = b"".join(self.read(at, size) for at, size in merged(page.places, page.tags.get(STRIP_COUNTS, ())))
        row = -(-w // 8) if kind is None else w * spp * kind.itemsize
        if len(data) < row * h:
            raise ValueError("page data is short")
        if kind is None:
            return np.unpackbits(np.frombuffer(data, np.uint8, row * h).reshape(h, row), axis=1)[:, :w]
        return np.frombuffer(data, kind.newbyteorder(self.order), w * h * spp)

    def _segments(self, page: Header, w: int, h: int, spp: int, kind: np.dtype | None) -> np.ndarray:
        """Strips or tiles that are compressed, differenced, or of one channel each, put where they belong."""
        tiled, planes = bool(page.one(TILE_WIDTH)), spp if page.one(PLANAR, 1) == 2 else 1
        cols = page.one(TILE_WIDTH) if tiled else w
        rows = page.one(TILE_HEIGHT) if tiled else min(page.one(ROWS_PER_STRIP, h) or h, h)
        counts = page.tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, ())
        if not (cols and rows and w and h):
            raise ValueError("a page without extent")
        across, down, channels = -(-w // cols), -(-h // rows), spp // planes
        if min(len(page.places), len(counts)) < planes * across * down:
            raise ValueError("fewer strips or tiles than the page has")
        out = np.zeros((h, w, spp), np.uint8 if kind is None else kind)
        unpack, predictor = codecs.DECODERS[page.one(COMPRESSION, 1)], page.one(PREDICTOR, 1)
        for k, data in enumerate(self._pieces(page.places[: planes * across * down], counts[: planes * across * down])):
            plane, y, x = k // (across * down), k // across % down * rows, k % across * cols
            n = rows if tiled else min(rows, h - y)
            row = -(-cols // 8) if kind is None else cols * channels * kind.itemsize
            raw = unpack(data, n * row)
            if len(raw) < n * row:
                raise ValueError(f"strip or tile {k} is short")
            stored = np.frombuffer(raw, np.uint8, n * row).reshape(n, row)
            if kind is None:
                values = np.unpackbits(stored, axis=1)[:, :cols, None]
            else:
                values = codecs.unpredicted(stored.reshape(n, cols, channels, kind.itemsize), predictor, kind, self.order)
            out[y : y + n, x : x + cols, plane * channels : (plane + 1) * channels] = values[: h - y, : w - x]
        return out


def merged(offsets, counts) -> list[tuple[int, int]]:
    """Contiguous strips as single reads."""
    runs: list[tuple[int, int]] = []
    for at, size in zip(offsets, counts, strict=True):
        if runs and sum(runs[-1]) == at:
            runs[-1] = (runs[-1][0], runs[-1][1] + size)
        else:
            runs.append((at, size))
    return runs


@dataclass
class Pages(InputPartition):
    """Pages of a file: by their offsets, or by the first one's and the stride; or why there are none."""

    path: str
    first: int = 0
    count: int = 0
    offsets: tuple[int, ...] = ()
    stride: int = 0
    last: int = -1
    error: str | None = None

    def offset(self, k: int) -> int:
        return self.offsets[k] if len(self.offsets) > 1 or not self.stride else self.offsets[0] + k * self.stride


class TiffFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff_frames"

    def schema(self) -> str:
        return f"{HEADER_FIELDS if self._headers() else FRAME_FIELDS}, error string"

    def _headers(self) -> bool:
        return str(self.options.get("headers", "false")).lower() == "true"

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options["path"], self._headers(), self.options.get("index", "stride") == "stride")


class TiffReader(DataSourceReader):
    """Plans files at once, ``PLANNERS`` at a time; a file whose headers can't be read is a row with the reason."""

    def __init__(self, path: str, headers: bool, by_stride: bool = True):
        self.path, self.headers, self.by_stride, self.only = path, headers, by_stride, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("frame_idx",):
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[Pages | store.Together]:
        alone, together = store.divided(store.listed(self.path))
        with ThreadPoolExecutor(PLANNERS) as pool:
            found = [p for parts in pool.map(self.planned, alone) for p in parts]
        return found + together or [Pages("")]

    def planned(self, path: str, opened=store.Reader) -> list[Pages]:
        try:
            read = opened(path)
            tiff = Tiff(read)
            index = pages.measured(tiff, read.size) if self.by_stride else None
            if index is None:
                offsets = tuple(h.off for h in tiff.headers())
                return [Pages(path, k, n, offsets[k : k + n], last=len(offsets) - 1) for k, n in self._ranges(len(offsets))]
            return [Pages(path, k, n, (index.offset(k),), index.stride, index.count - 1) for k, n in self._ranges(index.count)]
        except (ValueError, OSError) as reason:
            return [Pages(path, error=str(reason))] if self.only is None else []

    def _ranges(self, count: int) -> list[tuple[int, int]]:
        if self.only is not None:
            return [(self.only, 1)] if 0 <= self.only < count else []
        return [(k, min(PAGES_PER_PARTITION, count - k)) for k in range(0, count, PAGES_PER_PARTITION)]

    def read(self, partition: Pages | store.Together):
        if isinstance(partition, store.Together):
            held = lru_cache(1)(store.Held)
            for path in partition.paths():
                for part in self.planned(path, held):
                    yield from self._rows(part, held)
        else:
            yield from self._rows(partition, store.Reader)

    def _rows(self, partition: Pages, opened):
        if partition.error:
            yield (partition.path, *[None] * (15 if self.headers else 7), partition.error)
        tiff = Tiff(opened(partition.path)) if partition.count else None
        for k in range(partition.count):
            off, at = partition.offset(k), partition.first + k
            page = tiff.header(off)
            if partition.stride and (page is None or page.next_off != (0 if at == partition.last else off + partition.stride)):
                raise ValueError(f"page {at} of {partition.path} isn't where its first two pages put it; read it with option index=walk")
            if self.headers:
                one = page.one
                yield (partition.path, at, page.off, page.next_off, one(WIDTH), one(HEIGHT), one(BITS, 1), one(SPP, 1), one(COMPRESSION, 1), one(PHOTOMETRIC), one(SAMPLE_FORMAT, 1), one(PLANAR, 1), one(PREDICTOR, 1), TILE_WIDTH in page.tags, list(page.places), list(page.tags.get(TILE_COUNTS) or page.tags.get(STRIP_COUNTS, ())), None)
                continue
            try:
                f = tiff.decode(page)
                yield (partition.path, at, f["w"], f["h"], f["channels"], f["dtype"], f["is_mask"], f["samples"].tolist(), None)
            except ValueError as reason:
                yield (partition.path, at, *[None] * 6, str(reason))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffFrames)


@dataclass(frozen=True)
class Layout:
    """How pages are written: byte order, classic or Big, codec, predictor, strips of so many rows or tiles, channels together or apart."""

    order: str = "<"
    big: bool = False
    compression: str = "none"
    predictor: int = 1
    rows_per_strip: int | None = None
    tile: tuple[int, int] | None = None
    planar: int = 1

    @property
    def signature(self) -> bytes:
        mark = b"II" if self.order == "<" else b"MM"
        return mark + (struct.pack(f"{self.order}HHHQ", 43, 8, 0, 16) if self.big else struct.pack(f"{self.order}HI", 42, 8))

    def segments(self, image: np.ndarray) -> list[bytes]:
        """The strips or tiles of (rows, columns, channels), compressed."""
        h, w, spp = image.shape
        rows, cols = self.tile or (self.rows_per_strip or h, w)
        out = []
        for plane in [image] if self.planar == 1 else [image[:, :, c : c + 1] for c in range(spp)]:
            for y in range(0, h, rows):
                for x in range(0, w, cols):
                    part = plane[y : y + rows, x : x + cols]
                    if self.tile:
                        part = np.pad(part, ((0, rows - part.shape[0]), (0, cols - part.shape[1]), (0, 0)))
                    out.append(codecs.ENCODERS[self.compression][1](codecs.predicted(np.ascontiguousarray(part), self.predictor, self.order)))
        return out

    def page(self, image: np.ndarray, at: int, last: bool) -> bytes:
        """A page to stand at ``at``: directory, long tag values, strips; unless it is the last it points behind itself."""
        image = image[:, :, None] if image.ndim == 2 else image
        h, w, spp = image.shape
        pointer, width = ("Q", 8) if self.big else ("I", 4)
        data = self.segments(image)
        sizes = [len(x) for x in data]
        places = (TILE_OFFSETS, TILE_COUNTS) if self.tile else (STRIP_OFFSETS, STRIP_COUNTS)
        kind = {"f": 3, "i": 2}.get(image.dtype.kind, 1)
        tags = {WIDTH: [w], HEIGHT: [h], BITS: [image.dtype.itemsize * 8], COMPRESSION: [codecs.ENCODERS[self.compression][0]], PHOTOMETRIC: [1 if spp == 1 else 2], SPP: [spp], PLANAR: [self.planar], SAMPLE_FORMAT: [kind]}
        tags |= ({PREDICTOR: [self.predictor]} if self.predictor != 1 else {}) | ({TILE_WIDTH: [self.tile[1]], TILE_HEIGHT: [self.tile[0]]} if self.tile else {ROWS_PER_STRIP: [self.rows_per_strip or h]})
        tags |= {places[0]: sizes, places[1]: sizes}
        directory = (8 if self.big else 2) + len(tags) * (20 if self.big else 12) + width
        long_at = at + directory
        body_at = long_at + sum(width * len(v) for v in tags.values() if len(v) > 1)
        tags[places[0]] = (body_at + np.append(0, np.cumsum(sizes))[:-1]).tolist()
        out, long = bytearray(struct.pack(f"{self.order}{'Q' if self.big else 'H'}", len(tags))), bytearray()
        for tag, values in sorted(tags.items()):
            value = values[0] if len(values) == 1 else long_at + len(long)
            out += struct.pack(f"{self.order}HH{pointer}{pointer}", tag, 16 if self.big else 4, len(values), value)
            long += struct.pack(f"{self.order}{len(values)}{pointer}", *values) if len(values) > 1 else b""
        out += struct.pack(f"{self.order}{pointer}", 0 if last else body_at + sum(sizes))
        return bytes(out + long) + b"".join(data)


def encode(images: list[np.ndarray], order: str = "<", big: bool = False, **how) -> bytes:
    """A TIFF of 2-d (mono) or 3-d pages of numbers."""
    layout = Layout(order, big, **how)
    out = bytearray(layout.signature)
    for k, image in enumerate(images):
        out += layout.page(image, len(out), k == len(images) - 1)
    return bytes(out)
