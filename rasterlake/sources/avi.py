"""Video files whose frames stand alone: uncompressed and Motion-JPEG AVI.

``spark.read.format("avi_frames").load(glob)`` plans from each file's headers and index:
one partition a range of frames, whose task seeks to them and reads no others. Of many files
the small ones are planned by the tasks that read them, many a task (``store.divided``). A file
without an index is indexed from its chunk headers. A ``frame_idx = n`` filter becomes one
frame's read. A file or frame that can't be read is a row with the reason.

``AviStream`` writes a file of up to as many frames as its caller holds; longer videos are
runs of files, as with other media.
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

from rasterlake.sources import jpeg, store

FRAME_FIELDS = "media_id string, frame_idx int, w int, h int, channels int, dtype string, is_mask boolean, samples array<float>, seconds double, error string"
FRAMES_PER_PARTITION, PLANNERS = 64, 8
#: What compressed streams call themselves, and flags of headers and index entries.
UNCOMPRESSED, MOTION_JPEG, HAS_INDEX, KEY_FRAME = (b"\0\0\0\0", b"DIB ", b"RGB "), (b"MJPG", b"mjpg", b"JPEG"), 0x10, 0x10


@dataclass(frozen=True)
class Video:
    """What the headers say, and each frame's (offset, bytes)."""

    w: int
    h: int
    top_down: bool
    bits: int
    codec: bytes
    rate: float
    frames: tuple[tuple[int, int], ...]


def chunks(read, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, offset of its content, size) of chunks that lie one after another."""
    while start + 8 <= end:
        head = read(start, 8)
        if len(head) < 8:
            return
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        yield name, start + 8, size
        start += 8 + size + size % 2


def opened(read, size: int) -> Video:
    """The first video stream of a file; ValueError has the reason if there is none."""
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    stream, movi, index = None, None, None
    for name, at, n in chunks(read, 12, size):
        kind = read(at, 4) if name == b"LIST" else name
        if kind == b"hdrl":
            stream = _stream(read, at + 4, at + n)
        elif kind == b"movi":
            movi = (at, min(n, size - at))
        elif name == b"idx1":
            index = read(at, n)
    if stream is None or movi is None:
        raise ValueError("an AVI file without a video stream")
    number, w, h, bits, codec, rate = stream
    frames = _indexed(index, number, *movi, read) if index else [(at, n) for name, at, n in chunks(read, movi[0] + 4, sum(movi)) if _is_frame(name, number)]
    return Video(w, abs(h), h < 0, bits, codec, rate, tuple(frames))


def _is_frame(name: bytes, number: int) -> bool:
    return name[:2] == b"%02d" % number and name[2:] in (b"db", b"dc")


def _stream(read, start: int, end: int) -> tuple | None:
    number = 0
    for name, at, n in chunks(read, start, end):
        if name == b"LIST" and read(at, 4) == b"strl":
            parts = {k: read(a, m) for k, a, m in chunks(read, at + 4, at + n)}
            head, form = parts.get(b"strh", b""), parts.get(b"strf", b"")
            if head[:4] == b"vids" and len(head) >= 28 and len(form) >= 40:
                scale, rate = struct.unpack("<II", head[20:28])
                w, h, _, bits, codec = struct.unpack("<iiHH4s", form[4:20])
                return number, w, h, bits, codec, rate / scale if scale and rate else 0.0
            number += 1
    return None


def _indexed(index: bytes, number: int, movi: int, size: int, read) -> list[tuple[int, int]]:
    """Offsets count from the list's name, or in some files from the start of the file."""
    rows = np.frombuffer(index, np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")]), len(index) // 16)
    own = [(int(r["at"]), int(r["n"])) for r in rows if _is_frame(bytes(r["name"]), number)]
    base = 0 if own and read(own[0][0], 4)[:2] == b"%02d" % number and own[0][0] >= movi else movi
    return [(base + at + 8, n) for at, n in own if base + at + 8 + n <= movi + size]


def decoded(video: Video, data: bytes) -> np.ndarray:
    """(rows, columns, channels) of one frame."""
    if video.codec in MOTION_JPEG:
        return jpeg.Decoder(data).image()
    if video.codec not in UNCOMPRESSED or video.bits != 24:
        raise ValueError(f"no decoder for {video.codec.decode('latin-1').strip(chr(0)) or video.bits} video")
    row = -(-video.w * 3 // 4) * 4
    if len(data) < row * video.h:
        raise ValueError("frame data is short")
    lines = np.frombuffer(data, np.uint8, row * video.h).reshape(video.h, row)[:, : video.w * 3].reshape(video.h, video.w, 3)
    return (lines if video.top_down else lines[::-1])[:, :, ::-1]


class AviStream:
    """A file of frames of one size, put together when it is closed."""

    def __init__(self, out, rate: float = 25.0, compressed: bool = False):
        self.out, self.rate, self.compressed, self.shape, self.frames = out, rate, compressed, None, []

    def add(self, frame: np.ndarray) -> None:
        frame = np.repeat(frame, 3, axis=2) if frame.shape[2] == 1 else frame[:, :, :3]
        self.shape = self.shape or frame.shape
        if frame.shape != self.shape:
            raise ValueError("frames of a video are of one size")
        if self.compressed:
            self.frames.append(jpeg.encode(frame, quality=95, sampling=(2, 2)))
        else:
            self.frames.append(np.pad(frame[::-1, :, ::-1].reshape(frame.shape[0], -1), ((0, 0), (0, -frame.shape[1] * 3 % 4))).tobytes())

    def close(self) -> None:
        h, w, _ = self.shape
        chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
        most, name = max(map(len, self.frames)), b"00dc" if self.compressed else b"00db"
        codec, scale = (b"MJPG" if self.compressed else b"\0\0\0\0"), 1000
        avih = struct.pack("<14I", round(1e6 / self.rate), 0, 0, HAS_INDEX, len(self.frames), 0, 1, most, w, h, 0, 0, 0, 0)
        strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", codec, 0, 0, 0, 0, scale, round(self.rate * scale), 0, len(self.frames), most, 0xFFFFFFFF, 0, 0, 0, w, h)
        strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, codec, most, 0, 0, 0, 0)
        hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
        index, at, body = b"", 4, []
        for frame in self.frames:
            index += name + struct.pack("<III", KEY_FRAME, at, len(frame))
            body.append(chunk(name, frame))
            at += len(body[-1])
        content = b"AVI " + hdrl + chunk(b"LIST", b"movi" + b"".join(body)) + chunk(b"idx1", index)
        self.out.write(b"RIFF" + struct.pack("<I", len(content)) + content)
        self.out.close()


@dataclass
class Range(InputPartition):
    """Frames of a file that follow one another, or why there are none."""

    path: str
    first: int = 0
    video: Video | None = None
    error: str | None = None


class AviFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "avi_frames"

    def schema(self) -> str:
        return FRAME_FIELDS

    def reader(self, schema) -> AviReader:
        return AviReader(self.options["path"])


class AviReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.only = path, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("frame_idx",):
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[Range | store.Together]:
        alone, together = store.divided(store.listed(self.path))
        with ThreadPoolExecutor(PLANNERS) as pool:
            return [r for found in pool.map(self.planned, alone) for r in found] + together or [Range("")]

    def planned(self, path: str, file=store.Reader) -> list[Range]:
        try:
            read = file(path)
            video = opened(read, read.size)
        except (ValueError, OSError, struct.error) as reason:
            return [Range(path, error=str(reason))] if self.only is None else []
        n = len(video.frames)
        ranges = [(k, min(k + FRAMES_PER_PARTITION, n)) for k in range(0, n, FRAMES_PER_PARTITION)] if self.only is None else [(self.only, self.only + 1)] * (0 <= self.only < n)
        return [Range(path, a, Video(**{**video.__dict__, "frames": video.frames[a:b]})) for a, b in ranges]

    def read(self, partition: Range | store.Together):
        if isinstance(partition, store.Together):
            held = lru_cache(1)(store.Held)
            for path in partition.paths():
                for part in self.planned(path, held):
                    yield from self._rows(part, held)
        else:
            yield from self._rows(partition, store.Reader)

    def _rows(self, partition: Range, file):
        video = partition.video
        if partition.error:
            yield (partition.path, *[None] * 8, partition.error)
        if video is None:
            return
        read = file(partition.path)
        for k, (at, n) in enumerate(video.frames, partition.first):
            seconds = k / video.rate if video.rate else None
            try:
                image = decoded(video, read(at, n))
                h, w, channels = image.shape
                yield (partition.path, k, w, h, channels, "uint8", False, image.ravel().astype(np.float32).tolist(), seconds, None)
            except ValueError as reason:
                yield (partition.path, k, *[None] * 6, seconds, str(reason))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AviFrames)
