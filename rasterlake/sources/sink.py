"""Frames into image files: a Python data sink with a two-phase commit.

``frames.write.format("frame_files").option("kind", "tif").mode("append").save(path)``
writes a file a frame, or with ``option("pages", n)`` multi-page TIFFs of up to n pages
whose names number them, so a long media is a run of files that ``tiff_frames`` reads as
one timeline. Each attempt of a task writes into a folder of its own under
``path/_staged``; the commit renames the folders of the attempts that count, one rename a
task, and removes the rest, so a task that is killed, retried or run twice leaves neither
partial nor double files. An overwrite removes what stood there only after all tasks are done.

``kind`` may also be ``png`` or ``jpg``, a still a file, and ``avi`` (``mjpg`` compressed), videos of
up to n frames at ``option("rate")`` frames a second.

``write_frames`` arranges rows first: frames of one file come together and in order. No
task holds more than the page at hand and the one before it, or one video file's frames. A row that has no samples
(a file that couldn't be read) fails the write.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from rasterlake.sources import avi, jpeg, png, store, tiff

COLUMNS = ("media_id", "frame_idx", "w", "h", "channels", "dtype", "samples")
STAGED = "_staged"


@dataclass
class Written(WriterCommitMessage):
    folder: str | None
    files: int


def image(row) -> np.ndarray:
    if row["samples"] is None:
        raise ValueError(f"frame {row['frame_idx']} of {row['media_id']} has no samples")
    return np.array(row["samples"], np.float32).reshape(row["h"], row["w"], row["channels"]).astype(row["dtype"])


def shown(values: np.ndarray) -> np.ndarray:
    """Full-range 8-bit samples."""
    if values.dtype == np.uint8:
        return values
    lo, hi = (0.0, 65535.0) if values.dtype == np.uint16 else (float(np.nanmin(values)), float(np.nanmax(values)))
    scale = np.float32(255 / (hi - lo)) if hi > lo else np.float32(0)
    return np.clip(np.nan_to_num((values.astype(np.float32) - np.float32(lo)) * scale), 0, 255).astype(np.uint8)


def flattened(values: np.ndarray) -> np.ndarray:
    """Without alpha: what is clear turns white."""
    return np.where(values[:, :, 3:] > 0, values[:, :, :3], 255).astype(np.uint8) if values.shape[2] == 4 else values


#: Files of several frames by kind, with their extension, and of one still: 8-bit samples to bytes.
VIDEOS = {"avi": "avi", "mjpg": "avi"}
STILLS = {"png": png.encode, "jpg": lambda values: jpeg.encode(flattened(values), quality=100)}


def file_name(media_id, number: int, kind: str) -> str:
    return f"{quote(str(media_id), safe='')}-{number:08d}.{kind}"


def named(path: str) -> tuple[str, int]:
    """The media and number in a written file's name."""
    media, number = re.search(r"([^/]*)-(\d+)\.\w+$", path).groups()
    return unquote(media), int(number)


class PageStream:
    """A multi-page TIFF written page by page; a page is put down once it is known whether another follows."""

    def __init__(self, out, layout: tiff.Layout):
        self.out, self.layout, self.held, self.at = out, layout, None, len(layout.signature)
        out.write(layout.signature)

    def add(self, page: np.ndarray) -> None:
        self._put(False)
        self.held = page

    def _put(self, last: bool) -> None:
        if self.held is not None:
            data = self.layout.page(self.held, self.at, last)
            self.out.write(data)
            self.at += len(data)

    def close(self) -> None:
        self._put(True)
        self.out.close()


class FrameWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str, pages: int, layout: tiff.Layout, overwrite: bool, rate: float = 25.0):
        if kind not in {"tif", *VIDEOS, *STILLS} or pages < 1 or (kind in STILLS and pages > 1):
            raise ValueError(f"no files of kind {kind} with {pages} pages")
        self.path, self.kind, self.pages, self.layout, self.overwrite, self.rate, self.job = path, kind, pages, layout, overwrite, rate, uuid.uuid4().hex

    def _opened(self, out):
        return avi.AviStream(out, self.rate, self.kind == "mjpg") if self.kind in VIDEOS else PageStream(out, self.layout)

    def _staged(self) -> str:
        return f"{store.opened(self.path)[1].rstrip('/')}/{STAGED}/{self.job}"

    def write(self, iterator: Iterator) -> Written:
        context = TaskContext.get()
        attempt = f"{context.partitionId():05d}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        files, folder = store.opened(self.path)[0], f"{self._staged()}/{attempt}"
        done: set[str] = set()
        stream, open_name = None, None
        try:
            for row in iterator:
                number = row["frame_idx"] // self.pages
                name = file_name(row["media_id"], number, VIDEOS.get(self.kind, self.kind))
                if name != open_name:
                    if stream:
                        stream.close()
                        stream = None
                    if name in done:
                        raise ValueError(f"frames of {name} come more than once or out of order")
                    if not done:
                        files.create_dir(folder, recursive=True)
                    done.add(name)
                    open_name = name
                elif self.pages == 1:
                    raise ValueError(f"frame {row['frame_idx']} of {row['media_id']} comes more than once")
                if self.kind in STILLS:
                    with files.open_output_stream(f"{folder}/{name}") as out:
                        out.write(STILLS[self.kind](shown(image(row))))
                    continue
                stream = stream or self._opened(files.open_output_stream(f"{folder}/{name}"))
                stream.add(shown(image(row)) if self.kind in VIDEOS else image(row))
            if stream:
                stream.close()
        except BaseException:
            if done:
                files.delete_dir(folder)
            raise
        return Written(attempt if done else None, len(done))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = store.opened(self.path)
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.base_name != STAGED:
                    (files.delete_dir if old.type == fs.FileType.Directory else files.delete_file)(old.path)
        files.create_dir(root, recursive=True)
        for message in messages:
            if message is not None and message.folder:
                files.move(f"{self._staged()}/{message.folder}", f"{root.rstrip('/')}/part-{message.folder}-{self.job[:8]}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """This job's attempts go, and the folder of all jobs once it is empty."""
        files, staged = store.opened(self.path)[0], self._staged()
        if files.get_file_info(staged).type == fs.FileType.Directory:
            files.delete_dir(staged)
        above = staged.rpartition("/")[0]
        if files.get_file_info(above).type == fs.FileType.Directory and not files.get_file_info(fs.FileSelector(above)):
            files.delete_dir(above)


class FrameFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return tiff.FRAME_FIELDS

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        missing = [c for c in COLUMNS if c not in schema.names]
        if missing:
            raise ValueError(f"frames lack {', '.join(missing)}")
        layout = tiff.Layout(big=str(self.options.get("big", "false")).lower() == "true", compression=self.options.get("compression", "none"), predictor=int(self.options.get("predictor", "1")))
        return FrameWriter(self.options["path"], self.options.get("kind", "tif"), int(self.options.get("pages", "1")), layout, overwrite, float(self.options.get("rate", "25")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameFiles)


def write_frames(frames: DataFrame, path: str, kind: str = "tif", pages: int = 1, compression: str = "none", predictor: int = 1, mode: str = "append", rate: float = 25.0) -> None:
    """Frames into files below ``path``; rows of a file are brought together first where it holds several."""
    register(frames.sparkSession)
    rows = frames.select(*COLUMNS)
    if pages > 1:
        number = F.floor(F.col("frame_idx") / pages)
        rows = rows.repartition("media_id", number).sortWithinPartitions("media_id", "frame_idx")
    rows.write.format("frame_files").option("kind", kind).option("pages", pages).option("compression", compression).option("predictor", predictor).option("rate", rate).mode(mode).save(path)


def media_of(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, r"([^/]*)-\d+\.\w+$", 1))


def number_of(path: Column) -> Column:
    return F.regexp_extract(path, r"-(\d+)\.\w+$", 1).cast("int")


def read_back(spark: SparkSession, path: str, pages: int = 1) -> DataFrame:
    """The frames of written TIFFs, with the media and numbers that they were written with."""
    tiff.register(spark)
    found = spark.read.format("tiff_frames").load(f"{path}/part-*/*.tif")
    number = number_of(F.col("media_id")) * pages + F.col("frame_idx")
    return found.withColumns({"media_id": media_of(F.col("media_id")), "frame_idx": number.cast("int")})
