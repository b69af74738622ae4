"""Any image file as frames, and frames as image files.

Files are listed and read by Spark's ``binaryFile`` reader, so any store works.
Decoders are looked up by extension; one that is missing, or fails, makes a row
with the reason instead of failing the task, after the frames before it. A file's frames are
handed on one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions.tokens import extension, is_loadable
from rasterlake.sources import bmp, jpeg, png, sink, tiff
from rasterlake.sources.tiff import FRAME_FIELDS


def _tiff_pages(data: bytes) -> Iterator[dict]:
    file = tiff.Tiff(lambda at, n: data[at : at + n])
    return map(file.decode, file.headers())


#: Decoders by extension: bytes to frames, one after another. More can be added before a read.
DECODERS: dict[str, Callable[[bytes], Iterable[dict]]] = {"tif": _tiff_pages, "tiff": _tiff_pages, "png": lambda data: [png.decode(data)], "bmp": lambda data: [bmp.decode(data)]} | dict.fromkeys(("jpg", "jpeg"), lambda data: [jpeg.decode(data)])

_NONE = {"frame_idx": None, "w": None, "h": None, "channels": None, "dtype": None, "is_mask": None, "samples": None}
_SCHEMA = pa.schema([("media_id", pa.string()), ("frame_idx", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("channels", pa.int32()), ("dtype", pa.string()), ("is_mask", pa.bool_()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])


def _decode(decoders: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, ext, content in zip(*(batch.column(c).to_pylist() for c in ("path", "ext", "content")), strict=True):
                try:
                    if ext not in decoders:
                        raise ValueError(f"no decoder for {ext}")
                    for k, frame in enumerate(decoders[ext](content)):
                        yield pa.RecordBatch.from_pylist([{"media_id": path, "frame_idx": k, "error": None, **frame}], _SCHEMA)
                except (ValueError, KeyError, OSError) as reason:
                    yield pa.RecordBatch.from_pylist([{"media_id": path, **_NONE, "error": str(reason)}], _SCHEMA)

    return run


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, frame_idx, ..., samples, error) of every loadable file under ``path``."""
    files = spark.read.format("binaryFile").load(path).filter(is_loadable(F.col("path"))).select("path", extension(F.col("path")).alias("ext"), "content")
    return files.mapInArrow(_decode(DECODERS), f"{FRAME_FIELDS}, error string")


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """The files under ``path`` as one timeline: pages in order of file, then page."""
    from rasterlake.operators.layout import frame_map

    frames = read_frames(spark, path).filter("error IS NULL").withColumnsRenamed({"media_id": "file", "frame_idx": "page"})
    counts = frames.groupBy("file").agg(F.count("*").cast("int").alias("pages")).withColumn("media_id", F.lit(path))
    where = frame_map(counts, "media_id", "file", "pages").withColumnRenamed("frame_idx", "position")
    return frames.join(where, ["file", "page"]).select("media_id", F.col("position").cast("int").alias("frame_idx"), "file", "page", "w", "h", "channels", "dtype", "is_mask", "samples")


def _encode(kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                image = np.array(r["samples"], np.float32).reshape(r["h"], r["w"], r["channels"])
                if kind == "tif":
                    done.append(tiff.encode([image.astype(r["dtype"])]))
                else:
                    done.append(png.encode(sink.shown(image.astype(r["dtype"]))))
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), batch.column("frame_idx"), pa.array(done, pa.binary())], names=["media_id", "frame_idx", "content"])

    return run


def encoded(frames: DataFrame, kind: str) -> DataFrame:
    """(media_id, frame_idx, content): native values as ``tif``, or a full-range 8-bit ``png``."""
    if kind not in ("tif", "png"):
        raise ValueError(f"no encoder for {kind}")
    kept = frames.select("media_id", "frame_idx", "w", "h", "channels", "dtype", "samples")
    return kept.mapInArrow(_encode(kind), f"media_id {frames.schema['media_id'].dataType.simpleString()}, frame_idx int, content binary")
