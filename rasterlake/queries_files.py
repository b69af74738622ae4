"""Queries over frames that were written to files and read back, and over file layouts.

What is written goes to the shared folder of the session (``plans.stage``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rasterlake.plans import views as V
from rasterlake.plans.stage import shared_dir
from rasterlake.queries import FRAMES_SQL, query
from rasterlake.sources import avi, files, sink


def _through_files(frames, pages: int, compression: str, predictor: int):
    spark = frames.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/frames/{uuid.uuid4().hex}"
    sink.write_frames(frames, path, pages=pages, compression=compression, predictor=predictor)
    return sink.read_back(spark, path, pages)


MEASURES_SQL = "len(s) AS n, min(v) AS lo, max(v) AS hi, sum(CAST(v AS DOUBLE) * i) AS weighed"


def _measured(frames):
    """Size, extent and a sum that every sample's value and place goes into."""
    place = F.transform("samples", lambda x, i: x.cast("double") * (i + 1))
    weighed = F.aggregate(place, F.lit(0.0), lambda a, x: a + x)
    return frames.select(F.col("media_id").cast("int").alias("media_id"), "frame_idx", "dtype", "is_mask", "error", F.size("samples").alias("n"), F.array_min("samples").alias("lo"), F.array_max("samples").alias("hi"), weighed.alias("weighed"))


def _frames(spark, d, scaled, dtype: str):
    return V.embedding_frames(spark, d).withColumns({"samples": F.transform("samples", scaled), "dtype": F.lit(dtype)})


_MEASURE_SQL = """SELECT media_id, CAST(frame_idx AS INTEGER) AS frame_idx, '{dtype}' AS dtype, false AS is_mask, CAST(NULL AS VARCHAR) AS error, 64 AS n, CAST(list_min(s) AS FLOAT) AS lo, CAST(list_max(s) AS FLOAT) AS hi,
    list_sum(list_transform(s, lambda x, i: CAST(x AS DOUBLE) * i)) AS weighed FROM (SELECT media_id, frame_idx, list_transform(samples, lambda x: {scaled}) AS s FROM f)"""


@query(f"WITH {FRAMES_SQL} {_MEASURE_SQL.format(dtype='uint16', scaled='floor(32768 + CAST(x AS DOUBLE) * 32768)')}")
def lzw_frames(spark, d):
    """Differenced 16-bit frames through LZW files of 16 pages."""
    frames = _frames(spark, d, lambda x: F.floor(32768 + x.cast("double") * 32768).cast("float"), "uint16")
    return _measured(_through_files(frames, 16, "lzw", 2))


@query(f"WITH {FRAMES_SQL} {_MEASURE_SQL.format(dtype='uint8', scaled='floor(CAST(x AS DOUBLE) * 4) * 20 + 100')}")
def packbits_frames(spark, d):
    """8-bit frames through PackBits files, one a frame."""
    frames = _frames(spark, d, lambda x: (F.floor(x.cast("double") * 4) * 20 + 100).cast("float"), "uint8")
    return _measured(_through_files(frames, 1, "packbits", 1))


@query(f"WITH {FRAMES_SQL} SELECT media_id, frame_idx, dtype, is_mask, error, n, lo, hi, round(weighed, 6) AS weighed FROM ({_MEASURE_SQL.format(dtype='float32', scaled='x')})")
def deflate_frames(spark, d):
    """Float frames through Deflate files whose bytes are differenced by their significance."""
    return _measured(_through_files(_frames(spark, d, lambda x: x, "float32"), 16, "deflate", 3)).withColumn("weighed", F.round("weighed", 6))


@query(f"WITH {FRAMES_SQL} SELECT media_id, CAST(frame_idx AS INTEGER) AS frame_idx, samples[1] AS first, samples[64] AS last FROM f WHERE frame_idx % 32 = 5")
def indexed_pages(spark, d):
    """Page 5 of each file of 32 plain pages, found by its stride."""
    frames = _frames(spark, d, lambda x: x, "float32")
    path = f"{shared_dir(spark).rstrip('/')}/frames/{uuid.uuid4().hex}"
    sink.write_frames(frames, path, pages=32)
    sink.tiff.register(spark)
    found = spark.read.format("tiff_frames").load(f"{path}/part-*/*.tif").filter(F.col("frame_idx") == 5)
    number = sink.number_of(F.col("media_id")) * 32 + F.col("frame_idx")
    return found.select(sink.media_of(F.col("media_id")).cast("int").alias("media_id"), number.cast("int").alias("frame_idx"), F.element_at("samples", 1).alias("first"), F.element_at("samples", 64).alias("last"))


@query("SELECT vec_id, 16 AS pixels, 3 AS channels, true AS grey_kept, true AS close FROM embeddings")
def jpeg_frames(spark, d):
    """RGBA frames through JPEG files: their alpha goes, clear pixels turn white, and grey differs by 2 at most."""
    frames = V.embedding_frames(spark, d)
    grey = F.transform("samples", lambda x: F.floor(F.abs(x.cast("double")) * 400) % 256)
    pixels = F.transform(F.slice(grey, 1, 16), lambda g: F.array(g, g, g, F.when(g > 20, 255).otherwise(0)).cast("array<float>"))
    rgba = frames.select("media_id", "frame_idx", F.lit(4).alias("w"), F.lit(4).alias("h"), F.lit(4).alias("channels"), F.lit("uint8").alias("dtype"), F.flatten(pixels).alias("samples"))
    path = f"{shared_dir(spark).rstrip('/')}/frames/{uuid.uuid4().hex}"
    sink.write_frames(rgba, path, kind="jpg")
    back = files.read_frames(spark, f"{path}/part-*").select(sink.media_of(F.col("media_id")).cast("int").alias("media_id"), sink.number_of(F.col("media_id")).cast("long").alias("frame_idx"), "channels", F.col("samples").alias("got"))
    vectors = V.table(spark, d, "embeddings").select(F.col("label").alias("media_id"), "vec_id")
    both = V.numbered(vectors, "media_id", "vec_id").join(rgba.select("media_id", "frame_idx", "samples"), ["media_id", "frame_idx"]).join(back, ["media_id", "frame_idx"])
    place = F.sequence(F.lit(0), F.lit(15))
    want = F.transform(place, lambda k: F.when(F.get("samples", k * 4 + 3) > 0, F.get("samples", k * 4)).otherwise(255))
    close = F.forall(F.zip_with(want, F.transform(place, lambda k: F.get("got", k * 3)), lambda a, b: F.abs(a - b)), lambda e: e <= 2)
    kept = F.forall(place, lambda k: (F.abs(F.get("got", k * 3) - F.get("got", k * 3 + 1)) <= 1) & (F.abs(F.get("got", k * 3) - F.get("got", k * 3 + 2)) <= 1))
    return both.select("vec_id", F.size(place).alias("pixels"), "channels", kept.alias("grey_kept"), close.alias("close"))


@query(f"""WITH {FRAMES_SQL}, g AS (SELECT media_id, frame_idx, list_transform(samples, lambda x: floor(CAST(abs(x) AS DOUBLE) * 400) % 256) AS s FROM f)
    SELECT media_id, CAST(frame_idx AS INTEGER) AS frame_idx, CAST(frame_idx % 24 AS DOUBLE) / 12 AS seconds, 3 AS channels, list_sum(list_transform(s, lambda x, i: x * i)) AS weighed FROM g WHERE frame_idx % 24 < 20""")
def video_ranges(spark, d):
    """Frames through videos of 24 frames at 12 a second, all but the last four of each read back."""
    frames = _frames(spark, d, lambda x: F.floor(F.abs(x.cast("double")) * 400) % 256, "uint8")
    path = f"{shared_dir(spark).rstrip('/')}/frames/{uuid.uuid4().hex}"
    sink.write_frames(frames, path, kind="avi", pages=24, rate=12)
    avi.register(spark)
    found = spark.read.format("avi_frames").load(f"{path}/part-*/*.avi").filter("frame_idx < 20")
    red = F.filter("samples", lambda x, i: i % 3 == 0)
    weighed = F.aggregate(F.transform(red, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    number = sink.number_of(F.col("media_id")) * 24 + F.col("frame_idx")
    return found.select(sink.media_of(F.col("media_id")).cast("int").alias("media_id"), number.cast("int").alias("frame_idx"), "seconds", "channels", weighed.alias("weighed"))
