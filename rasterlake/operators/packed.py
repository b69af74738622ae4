"""Packed frames, one row each, as column expressions: nothing here shuffles or explodes.

``samples`` are row-major with interleaved channels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.tone import histogram_bin, linear
from rasterlake.operators.frames import line_points

NAN = float("nan")


def extent(samples: Column, nominal: float = 1.0) -> tuple[Column, Column]:
    """(lo, hi) without NaN; a frame of NaN alone gets (0, nominal)."""
    single = lambda x: F.lit(x).cast("float")
    # NaN is the largest of an array, so only a frame that holds one is filtered
    lo, top = F.array_min(samples), F.array_max(samples)
    hi = F.when(F.isnan(top), F.array_max(F.filter(samples, lambda v: ~F.isnan(v)))).otherwise(top)
    return F.coalesce(F.when(~F.isnan(lo), lo), single(0.0)), F.coalesce(hi, single(nominal))


def with_extent(frames: DataFrame, nominal: float = 1.0) -> DataFrame:
    lo, hi = extent(F.col("samples"), nominal)
    return frames.withColumns({"lo": lo, "hi": hi})


def sorted_bins(samples: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin of every sample that is a number, in order: a histogram that stays in its row."""
    return F.array_sort(F.transform(F.filter(samples, lambda v: ~F.isnan(v)), lambda v: histogram_bin(v, lo, hi, bins)))


def tails(bins: Column, percent: Column, last: int) -> tuple[Column, Column]:
    """The bins whose running counts pass the low threshold and reach the high one, of bins in order.

    Thresholds are truncated in single precision; past the last bin both stop there.
    """
    single = lambda x: F.lit(x).cast("float")
    total = F.size(bins).cast("float")
    low_t = ((total * percent).cast("float") / single(100.0)).cast("float").cast("int")
    high_t = (total * (single(1.0) - (percent / single(100.0)).cast("float")).cast("float")).cast("float").cast("int")
    low, high = F.get(bins, low_t), F.get(bins, F.greatest(high_t - 1, F.lit(0)))
    return F.coalesce(low, F.lit(last)), F.least(F.lit(last), F.coalesce(high, F.lit(last)))


def drop_alpha(samples: Column, channels: int = 4) -> Column:
    """The colour samples of frames with an alpha channel."""
    return F.filter(samples, lambda _, i: i % channels < channels - 1)


def region_bounds(x0: float, y0: float, x1: float, y1: float, w: int, h: int) -> tuple[int, int, int, int] | None:
    """Outer integer bounds of a float rectangle inside the frame; None if no pixel is."""
    left, top, right, bottom = (int(max(0, min(n, v))) for v, n in ((x0 // 1, w), (y0 // 1, h), (-(-x1 // 1), w), (-(-y1 // 1), h)))
    return (left, top, right, bottom) if left < right and top < bottom else None


def crop(samples: Column, w: int, left: int, top: int, right: int, bottom: int) -> Column:
    """The samples of a mono frame inside integer bounds."""
    rows = F.array(*(F.slice(samples, y * w + left + 1, right - left) for y in range(top, bottom)))
    return F.flatten(rows)


def decimate(samples: Column, w: int, step: int) -> Column:
    """Every step-th sample of both axes of a mono frame, never blended."""
    return F.filter(samples, lambda _, i: (i % w % step == 0) & (F.floor(i / w) % step == 0))


def thumbnails(frames: DataFrame, w: int, h: int, size: int) -> DataFrame:
    """Mono frames with lo and hi, decimated until they fit ``size`` and shown in their own window: w, h and ``grey`` replace the samples."""
    step = max(1, -(-max(w, h) // size))
    kept = frames.withColumn("kept", decimate(F.col("samples"), w, step))
    grey = F.transform("kept", lambda v: linear(v, F.col("lo"), F.col("hi")))
    return kept.withColumns({"w": F.lit(-(-w // step)), "h": F.lit(-(-h // step)), "grey": grey}).drop("samples", "kept", "lo", "hi")


def at(samples: Column, w: int, x: int, y: int, channels: int = 1, channel: int = 0) -> Column:
    """One sample; null outside the frame."""
    return F.get(samples, F.lit((y * w + x) * channels + channel))


def line(samples: Column, w: int, h: int, ends: tuple[float, float, float, float]) -> Column:
    """(k, x, y, v) along a line of a mono frame; NaN where it leaves the frame."""
    points = line_points(*ends)
    xs, ys = (F.lit([p[k] for p in points]) for k in (1, 2))
    places = F.lit([y * w + x if 0 <= x < w and 0 <= y < h else -1 for _, x, y in points])
    nan = F.lit(NAN).cast("float")
    return F.transform(places, lambda p, k: F.struct(k.alias("k"), F.get(xs, k).alias("x"), F.get(ys, k).alias("y"), F.when(p >= 0, F.get(samples, p)).otherwise(nan).alias("v")))


def moments(samples: Column) -> dict[str, Column]:
    """Count, extent, mean and population deviation; NaN samples count but add nothing."""
    finite, n = F.filter(samples, lambda v: ~F.isnan(v)), F.size(samples)
    total = lambda f: F.aggregate(finite, F.lit(0.0), lambda a, v: a + f(v.cast("double")))
    mean, square = total(lambda v: v) / n, total(lambda v: v * v) / n
    return {"n": n.cast("long"), "lo": F.array_min(finite), "hi": F.array_max(finite), "mean": mean, "std": F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))}


def bounding_box(samples: Column, w: int, shown) -> dict[str, Column]:
    """The smallest box of the samples for which ``shown`` holds; nulls if there are none."""
    places = F.filter(F.transform(samples, lambda v, i: F.when(shown(v), i)), lambda i: i.isNotNull())
    xs, ys = F.transform(places, lambda i: i % w), F.transform(places, lambda i: F.floor(i / w).cast("int"))
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}
