"""Stack reductions, frame arithmetic, crops, decimation and line samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.plans.views import f32

LINE_POINTS = (2, 4096)


def stack(px: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """Mean and population deviation of each sample place over the frames of a stack."""
    v = F.col("v").cast("double")
    mean = F.sum(v) / F.count("*")
    return px.groupBy(*keys, *at).agg(f32(mean).alias("mean"), f32(F.sqrt(F.greatest(F.sum(v * v) / F.count("*") - mean * mean, F.lit(0.0)))).alias("std"), F.count("*").alias("frames"))


def same_shape(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames of the shape of their stack's first; later odd ones are skipped."""
    shape = F.struct("w", "h", "channels")
    first = frames.groupBy(*keys).agg(F.min_by(shape, "frame_idx").alias("first_shape"))
    return frames.join(first, keys).filter(shape == F.col("first_shape")).drop("first_shape")


def combine(a: Column, b: Column, kind: str) -> Column:
    """Packed frames of one shape, added or subtracted in single precision; else null. No shuffle."""
    op = {"add": lambda x, y: (x + y).cast("float"), "sub": lambda x, y: (x - y).cast("float")}[kind]
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, op))


def crop(px: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    inside = px.filter((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h))
    return inside.withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def decimate(px: DataFrame, step: int) -> DataFrame:
    """Every step-th sample of both axes, never blended."""
    kept = px.filter((F.col("x") % step == 0) & (F.col("y") % step == 0))
    return kept.withColumns({"x": F.floor(F.col("x") / step).cast("int"), "y": F.floor(F.col("y") / step).cast("int")})


def line_points(ax: float, ay: float, bx: float, by: float) -> list[tuple[int, int, int]]:
    """(k, x, y) of the pixels under a line."""
    n = int(min(LINE_POINTS[1], max(LINE_POINTS[0], math.floor(math.hypot(bx - ax, by - ay) + 0.5) + 1)))
    return [(k, math.floor(ax + (bx - ax) * k / (n - 1)), math.floor(ay + (by - ay) * k / (n - 1))) for k in range(n)]


def line_profile(px: DataFrame, keys: list[str], line: tuple[float, float, float, float]) -> DataFrame:
    """Samples along a line for each frame; NaN outside it. The line is at most 4096 points."""
    points = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, x, y in line_points(*line))))
    wanted = px.select(*keys).distinct().select(*keys, points.alias("p")).select(*keys, "p.*")
    return wanted.join(px.select(*keys, "x", "y", "v"), [*keys, "x", "y"], "left").select(*keys, "k", "x", "y", F.coalesce("v", F.lit(float("nan")).cast("float")).alias("v"))
