"""Extents, histograms, percentiles and region statistics of pixels.

Every aggregate has a partial stage, so a media of a third of all pixels costs one
row a task and bin. Only histograms are windowed: 256 to 65,536 rows a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions.tone import histogram_bin
from rasterlake.operators import packed

FLOAT_BINS = 4096


def _finite(value: str = "v") -> Column:
    return F.when(~F.isnan(value), F.col(value))


def extent(px: DataFrame, keys: list[str], nominal: float = 1.0) -> DataFrame:
    """(lo, hi) without NaN; all-NaN groups get (0, nominal)."""
    lo, hi = F.min(_finite()), F.max(_finite())
    return px.groupBy(*keys).agg(F.coalesce(lo, F.lit(0.0).cast("float")).alias("lo"), F.coalesce(hi, F.lit(nominal).cast("float")).alias("hi"))


def with_extent(px: DataFrame, keys: list[str], nominal: float = 1.0) -> DataFrame:
    """Pixels with their group's extent joined on."""
    return px.join(extent(px, keys, nominal), keys)


def histogram(px: DataFrame, keys: list[str], bins: int, per: tuple[str, ...] = ()) -> DataFrame:
    """Counts by bin over each group's shared extent, split by ``per`` (channels)."""
    return binned_counts(with_extent(px.filter(~F.isnan("v")), keys), keys, bins, per)


def binned_counts(px: DataFrame, keys: list[str], bins: int, per: tuple[str, ...] = ()) -> DataFrame:
    """Counts by bin of pixels that carry their extent, as those of packed frames do."""
    binned = px.filter(~F.isnan("v")).withColumn("bin", histogram_bin(F.col("v"), F.col("lo"), F.col("hi"), bins))
    return binned.groupBy(*keys, *per, "bin").agg(F.count("*").alias("n"))


def value_counts(px: DataFrame, keys: list[str]) -> DataFrame:
    return px.groupBy(*keys, "v").agg(F.count("*").alias("n"))


def peak(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The bin of the largest count; ties take the last bin."""
    return counts.groupBy(*keys).agg(F.max(F.struct("n", "bin")).alias("top")).select(*keys, "top.bin", "top.n")


def tail_bins(counts: DataFrame, keys: list[str], percent: float, value: str, last: int) -> DataFrame:
    """(lo, hi) values of the low and high tails: the first whose running count passes, or reaches, its threshold.

    Thresholds are truncated in single precision; past the last bin both stop there.
    """
    by = Window.partitionBy(*keys)
    run = counts.withColumn("run", F.sum("n").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))
    single = lambda x: F.lit(x).cast("float")
    total = F.col("total").cast("float")
    low_t = ((total * single(percent)).cast("float") / single(100.0)).cast("float").cast("long")
    high_t = (total * (single(1.0) - (single(percent) / single(100.0)).cast("float")).cast("float")).cast("float").cast("long")
    return run.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("run") > low_t, F.col(value))), F.lit(last)).alias("low"),
        F.least(F.lit(last), F.coalesce(F.min(F.when(F.col("run") >= high_t, F.col(value))), F.lit(last))).alias("high"),
    )


def int_percentiles(px: DataFrame, keys: list[str], percent: float, top: int, fallback: tuple[float, float] | None = None) -> DataFrame:
    """(lo, hi) at the tails of integer pixels; equal tails take the fallback, or the extent if there is none."""
    counts = value_counts(px, keys)
    tails = tail_bins(counts, keys, percent, "v", top)
    collapsed = F.col("high") <= F.col("low")
    if fallback is None:
        tails = tails.join(counts.groupBy(*keys).agg(F.min("v").alias("v_min"), F.max("v").alias("v_max")), keys)
        return tails.select(*keys, F.when(collapsed, F.col("v_min")).otherwise(F.col("low")).alias("lo"), F.when(collapsed, F.col("v_max")).otherwise(F.col("high")).alias("hi"))
    return tails.select(*keys, F.when(collapsed, fallback[0]).otherwise(F.col("low")).alias("lo"), F.when(collapsed, fallback[1]).otherwise(F.col("high")).alias("hi"))


def float_percentiles(px: DataFrame, keys: list[str], percent: float) -> DataFrame:
    """(lo, hi) at the tails of float pixels over 4096 bins of the extent."""
    return _at_tails(tail_bins(histogram(px, keys, FLOAT_BINS), keys, percent, "bin", FLOAT_BINS - 1).join(extent(px, keys), keys), keys)


def _at_tails(tails: DataFrame, keys: list[str]) -> DataFrame:
    single = lambda x: F.lit(x).cast("float")
    span = (F.col("hi") - F.col("lo")).cast("float")
    at = lambda b: (F.col("lo") + ((F.col(b).cast("float") / single(FLOAT_BINS - 1.0)).cast("float") * span).cast("float")).cast("float")
    flat = (F.col("hi") <= F.col("lo")) | (F.col("high") <= F.col("low"))
    return tails.select(*keys, F.when(flat, F.col("lo")).otherwise(at("low")).alias("p_lo"), F.when(flat, F.col("hi")).otherwise(at("high")).alias("p_hi"))


def frame_bounds(frames: DataFrame, keys: list[str], w: int, h: int, percent: float | None = None, region: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(lo, hi) of packed float frames: of the region if it covers a pixel, else of the whole frame; clipped at both tails if percent is given."""
    return bounds_by_case(frames, keys, w, h, [("", percent, region)]).drop("subject")


def bounds_by_case(frames: DataFrame, keys: list[str], w: int, h: int, cases: list[tuple[str, float | None, tuple[float, float, float, float] | None]]) -> DataFrame:
    """(subject, lo, hi) of each frame by every case of (subject, percent, region), in one pass over packed frames: no pixel leaves its row."""
    inside = lambda region: region and packed.region_bounds(*region, w, h)
    of = lambda region: packed.crop(F.col("samples"), w, *inside(region)) if inside(region) else F.col("samples")
    structs = [F.struct(F.lit(name).alias("subject"), F.lit(percent).cast("float").alias("percent"), of(region).alias("samples")) for name, percent, region in cases]
    rows = packed.with_extent(frames.select(*keys, F.inline(F.array(*structs))))
    rows = rows.withColumn("bins", F.when(F.col("percent").isNotNull(), packed.sorted_bins(F.col("samples"), F.col("lo"), F.col("hi"), FLOAT_BINS)))
    low, high = packed.tails(F.col("bins"), F.col("percent"), FLOAT_BINS - 1)
    tails = _at_tails(rows.withColumns({"low": low, "high": high}), [*keys, "subject", "percent", "lo", "hi"])
    clipped = lambda c: F.when(F.col("percent").isNull(), F.col(c)).otherwise(F.col(f"p_{c}")).alias(c)
    return tails.select(*keys, "subject", clipped("lo"), clipped("hi"))


def in_region(px: DataFrame, x0: float, y0: float, x1: float, y1: float, w: int, h: int) -> DataFrame:
    """Pixels of a float rectangle: outer integer bounds, clamped; none if it is empty."""
    left, top, right, bottom = (int(max(0, min(n, v))) for v, n in ((x0 // 1, w), (y0 // 1, h), (-(-x1 // 1), w), (-(-y1 // 1), h)))
    return px.filter((F.col("x") >= left) & (F.col("x") < right) & (F.col("y") >= top) & (F.col("y") < bottom))


def region_stats(px: DataFrame, keys: list[str]) -> DataFrame:
    """Count, extent, mean and population deviation; NaN pixels count but add nothing."""
    v, n = _finite().cast("double"), F.count("*")
    mean, square = F.coalesce(F.sum(v), F.lit(0.0)) / n, F.coalesce(F.sum(v * v), F.lit(0.0)) / n
    return px.groupBy(*keys).agg(n.alias("n"), F.min(_finite()).alias("lo"), F.max(_finite()).alias("hi"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))
