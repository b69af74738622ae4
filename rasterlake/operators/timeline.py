"""Pairing of sequences on one timeline, runs, budgets and rolling measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shown(t: Column, count: Column, synced: Column, own: Column) -> Column:
    """The frame that a media shows at t: synced ones hold their last, others keep their own place."""
    n = F.greatest(count, F.lit(1))
    return F.when(synced, F.least(t, n - 1)).otherwise(own % n).cast("long")


def spans(media: DataFrame, frames: DataFrame) -> DataFrame:
    """(media_id, start, stop, frame_idx): the positions of the common timeline at which each frame is shown.

    media has media_id, count, synced and own; frames has media_id and frame_idx. The timeline is as
    long as its longest media. A synced media's last frame is held to the end, and a media that isn't
    synced shows one frame throughout, so there is one row a frame at most, not one a position.
    """
    longest = media.agg(F.max("count").alias("longest")).scalar()
    of = frames.join(media, "media_id")
    last, at = F.col("count") - 1, F.col("frame_idx")
    held = of.filter(F.col("synced") | (at == F.col("own") % F.col("count")))
    start = F.when(F.col("synced"), at).otherwise(0).cast("long")
    stop = F.when(F.col("synced") & (at < last), at).otherwise(longest - 1).cast("long")
    return held.select("media_id", start.alias("start"), stop.alias("stop"), at.cast("long").alias("frame_idx"))


def runs(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Maximal runs of consecutive numbers: (start, stop, n). Repeated numbers count once."""
    w = Window.partitionBy(*keys).orderBy(number)
    island = df.select(*keys, number).distinct().withColumn("island", F.col(number) - F.row_number().over(w))
    return island.groupBy(*keys, "island").agg(F.min(number).alias("start"), F.max(number).alias("stop"), F.count("*").alias("n")).drop("island")


def contiguous_prefix(df: DataFrame, key: str, index: str) -> DataFrame:
    """The known length of each key: how far its indexes reach from 0 without a gap."""
    w = Window.partitionBy(key).orderBy(index)
    ranked = df.select(key, index).distinct().withColumn("rank", F.row_number().over(w) - 1)
    return ranked.groupBy(key).agg(F.sum(F.when(F.col(index) == F.col("rank"), 1).otherwise(0)).alias("length"))


def keep_recent(df: DataFrame, group: str, tick: str, size: str, budget: int, protected: Column | None = None) -> DataFrame:
    """Rows with ``kept``: protected first, then the most recent until their sizes pass the budget."""
    first = F.when(protected, 0).otherwise(1) if protected is not None else F.lit(1)
    running = F.sum(size).over(Window.partitionBy(group).orderBy(first, F.desc(tick)).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("kept", (running <= budget) | (first == 0))


def rolling(df: DataFrame, key: str, order: list[str], value: str, rows: int = 120) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumns({"last": F.last(value).over(w), "avg": F.avg(value).over(w), "min": F.min(value).over(w), "max": F.max(value).over(w)})


def final_average(df: DataFrame, key: str, order: list[str], value: str, alpha: float = 1 / 8) -> DataFrame:
    """The exponential average after each key's last row, seeded by its first.

    As a weighted sum it needs no ordered fold: a row's weight depends on how many follow.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))) - 1
    first = F.lead(value).over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))).isNull()
    weight = F.pow(F.lit(1 - alpha), back) * F.when(first, 1.0).otherwise(alpha)
    return df.withColumn("weight", weight).groupBy(key).agg(F.sum(F.col(value) * F.col("weight")).alias("ema"), F.count("*").alias("n"))


def played(tick: Column, lo: Column, hi: Column, stride: Column, loops: Column) -> Column:
    """The frame of a window that is shown after so many ticks: whole strides, a last short one onto the end, then again or no further."""
    laps = F.ceil((hi - lo) / stride) + 1
    step = F.when(loops, tick % laps).otherwise(F.least(tick, laps - 1))
    return F.when(hi <= lo, lo).otherwise(lo + F.least(step * stride, hi - lo)).cast("long")


def interleaved(plans: DataFrame, pane: str, distance: str) -> DataFrame:
    """Rows with ``turn``: every pane's nearest first, then every pane's next.

    Turns of one distance are numbered apart and shifted by the number of those before, so no task orders all rows.
    """
    counts = plans.groupBy(distance).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy(distance).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(distance, F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(distance).orderBy(pane)) - 1
    return plans.withColumn("rank", rank).join(offsets, distance).withColumn("turn", F.col("before") + F.col("rank")).drop("before", "rank")


def onto_panes(panes: DataFrame, view: str, pane: str, lists: dict[str, Column]) -> DataFrame:
    """Panes with each list's item at their place, the setting of that name where a list has none for them."""
    settings = {name: F.coalesce(F.get(values, F.col(pane)), F.col(name)) for name, values in lists.items()}
    return panes.withColumns(settings)
