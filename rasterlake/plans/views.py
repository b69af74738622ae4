"""Frame and pixel views over tables with array or numeric sample columns.

``frames`` are packed, one row per frame; ``px`` is the long form, one row per
sample. Which embedding is which frame of which media is this module's choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a media that one task may number; the parts of a larger one.
SPLIT_ROWS, PARTS = 4_000_000, 256


def numbered(df: DataFrame, media: str, *order: str, name: str = "frame_idx", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Dense 0-based positions within each media.

    No media of a table of at most ``split_rows`` rows (a count of file footers) is too large for
    one task. In a larger table, those with more rows are cut at quantiles of the first order
    column, every part is numbered on its own, and the rows of the parts before it are added.
    """

    def place(*by: str) -> Column:
        return (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long")

    if df.select(media).count() <= split_rows:
        return df.withColumn(name, place(media))
    keys = df.select(media, F.col(order[0]).alias("_at"))
    large = keys.groupBy(media).count().filter(F.col("count") > split_rows).select(media)
    cuts = keys.join(large, media).groupBy(media).agg(F.percentile_approx("_at", [k / PARTS for k in range(1, PARTS)]).alias("_cuts"))
    part = lambda at: F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(at))))
    sizes = keys.join(cuts, media).groupBy(media, part("_at").alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(media).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(media, "_part", before.alias("_before"))
    parted = df.join(cuts, media, "left").withColumn("_part", part(order[0])).drop("_cuts")
    placed = parted.withColumn(name, place(media, "_part")).join(offsets, [media, "_part"], "left")
    return placed.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).select(*df.columns, name)


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label is a media, its vectors in id order are 8 x 8 mono float frames."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").alias("media_id"), "vec_id", F.col("embedding").alias("samples"))
    return numbered(vectors, "media_id", "vec_id").select("media_id", "frame_idx", F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(1).alias("channels"), "samples")


def pixels(frames: DataFrame, w: int, channels: int = 1) -> DataFrame:
    """The long form of packed row-major frames with interleaved channels."""
    keys = [c for c in frames.columns if c not in ("samples", "w", "h", "channels")]
    flat = frames.select(*keys, F.posexplode("samples").alias("pos", "v"))
    pixel = F.expr(f"pos div {channels}")
    return flat.select(*keys, (pixel % w).cast("int").alias("x"), F.floor(pixel / w).cast("int").alias("y"), (F.col("pos") % channels).alias("c"), "v")


def embedding_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(embedding_frames(spark, sf_dir), 8)


def embedding_rgba_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors as 4 x 4 frames of red, green, blue and alpha."""
    return embedding_frames(spark, sf_dir).withColumns({"w": F.lit(4), "h": F.lit(4), "channels": F.lit(4)})


def quantity_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flag and line status name a media of uint8 values, the quantities."""
    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("media_id"), F.col("l_quantity").cast("int").alias("v"))


def price_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("media_id"), F.col("l_extendedprice").cast("float").alias("v"))


def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a media whose events in time order are its frames."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), "ts", "event_id", "value")
    return numbered(events, "media_id", "ts", "event_id")


def f32(c: Column) -> Column:
    """Round to single precision; a quotient of floats is a double in Spark."""
    return c.cast("float")
