"""Registered queries over the driver's tables, each with the SQL that it equals.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.functions import geometry as G
from rasterlake.functions import tokens as K
from rasterlake.functions import tone as T
from rasterlake.operators import frames as R
from rasterlake.operators import packed as P
from rasterlake.operators import stats as S
from rasterlake.operators import timeline as L
from rasterlake.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FRAMES_SQL = "f AS (SELECT label AS media_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame_idx, embedding AS samples FROM embeddings)"
PX_SQL = f"{FRAMES_SQL}, px AS (SELECT media_id, frame_idx, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y, v FROM (SELECT media_id, frame_idx, unnest(samples) AS v, generate_subscripts(samples, 1) - 1 AS pos FROM f))"
RGB_SQL = f"{FRAMES_SQL}, rgb AS (SELECT media_id, frame_idx, CAST((pos // 4) % 4 AS INTEGER) AS x, CAST(pos // 16 AS INTEGER) AS y, CAST(pos % 4 AS INTEGER) AS c, v FROM (SELECT media_id, frame_idx, unnest(samples) AS v, generate_subscripts(samples, 1) - 1 AS pos FROM f) WHERE pos % 4 < 3)"
QTY_SQL = "px AS (SELECT l_returnflag || l_linestatus AS media_id, CAST(l_quantity AS INTEGER) AS v FROM lineitem)"
PRICE_SQL = "px AS (SELECT l_linenumber AS media_id, CAST(l_extendedprice AS FLOAT) AS v FROM lineitem)"
TIMELINE_SQL = "e AS (SELECT user_id AS media_id, ts, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_idx FROM events)"
TINY = "CAST(1.1754943508222875e-38 AS FLOAT)"
MEDIA, FRAME = ["media_id"], ["media_id", "frame_idx"]


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def bin_sql(bins: int) -> str:
    return f"least({bins - 1}, CAST(trunc(CAST((v - lo) / greatest(hi - lo, {TINY}) AS FLOAT) * CAST({bins - 1} AS FLOAT)) AS INTEGER))"


def linear_sql(v: str, lo: str, hi: str, top: int = 255) -> str:
    return f"CAST(trunc(least(CAST({top} AS FLOAT), greatest(CAST(0 AS FLOAT), ({v} - {lo}) * CASE WHEN {hi} > {lo} THEN CAST(CAST({top} AS FLOAT) / ({hi} - {lo}) AS FLOAT) ELSE CAST(0 AS FLOAT) END))) AS INTEGER)"


def tails_sql(value: str, percent: float, last: int) -> str:
    """(low, high) CTEs of counts(media_id, value, n)."""
    return f"""run AS (SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY {value} ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY media_id) AS total FROM counts),
        limits AS (SELECT *, trunc(CAST(CAST(total AS FLOAT) * CAST({percent} AS FLOAT) AS FLOAT) / CAST(100 AS FLOAT)) AS low_t,
                   trunc(CAST(total AS FLOAT) * CAST(CAST(1 AS FLOAT) - CAST({percent} AS FLOAT) / CAST(100 AS FLOAT) AS FLOAT)) AS high_t FROM run),
        tails AS (SELECT media_id, coalesce(min({value}) FILTER (WHERE run > low_t), {last}) AS low, coalesce(min({value}) FILTER (WHERE run >= high_t), {last}) AS high FROM limits GROUP BY media_id)"""


# --- statistics -----------------------------------------------------------


@query(f"WITH {PX_SQL} SELECT media_id, frame_idx, min(v) AS lo, max(v) AS hi FROM px WHERE NOT isnan(v) GROUP BY ALL")
def frame_extent(spark, d):
    """No shuffle beyond the numbering of frames."""
    return P.with_extent(V.embedding_frames(spark, d)).select(*FRAME, "lo", "hi")


@query(f"WITH {PX_SQL}, b AS (SELECT media_id, frame_idx, min(v) AS lo, max(v) AS hi FROM px GROUP BY ALL) SELECT media_id, frame_idx, {bin_sql(256)} AS bin, count(*) AS n FROM px JOIN b USING (media_id, frame_idx) GROUP BY ALL")
def frame_histogram_256(spark, d):
    """A03, A17, F19. The flagship."""
    return S.binned_counts(_toned(spark, d), FRAME, 256)


@query(f"WITH {RGB_SQL}, b AS (SELECT media_id, frame_idx, min(v) AS lo, max(v) AS hi FROM rgb GROUP BY ALL) SELECT media_id, frame_idx, c, {bin_sql(256)} AS bin, count(*) AS n FROM rgb JOIN b USING (media_id, frame_idx) GROUP BY ALL")
def frame_histogram_rgb(spark, d):
    """A03 by channel on one extent, P04: alpha is no colour."""
    return S.binned_counts(V.pixels(P.with_extent(_colours(spark, d)), 4, 3), FRAME, 256, ("c",))


REGION = "x >= 2 AND x < 6 AND y >= 1 AND y < 5"
BOUNDS = P.region_bounds(2.4, 1.0, 5.2, 4.5, 8, 8)


@query(f"""WITH {PX_SQL} SELECT media_id, frame_idx, count(*) AS n, min(v) AS lo, max(v) AS hi, round(sum(CAST(v AS DOUBLE)) / count(*), 6) AS mean,
        round(sqrt(greatest(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE)) / count(*) - (sum(CAST(v AS DOUBLE)) / count(*)) * (sum(CAST(v AS DOUBLE)) / count(*)), 0)), 6) AS std FROM px WHERE {REGION} GROUP BY ALL""")
def region_stats(spark, d):
    """A02, A04, P07, F20, M05."""
    found = P.moments(P.crop(F.col("samples"), 8, *BOUNDS))
    return V.embedding_frames(spark, d).select(*FRAME, *(F.round(c, 6).alias(n) if n in ("mean", "std") else c.alias(n) for n, c in found.items()))


@query(f"WITH {PX_SQL}, r AS (SELECT * FROM px WHERE {REGION}), b AS (SELECT media_id, min(v) AS lo, max(v) AS hi FROM r GROUP BY ALL) SELECT media_id, {bin_sql(64)} AS bin, count(*) AS n FROM r JOIN b USING (media_id) GROUP BY ALL")
def region_histogram(spark, d):
    """A04 over a media."""
    return S.histogram(S.in_region(V.embedding_px(spark, d), 2.4, 1.0, 5.2, 4.5, 8, 8), MEDIA, 64)


@query(f"WITH {QTY_SQL} SELECT media_id, v, count(*) AS n FROM px GROUP BY ALL")
def int_histogram(spark, d):
    """A05, M06."""
    return S.value_counts(V.quantity_px(spark, d), MEDIA)


@query(f"WITH {PRICE_SQL}, b AS (SELECT media_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY ALL) SELECT media_id, {bin_sql(4096)} AS bin, count(*) AS n FROM px JOIN b USING (media_id) GROUP BY ALL")
def float_histogram_4096(spark, d):
    """A06."""
    return S.histogram(V.price_px(spark, d), MEDIA, S.FLOAT_BINS)


@query(f"WITH {QTY_SQL}, counts AS (SELECT media_id, v, count(*) AS n FROM px GROUP BY ALL), {tails_sql('v', 2.5, 255)} SELECT media_id, CAST(CASE WHEN high <= low THEN 0 ELSE low END AS DOUBLE) AS lo, CAST(CASE WHEN high <= low THEN 255 ELSE high END AS DOUBLE) AS hi FROM tails")
def int_percentile_bounds(spark, d):
    """Whole frames fall back to the nominal range."""
    found = S.int_percentiles(V.quantity_px(spark, d), MEDIA, 2.5, 255, (0, 255))
    return found.select("media_id", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))


@query(f"WITH {QTY_SQL}, counts AS (SELECT media_id, v, count(*) AS n FROM px WHERE v > 48 GROUP BY ALL), {tails_sql('v', 49.0, 255)} SELECT media_id, CASE WHEN high <= low THEN lo ELSE low END AS lo, CASE WHEN high <= low THEN hi ELSE high END AS hi FROM tails JOIN (SELECT media_id, min(v) AS lo, max(v) AS hi FROM counts GROUP BY media_id) USING (media_id)")
def region_percentile_bounds(spark, d):
    """A region falls back to its own extent."""
    return S.int_percentiles(V.quantity_px(spark, d).filter("v > 48"), MEDIA, 49.0, 255)


@query(f"""WITH {PRICE_SQL}, b AS (SELECT media_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY ALL), counts AS (SELECT media_id, {bin_sql(4096)} AS bin, count(*) AS n FROM px JOIN b USING (media_id) GROUP BY ALL), {tails_sql('bin', 1.0, 4095)}
        SELECT media_id, CASE WHEN high <= low THEN lo ELSE lo + CAST(CAST(low AS FLOAT) / CAST(4095 AS FLOAT) AS FLOAT) * (hi - lo) END AS p_lo, CASE WHEN high <= low THEN hi ELSE lo + CAST(CAST(high AS FLOAT) / CAST(4095 AS FLOAT) AS FLOAT) * (hi - lo) END AS p_hi FROM tails JOIN b USING (media_id)""")
def float_percentile_bounds(spark, d):
    """A08, A10, A14, W02, M03."""
    return S.float_percentiles(V.price_px(spark, d), MEDIA, 1.0)


CLIPPED_SQL = f"WITH {QTY_SQL}, counts AS (SELECT media_id, v, count(*) AS n FROM px GROUP BY ALL), {tails_sql('v', 0.01, 255)}"


@query(f"{CLIPPED_SQL} SELECT media_id, unnest([false, true]) AS clipped, CAST(unnest([0, CASE WHEN high <= low THEN 0 ELSE low END]) AS DOUBLE) AS lo, CAST(unnest([255, CASE WHEN high <= low THEN 255 ELSE high END]) AS DOUBLE) AS hi FROM tails")
def display_bounds_full(spark, d):
    """An unclipped integer frame has its type's nominal range, a clipped one the tails at 0.01 percent."""
    px = V.quantity_px(spark, d)
    top = T.nominal_max(F.lit("uint8"))
    tails = S.int_percentiles(px, MEDIA, 0.01, 255, (0, 255)).select("media_id", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    window = F.inline(F.array(F.struct(F.lit(False).alias("clipped"), F.lit(0.0).alias("lo"), top.alias("hi")), F.struct(F.lit(True).alias("clipped"), F.col("lo"), F.col("hi"))))
    return tails.select("media_id", window)


#: Cases of the bounds rule: a name, the percent to clip or none, the region or none.
BOUNDS_CASES = (("frame", None, None), ("frame_clipped", 10.0, None), ("region", None, (2.4, 1.0, 5.2, 4.5)), ("region_clipped", 10.0, (2.4, 1.0, 5.2, 4.5)), ("region_outside", None, (9.0, 9.0, 12.0, 12.0)), ("region_outside_clipped", 10.0, (-4.0, 0.0, -1.0, 8.0)))


def _bounds_sql() -> str:
    parts = []
    for name, percent, region in BOUNDS_CASES:
        inside = region and P.region_bounds(*region, 8, 8)
        where = f"WHERE x >= {inside[0]} AND y >= {inside[1]} AND x < {inside[2]} AND y < {inside[3]}" if inside else ""
        px = f"(SELECT media_id || ':' || frame_idx AS media_id, v FROM px {where})"
        extent = f"SELECT media_id, min(v) AS lo, max(v) AS hi FROM {px} GROUP BY media_id"
        if percent is None:
            parts.append(f"SELECT '{name}' AS subject, media_id AS frame, lo, hi FROM ({extent})")
        else:
            at = lambda b: f"CASE WHEN high <= low THEN {'lo' if b == 'low' else 'hi'} ELSE lo + CAST(CAST({b} AS FLOAT) / CAST(4095 AS FLOAT) AS FLOAT) * (hi - lo) END"
            parts.append(f"SELECT '{name}', media_id, {at('low')}, {at('high')} FROM (WITH b AS ({extent}), counts AS (SELECT media_id, {bin_sql(4096)} AS bin, count(*) AS n FROM {px} JOIN b USING (media_id) GROUP BY ALL), {tails_sql('bin', percent, 4095)} SELECT * FROM tails JOIN b USING (media_id))")
    return f"WITH {PX_SQL} " + " UNION ALL ".join(parts)


@query(_bounds_sql())
def frame_bounds_region(spark, d):
    """The window of a frame by region and clip; a region that covers no pixel measures the whole frame."""
    frames = V.embedding_frames(spark, d).select(F.concat("media_id", F.lit(":"), "frame_idx").alias("frame"), "samples")
    return S.bounds_by_case(frames, ["frame"], 8, 8, list(BOUNDS_CASES)).select("subject", "frame", "lo", "hi")


@query(f"WITH {QTY_SQL}, counts AS (SELECT media_id, v AS bin, count(*) AS n FROM px GROUP BY ALL) SELECT media_id, bin, n FROM counts QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY n DESC, bin DESC) = 1")
def hist_peak(spark, d):
    """Ties take the last bin."""
    return S.peak(S.value_counts(V.quantity_px(spark, d), MEDIA).withColumnRenamed("v", "bin"), MEDIA)


@query(f"WITH {QTY_SQL}, counts AS (SELECT media_id, v, count(*) AS n FROM px GROUP BY ALL) SELECT media_id, max(n) AS tallest, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY media_id")
def hist_scale(spark, d):
    """A17, A19."""
    return S.value_counts(V.quantity_px(spark, d), MEDIA).groupBy("media_id").agg(F.max("n").alias("tallest"), F.sum("n").alias("total"))


# --- reductions and arithmetic ---------------------------------------------

STACK_SQL = "stack AS (SELECT media_id, y, x, sum(CAST(v AS DOUBLE)) / count(*) AS m, sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE)) / count(*) AS q FROM px GROUP BY ALL)"


@query(f"WITH {PX_SQL}, {STACK_SQL} SELECT media_id, y, x, round(m, 5) AS mean FROM stack")
def stack_mean(spark, d):
    """A16, K18."""
    px = V.embedding_px(spark, d)
    return px.groupBy("media_id", "y", "x").agg(F.round(F.sum(F.col("v").cast("double")) / F.count("*"), 5).alias("mean"))


@query(f"WITH {PX_SQL}, {STACK_SQL} SELECT media_id, y, x, round(CAST(sqrt(greatest(q - m * m, 0)) AS DOUBLE), 5) AS std FROM stack")
def stack_std(spark, d):
    """A16, F20."""
    v = F.col("v").cast("double")
    mean = F.sum(v) / F.count("*")
    return V.embedding_px(spark, d).groupBy("media_id", "y", "x").agg(F.round(F.sqrt(F.greatest(F.sum(v * v) / F.count("*") - mean * mean, F.lit(0.0))), 5).alias("std"))


def _pair(spark, d, kind: str) -> DataFrame:
    frames = V.embedding_frames(spark, d)
    a = frames.select("media_id", "frame_idx", F.col("samples").alias("a"))
    b = frames.select("media_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("samples").alias("b"))
    return a.join(b, FRAME).select(*FRAME, F.posexplode(R.combine(F.col("a"), F.col("b"), kind)).alias("pos", "v"))


def _pair_sql(op: str) -> str:
    return f"WITH {FRAMES_SQL} SELECT a.media_id, a.frame_idx, generate_subscripts(a.samples, 1) - 1 AS pos, unnest(list_transform(list_zip(a.samples, b.samples), lambda z: z[1] {op} z[2])) AS v FROM f a JOIN f b ON a.media_id = b.media_id AND b.frame_idx = a.frame_idx + 1"


@query(_pair_sql("-"))
def frame_sub(spark, d):
    """J01, F18, K19."""
    return _pair(spark, d, "sub").withColumn("pos", F.col("pos").cast("long"))


@query(_pair_sql("+"))
def frame_add(spark, d):
    """J01, F18."""
    return _pair(spark, d, "add").withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {PX_SQL}, {STACK_SQL} SELECT media_id, frame_idx, y, x, round(CAST(v AS DOUBLE) - m, 5) + 0.0 AS v FROM px JOIN stack USING (media_id, y, x)")
def mean_then_sub(spark, d):
    """K18 then K19, J04: a still against every frame of its sequence."""
    px = V.embedding_px(spark, d)
    still = px.groupBy("media_id", "y", "x").agg((F.sum(F.col("v").cast("double")) / F.count("*")).alias("m"))
    return px.join(still, ["media_id", "y", "x"]).select("media_id", "frame_idx", "y", "x", (F.round(F.col("v").cast("double") - F.col("m"), 5) + 0.0).alias("v"))


@query(f"WITH {FRAMES_SQL} SELECT media_id, frame_idx, CAST(list_sum(list_transform(samples, lambda v: CASE WHEN v > 0.2 THEN 1 ELSE 0 END)) AS BIGINT) AS over, CAST(len(samples) * 4 AS BIGINT) AS bytes FROM f")
def frame_bytes(spark, d):
    """P02, P18, A24."""
    over = F.size(F.filter("samples", lambda v: v > F.lit(0.2)))
    return V.embedding_frames(spark, d).select(*FRAME, over.cast("long").alias("over"), (F.size("samples") * 4).cast("long").alias("bytes"))


@query(f"WITH {FRAMES_SQL}, s AS (SELECT media_id, frame_idx, CAST(3 + frame_idx % 2 * 0 + CASE WHEN frame_idx % 5 = 4 THEN 1 ELSE 0 END AS INTEGER) AS w FROM f) SELECT media_id, count(*) AS used FROM s JOIN (SELECT media_id, w FROM s WHERE frame_idx = 0) USING (media_id, w) GROUP BY media_id")
def stack_same_shape(spark, d):
    """A16's shape rule: frames unlike the first are skipped."""
    odd = F.when(F.col("frame_idx") % 5 == 4, 4).otherwise(3).cast("int")
    return R.same_shape(V.embedding_frames(spark, d).withColumn("w", odd), MEDIA).groupBy("media_id").agg(F.count("*").alias("used"))


# --- timeline ---------------------------------------------------------------

COUNTS_SQL = f"{TIMELINE_SQL}, m AS (SELECT media_id, count(*) AS n FROM e GROUP BY media_id), longest AS (SELECT max(n) AS longest FROM m)"


def _media(spark, d, synced: bool) -> DataFrame:
    counts = V.table(spark, d, "events").groupBy(F.col("user_id").alias("media_id")).agg(F.count("*").alias("count"))
    return counts.withColumns({"synced": F.lit(synced), "own": F.col("media_id") * 7})


@query(f"WITH {COUNTS_SQL} SELECT media_id, frame_idx AS start, CASE WHEN frame_idx < n - 1 THEN frame_idx ELSE (SELECT longest FROM longest) - 1 END AS stop, frame_idx FROM e JOIN m USING (media_id)")
def synced_timeline(spark, d):
    """The positions at which each frame is shown; short media hold their last frame."""
    return L.spans(_media(spark, d, True), V.event_timeline(spark, d).select("media_id", "frame_idx"))


@query(f"WITH {COUNTS_SQL} SELECT media_id, CAST(0 AS BIGINT) AS start, (SELECT longest FROM longest) - 1 AS stop, frame_idx FROM e JOIN m USING (media_id) WHERE frame_idx = (media_id * 7) % n")
def unsynced_timeline(spark, d):
    """J02 for media with a place of their own."""
    return L.spans(_media(spark, d, False), V.event_timeline(spark, d).select("media_id", "frame_idx"))


@query(f"WITH {TIMELINE_SQL} SELECT o.media_id, o.frame_idx, coalesce(c.lo, o.lo) AS lo, coalesce(c.hi, o.hi) AS hi FROM (SELECT *, least(value, 50) AS lo, greatest(value, 50) AS hi FROM e) o LEFT JOIN (SELECT *, least(value, 50) AS lo, greatest(value, 50) AS hi FROM e WHERE media_id = 1) c ON c.frame_idx = o.frame_idx")
def tone_map_shared_clip(spark, d):
    """Panes that share the clip take the control's window at their position, or their own past its end."""
    windows = V.event_timeline(spark, d).select("media_id", "frame_idx", F.least("value", F.lit(50.0)).alias("lo"), F.greatest("value", F.lit(50.0)).alias("hi"))
    control = windows.filter("media_id = 1").select("frame_idx", F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"))
    return windows.join(control, "frame_idx", "left").select("media_id", "frame_idx", F.coalesce("c_lo", "lo").alias("lo"), F.coalesce("c_hi", "hi").alias("hi"))


@query(f"WITH {TIMELINE_SQL} SELECT media_id, frame_idx, event_id FROM e WHERE frame_idx BETWEEN 5 AND 12")
def loop_window(spark, d):
    """O10, O12."""
    return V.event_timeline(spark, d).filter("frame_idx BETWEEN 5 AND 12").select("media_id", "frame_idx", "event_id")


@query(f"WITH {TIMELINE_SQL} SELECT media_id, frame_idx, event_id FROM e WHERE frame_idx % 3 = 0")
def stride_frames(spark, d):
    """O11."""
    return V.event_timeline(spark, d).filter("frame_idx % 3 = 0").select("media_id", "frame_idx", "event_id")


@query("SELECT min(n) FILTER (WHERE media_id % 3 = 0) AS playback_limit, max(n) AS timeline_len, bool_and(n > 20) AS at_end FROM (SELECT user_id AS media_id, count(*) AS n FROM events GROUP BY 1)")
def playback_limit(spark, d):
    """The shortest of the media still being discovered."""
    n = V.table(spark, d, "events").groupBy(F.col("user_id").alias("media_id")).agg(F.count("*").alias("n"))
    return n.agg(F.min(F.when(F.col("media_id") % 3 == 0, F.col("n"))).alias("playback_limit"), F.max("n").alias("timeline_len"), F.bool_and(F.col("n") > 20).alias("at_end"))


@query(f"WITH {TIMELINE_SQL}, n AS (SELECT media_id, count(*) AS n FROM e GROUP BY media_id) SELECT media_id, frame_idx, CASE WHEN frame_idx + 1 > least(n - 1, 9) OR frame_idx + 1 < 2 THEN 2 ELSE frame_idx + 1 END AS following FROM e JOIN n USING (media_id)")
def frame_step(spark, d):
    """The next frame inside a loop window, wrapping."""
    e = V.event_timeline(spark, d)
    last = F.least(F.count("*").over(Window.partitionBy("media_id")) - 1, F.lit(9))
    step = F.col("frame_idx") + 1
    return e.select(*FRAME, F.when((step > last) | (step < 2), 2).otherwise(step).alias("following"))


# --- regions, lines, decimation ---------------------------------------------


@query(f"WITH {PX_SQL} SELECT media_id, frame_idx, x - 1 AS x, y - 2 AS y, v FROM px WHERE x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 4")
def crop_region(spark, d):
    """P06."""
    cut = P.crop(F.col("samples"), 8, 1, 2, 5, 5)
    return V.pixels(V.embedding_frames(spark, d).withColumn("samples", cut), 4).select(*FRAME, "x", "y", "v")


@query(f"WITH {PX_SQL} SELECT media_id, frame_idx, x // 3 AS x, y // 3 AS y, v FROM px WHERE x % 3 = 0 AND y % 3 = 0")
def decimate_step(spark, d):
    """P08, P09."""
    return V.pixels(V.embedding_frames(spark, d).withColumn("samples", P.decimate(F.col("samples"), 8, 3)), 3).select(*FRAME, "x", "y", "v")


LINE = (0.5, 0.5, 9.2, 7.8)


def _line(spark, d) -> DataFrame:
    return V.embedding_frames(spark, d).select(*FRAME, F.inline(P.line(F.col("samples"), 8, 8, LINE)))


LINE_SQL = ", ".join(f"({k}, {x}, {y})" for k, x, y in R.line_points(*LINE))


@query(f"WITH {PX_SQL}, line(k, lx, ly) AS (VALUES {LINE_SQL}) SELECT f.media_id, f.frame_idx, k, lx AS x, ly AS y, coalesce(v, CAST('nan' AS FLOAT)) AS v FROM f CROSS JOIN line LEFT JOIN px ON px.media_id = f.media_id AND px.frame_idx = f.frame_idx AND px.x = lx AND px.y = ly")
def line_profile(spark, d):
    """P10, J10."""
    return _line(spark, d)


@query(f"WITH {PX_SQL}, line(k, lx, ly) AS (VALUES {LINE_SQL}) SELECT f.media_id, min(v) AS lo, CASE WHEN max(v) > min(v) THEN max(v) ELSE min(v) + 1 END AS hi FROM f CROSS JOIN line JOIN px ON px.media_id = f.media_id AND px.frame_idx = f.frame_idx AND px.x = lx AND px.y = ly GROUP BY f.media_id")
def profile_range(spark, d):
    """A20."""
    v = _line(spark, d).filter(~F.isnan("v"))
    lo, hi = F.min("v"), F.max("v")
    return v.groupBy("media_id").agg(lo.alias("lo"), F.when(hi > lo, hi).otherwise(lo + F.lit(1).cast("float")).alias("hi"))


@query(f"WITH {TIMELINE_SQL}, k AS (SELECT media_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY media_id ORDER BY frame_idx) AS island FROM e WHERE value < 60) SELECT media_id, min(frame_idx) AS start, max(frame_idx) AS stop, count(*) AS n FROM k GROUP BY media_id, island HAVING count(*) >= 2")
def line_profile_segments(spark, d):
    """Curve pieces of at least two points between gaps."""
    return L.runs(V.event_timeline(spark, d).filter("value < 60"), MEDIA, "frame_idx").filter("n >= 2")


@query(f"WITH {RGB_SQL} SELECT media_id, frame_idx, round(sum(CAST(v AS DOUBLE)) / 3, 5) AS intensity FROM rgb WHERE x = 2 AND y = 1 GROUP BY ALL")
def intensity_at(spark, d):
    """P01, P03, P05."""
    total = sum((P.at(F.col("samples"), 4, 2, 1, 4, c).cast("double") for c in range(1, 3)), P.at(F.col("samples"), 4, 2, 1, 4).cast("double"))
    return V.embedding_rgba_frames(spark, d).select(*FRAME, F.round(total / 3, 5).alias("intensity"))


@query(f"WITH {PX_SQL} SELECT media_id, frame_idx, printf('%.4f', CAST(v AS DOUBLE)) AS readout FROM px WHERE x = 3 AND y = 3")
def pixel_readout(spark, d):
    """T20, K25."""
    return V.embedding_frames(spark, d).select(*FRAME, K.readout(P.at(F.col("samples"), 8, 3, 3), True).alias("readout"))


@query(f"WITH {PX_SQL} SELECT media_id, frame_idx, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE v > 0.25 GROUP BY ALL")
def content_bbox(spark, d):
    """A21, P20."""
    box = P.bounding_box(F.col("samples"), 8, lambda v: v > 0.25)
    return V.embedding_frames(spark, d).select(*FRAME, *(c.alias(n) for n, c in box.items())).filter("x0 IS NOT NULL")


@query(f"WITH {PX_SQL} SELECT media_id, y, x, frame_idx AS nearest FROM px QUALIFY row_number() OVER (PARTITION BY media_id, y, x ORDER BY abs(CAST(v AS DOUBLE) - 0.1::DOUBLE), frame_idx) = 1")
def nearest_sample(spark, d):
    """The sample nearest to a value, the lower index first."""
    distance = F.struct(F.abs(F.col("v").cast("double") - F.lit(0.1)), "frame_idx")
    return V.embedding_px(spark, d).groupBy("media_id", "y", "x").agg(F.min_by("frame_idx", distance).alias("nearest"))


# --- tone, palettes, overlays -----------------------------------------------

BOUNDS_SQL = "b AS (SELECT media_id, frame_idx, min(v) AS lo, max(v) AS hi FROM px GROUP BY ALL), t AS (SELECT * FROM px JOIN b USING (media_id, frame_idx))"


def _toned(spark, d) -> DataFrame:
    """Pixels with their frame's extent, which is measured before the frame is taken apart."""
    return V.pixels(P.with_extent(V.embedding_frames(spark, d)), 8)


def _colours(spark, d) -> DataFrame:
    return V.embedding_rgba_frames(spark, d).withColumn("samples", P.drop_alpha(F.col("samples")))


@query(f"WITH {PX_SQL}, {BOUNDS_SQL} SELECT media_id, frame_idx, x, y, {linear_sql('v', 'lo', 'hi')} AS g FROM t")
def tone_map_u8(spark, d):
    """F01, F03, F06, F09, U06, M08."""
    return _toned(spark, d).select(*FRAME, "x", "y", T.linear(F.col("v"), F.col("lo"), F.col("hi")).alias("g"))


@query(f"WITH {PX_SQL}, {BOUNDS_SQL} SELECT media_id, frame_idx, x, y, {linear_sql('v', 'lo', 'hi', 65535)} AS g, {linear_sql('v', 'lo', 'hi', 65535)} >> 8 AS g8 FROM t")
def tone_map_u16(spark, d):
    """F02, F04, F08, F48."""
    g = T.linear(F.col("v"), F.col("lo"), F.col("hi"), 65535)
    return _toned(spark, d).select(*FRAME, "x", "y", g.alias("g"), F.shiftright(g, 8).alias("g8"))


def _colormap(name: str) -> None:
    colours = ", ".join(str(r << 16 | g << 8 | b) for r, g, b in T.palette(name))
    sql = f"WITH {PX_SQL}, {BOUNDS_SQL} SELECT media_id, frame_idx, x, y, list_extract([{colours}], {linear_sql('v', 'lo', 'hi')} + 1) AS rgb FROM t"

    def run(spark, d):
        index = T.linear(F.col("v"), F.col("lo"), F.col("hi"))
        return _toned(spark, d).select(*FRAME, "x", "y", T.palette_column(name, index).alias("rgb"))

    run.__name__ = f"colormap_{name}"
    run.__doc__ = "F05, F07, F17, J09."
    query(sql)(run)


for _name in ("viridis", "turbo", "diverging"):
    _colormap(_name)


@query(f"WITH {PX_SQL} SELECT media_id, frame_idx, x, y, CASE WHEN v > 0 THEN 10 ELSE 0 END AS r, CASE WHEN v > 0 THEN 128 ELSE 0 END AS a, CASE WHEN v > 0 THEN 255 ELSE 0 END AS g FROM px")
def mask_overlay(spark, d):
    """F11, F03's mask rule, P16: a mask ignores the window."""
    on = F.when(F.col("v") > 0, 1).otherwise(0)
    return V.embedding_px(spark, d).select(*FRAME, "x", "y", (on * 10).alias("r"), (on * 128).alias("a"), T.masked(on).alias("g"))


@query(f"WITH {PX_SQL}, {BOUNDS_SQL} SELECT media_id, frame_idx, x, y, CAST(round(CAST(CAST((v - lo) / greatest(hi - lo, {TINY}) AS FLOAT) * CAST(trunc(least(1, greatest(0, (frame_idx % 15 - 2) / 10.0::DOUBLE)) * 255) AS FLOAT) AS DOUBLE)) AS INTEGER) AS a FROM t")
def intensity_overlay(spark, d):
    """The frame's own opacity, clamped, times how far the sample is up the range."""
    alpha = T.opacity((F.col("frame_idx") % 15 - 2) / 10.0)
    return _toned(spark, d).select(*FRAME, "x", "y", T.intensity_alpha(F.col("v"), F.col("lo"), F.col("hi"), alpha).alias("a"))


STORED_SQL = f"{RGB_SQL}, s AS (SELECT media_id, frame_idx, x, y, c, CAST(round(CAST(v AS DOUBLE) * 4) + 0.0 AS FLOAT) AS v FROM rgb), b AS (SELECT media_id, frame_idx, min(v) AS lo, max(v) AS hi FROM s GROUP BY ALL), p AS (SELECT media_id, frame_idx, x, y, max(v) FILTER (WHERE c = 0) AS r, max(v) FILTER (WHERE c = 1) AS g, max(v) FILTER (WHERE c = 2) AS b FROM s GROUP BY ALL)"


@query(f"WITH {STORED_SQL} SELECT media_id, frame_idx, x, y, {', '.join(f'CASE WHEN r = 0 AND g = 0 AND b = 0 THEN 0 ELSE {linear_sql(f"p.{c}", "lo", "hi")} END AS {c}' for c in 'rgb')}, CASE WHEN r = 0 AND g = 0 AND b = 0 THEN 0 ELSE 200 END AS a FROM p JOIN (SELECT media_id, frame_idx, lo, hi FROM b) USING (media_id, frame_idx)")
def color_overlay(spark, d):
    """A colour source as its window shows it; stored black, not what the window makes black, is clear."""
    stored = F.transform(P.drop_alpha(F.col("samples")), lambda v: (F.round(v.cast("double") * 4) + 0.0).cast("float"))
    frames = P.with_extent(V.embedding_rgba_frames(spark, d).withColumn("samples", stored))
    pixel = F.inline(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.struct((k % 4).alias("x"), F.floor(k / 4).cast("int").alias("y"), *(F.get("samples", k * 3 + c).alias(f"s{c}") for c in range(3)))))
    p = frames.select(*FRAME, "lo", "hi", pixel)
    clear = (F.col("s0") == 0) & (F.col("s1") == 0) & (F.col("s2") == 0)
    return p.select(*FRAME, "x", "y", *(F.when(clear, 0).otherwise(T.linear(F.col(f"s{k}"), F.col("lo"), F.col("hi"))).alias(n) for k, n in enumerate("rgb")), F.when(clear, 0).otherwise(200).alias("a"))


@query(f"WITH {PX_SQL}, {BOUNDS_SQL}, g AS (SELECT media_id, frame_idx, x, y, {linear_sql('v', 'lo', 'hi')} AS g FROM t) SELECT a.media_id, a.frame_idx, a.x, a.y, CAST(floor(a.g * (1 - 90 / 255.0::DOUBLE) + coalesce(b.g, a.g) * (90 / 255.0::DOUBLE) + 0.5) AS INTEGER) AS g FROM g a LEFT JOIN g b ON b.media_id = a.media_id AND b.frame_idx = a.frame_idx + 1 AND a.x = b.x AND a.y = b.y")
def overlay_blend(spark, d):
    """The next frame over each frame; packed frames meet, not their pixels."""
    frames = P.with_extent(V.embedding_frames(spark, d)).select(*FRAME, F.struct("samples", "lo", "hi").alias("base"))
    over = frames.select("media_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("base").alias("over"))
    both = frames.join(over, FRAME, "left").select(*FRAME, "base.lo", "base.hi", F.col("over.lo").alias("over_lo"), F.col("over.hi").alias("over_hi"), F.arrays_zip(F.col("base.samples"), F.coalesce("over.samples", "base.samples").alias("over")).alias("samples"))
    px = V.pixels(both, 8)
    g = T.linear(F.col("v.samples"), F.col("lo"), F.col("hi"))
    top = T.linear(F.col("v.over"), F.coalesce("over_lo", "lo"), F.coalesce("over_hi", "hi"))
    return px.select(*FRAME, "x", "y", T.blend(g, top, F.lit(90)).alias("g"))


@query(f"WITH {QTY_SQL}, b AS (SELECT media_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY ALL) SELECT DISTINCT media_id, v, CASE WHEN hi > lo THEN CAST(floor((v - lo) * 65535.0::DOUBLE / (hi - lo)) AS BIGINT) ELSE v END AS stretched FROM px JOIN b USING (media_id)")
def lut_alpha_stretch(spark, d):
    """Minimum and maximum to the 16-bit range; a flat image stays."""
    px = V.quantity_px(spark, d).distinct()
    b = px.groupBy("media_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    stretched = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) * F.lit(65535.0) / (F.col("hi") - F.col("lo")))).otherwise(F.col("v")).cast("long")
    return px.join(b, "media_id").select("media_id", "v", stretched.alias("stretched"))
