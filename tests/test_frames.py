"""Golden cases of statistics, reductions, timelines, tone and geometry."""

import math

import pytest
from pyspark.sql import functions as F

from rasterlake import queries
from rasterlake.functions import geometry as G
from rasterlake.functions import tokens as K
from rasterlake.functions import tone as T
from rasterlake.operators import frames as R
from rasterlake.operators import layout as Y
from rasterlake.operators import packed as P
from rasterlake.operators import stats as S
from rasterlake.operators import timeline as L
from rasterlake.plans import views as V

NAN, INF = float("nan"), float("inf")


def px(spark, values, w, media="m", frame=0):
    return spark.createDataFrame([(media, frame, k % w, k // w, float(v)) for k, v in enumerate(values)], "media_id string, frame_idx int, x int, y int, v float")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_region_stats(spark):
    frame = px(spark, [255, 10, 20], 3)
    r = S.region_stats(S.in_region(frame, 1, 0, 3, 1, 3, 1), ["media_id"]).first()
    assert (r.n, r.lo, r.hi, r["mean"], r.std) == (2, 10, 20, 15, 5)
    assert S.region_stats(S.in_region(frame, 5, 5, 9, 9, 3, 1), ["media_id"]).count() == 0


def test_region_mean_counts_nan_pixels(spark):
    r = S.region_stats(px(spark, [NAN, 4, 8, 0], 4), ["media_id"]).first()
    assert (r.n, r["mean"], r.lo, r.hi) == (4, 3, 0, 8)


def test_extent_of_odd_frames(spark):
    extent = lambda values: tuple(S.extent(px(spark, values, 2), ["media_id"]).select("lo", "hi").first())
    assert extent([NAN, NAN]) == (0, 1) and extent([NAN, 3]) == (3, 3) and extent([-INF, INF]) == (-INF, INF)


def test_only_the_maximum_reaches_the_last_bin(spark):
    bins = {r.bin: r.n for r in S.histogram(px(spark, [0, 1, 2, 3, 3.99, 4], 6), ["media_id"], 5).collect()}
    assert bins == {0: 1, 1: 1, 2: 1, 3: 2, 4: 1}
    assert {r.bin for r in S.histogram(px(spark, [7, 7, NAN], 3), ["media_id"], 5).collect()} == {0}


def test_percentiles(spark):
    frame = px(spark, [0, 10, 20, 30], 4)
    ints = frame.withColumn("v", F.col("v").cast("int"))
    found = S.int_percentiles(ints, ["media_id"], 25.0, 255, (0, 255)).first()
    assert (found.lo, found.hi) == (10, 20)
    found = S.float_percentiles(frame, ["media_id"], 25.0).first()
    assert abs(found.p_lo - 10) < 0.01 and abs(found.p_hi - 20) < 0.01
    flat = px(spark, [3] * 16, 4).withColumn("v", F.col("v").cast("int"))
    assert tuple(S.int_percentiles(flat, ["media_id"], 1.0, 65535, (0, 65535)).select("lo", "hi").first()) == (0, 65535)
    assert tuple(S.int_percentiles(flat, ["media_id"], 1.0, 65535).select("lo", "hi").first()) == (3, 3)


def test_peak_ties_take_the_last_bin(spark):
    counts = spark.createDataFrame([("m", 2, 5), ("m", 7, 5), ("m", 9, 1)], "media_id string, bin int, n long")
    assert S.peak(counts, ["media_id"]).first().bin == 7


def test_stack_and_arithmetic(spark):
    both = px(spark, [0, 10], 2).union(px(spark, [4, 20], 2, frame=1))
    got = R.stack(both, ["media_id"], ["y", "x"]).orderBy("x").collect()
    assert [(r["mean"], r.std) for r in got] == [(2, 2), (15, 5)]
    pair = spark.createDataFrame([([0.0, 10.0], [4.0, 20.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in pair.select(R.combine(F.col("a"), F.col("b"), "sub")).collect()] == [[-4, -10], None]
    assert pair.select(R.combine(F.col("a"), F.col("b"), "add")).first()[0] == [4, 30]


def test_results_hold_for_any_partitioning(spark):
    values = [(k * 7919 + (k % 3) * 13) % 65536 for k in range(4096)]
    frame = px(spark, values, 64)
    want = sorted(S.histogram(frame, ["media_id"], 256).collect())
    assert sum(r.n for r in want) == 4096
    for n in (1, 7):
        assert sorted(S.histogram(frame.repartition(n), ["media_id"], 256).collect()) == want


def test_shown_frames(spark):
    cases = [(3, 10, True, 0, 3), (30, 10, True, 0, 9), (7, 1, True, 0, 0), (7, 10, False, 4, 4), (7, 0, True, 0, 0), (7, 0, False, 3, 0)]
    for t, n, synced, own, want in cases:
        assert one(spark, L.shown(F.lit(t), F.lit(n), F.lit(synced), F.lit(own)))[0] == want


def test_crop_and_decimation_commute_with_tone(spark):
    frame = px(spark, range(12), 4)
    assert [r.v for r in R.crop(frame, 1, 1, 2, 2).orderBy("y", "x").collect()] == [5, 6, 9, 10]
    assert [r.v for r in R.crop(frame, 3, 2, 10, 10).collect()] == [11]
    wide = px(spark, range(0, 80, 10), 4)
    assert [r.v for r in R.decimate(wide, 2).orderBy("y", "x").collect()] == [0, 20]
    assert [r.v for r in R.decimate(wide, 3).orderBy("y", "x").collect()] == [0, 30]
    toned = lambda d: d.withColumn("v", T.linear(F.col("v"), F.lit(2.0), F.lit(9.0)).cast("float"))
    assert R.crop(toned(frame), 1, 0, 2, 3).collect() == toned(R.crop(frame, 1, 0, 2, 3)).collect()


def test_line_profile_leaves_the_frame(spark):
    got = R.line_profile(px(spark, range(9), 3), ["media_id", "frame_idx"], (0.0, 0.0, 4.0, 0.0)).orderBy("k").collect()
    assert [r.v for r in got[:3]] == [0, 1, 2] and all(math.isnan(r.v) for r in got[3:]) and len(got) == 5
    assert len(R.line_points(0, 0, 0, 0)) == 2 and len(R.line_points(0, 0, 9999, 0)) == 4096


def test_linear_window(spark):
    lin = lambda v, lo, hi, top=255: one(spark, T.linear(F.lit(v), F.lit(lo), F.lit(hi), top))[0]
    assert [lin(v, 0.0, 255.0) for v in (0.0, 128.0, 255.0, 300.0, -4.0, 127.9)] == [0, 128, 255, 255, 0, 127]
    assert lin(NAN, 0.0, 1.0) == 0 and lin(5.0, 3.0, 3.0) == 0 and lin(1.0, 0.0, 1.0, 65535) == 65535 and lin(INF, 0.0, 1.0) == 255


def test_palettes():
    for name, anchors in T.ANCHORS.items():
        table = T.palette(name)
        assert len(table) == 256 and table[0] == anchors[0][1:] and table[255] == anchors[-1][1:]
    assert min(T.palette("BWR ")[128]) > 220 and T.palette("diff") == T.palette("diverging")


def test_overlays(spark):
    alpha = [one(spark, T.intensity_alpha(F.lit(v), F.lit(0.0), F.lit(255.0), 200))[0] for v in (0.0, 128.0, 255.0)]
    assert alpha == [0, 100, 200]
    assert [one(spark, T.blend(F.lit(b), F.lit(o), F.lit(a)))[0] for b, o, a in ((10, 20, 255), (10, 20, 0), (0, 255, 128))] == [20, 10, 128]
    assert [one(spark, T.opacity(F.lit(o)))[0] for o in (-1.0, 0.5, 2.0)] == [0, 127, 255]


def test_tokens(spark):
    names = one(spark, K.expand(F.lit("frame_%05u.tif,0,12")))[0]
    assert len(names) == 13 and names[0] == "frame_00000.tif" and names[12] == "frame_00012.tif"
    assert one(spark, K.expand(F.lit("f%01u.png,9,11")))[0] == ["f9.png", "f10.png", "f11.png"]
    assert one(spark, K.expand(F.lit("f%02u.png,5,4")))[0] == [] and one(spark, K.expand(F.lit("plain.png")))[0] == []
    assert tuple(one(spark, *K.split_name(F.lit("frame_00012.tif")).values())) == ("frame_", 12, 5, ".tif")
    assert tuple(one(spark, *K.split_name(F.lit("solo.png")).values())) == (None,) * 4
    parsed = lambda t: tuple(one(spark, *K.compute_token(F.lit(t)).values()))
    assert parsed("compute:diff:0,1:auto") == ("sub", 0, 1) and parsed("compute:mean:0") == ("mean", 0, None)
    assert parsed("compute:add:1,0") == ("add", 1, 0) and parsed("compute:bogus:0") == (None, None, None) and parsed("compute:sub:1") == (None, None, None)
    assert abs(one(spark, K.rate(F.lit("30000/1001")))[0] - 29.97) < 0.01 and one(spark, K.rate(F.lit("0/0")))[0] is None


def test_runs(spark):
    df = spark.createDataFrame([("a", n) for n in (3, 1, 2, 2, 7, 9, 10)], "k string, n long")
    assert sorted((r.start, r.stop, r.n) for r in L.runs(df, ["k"], "n").collect()) == [(1, 3, 3), (7, 7, 1), (9, 10, 2)]


def test_contiguous_prefix(spark):
    df = spark.createDataFrame([("a", i) for i in (7, 6, 5, 4, 0)] + [("b", i) for i in (0, 1, 2, 4)] + [("c", 3)], "k string, i int")
    assert {r.k: r.length for r in L.contiguous_prefix(df, "k", "i").collect()} == {"a": 1, "b": 3, "c": 0}


def test_frame_map(spark):
    files = spark.createDataFrame([("m", 0, 4), ("m", 1, 0), ("m", 2, 3)], "media_id string, file_idx int, pages int")
    got = {r.frame_idx: (r.file_idx, r.page) for r in Y.frame_map(files, "media_id", "file_idx", "pages").collect()}
    assert len(got) == 7 and got[3] == (0, 3) and got[4] == (2, 0) and got[6] == (2, 2)


def test_keep_recent(spark):
    df = spark.createDataFrame([("p", t, 10) for t in range(1, 5)], "p string, tick int, size int")
    kept = lambda budget, keep=None: sorted(r.tick for r in L.keep_recent(df, "p", "tick", "size", budget, keep).filter("kept").collect())
    assert kept(20) == [3, 4] and kept(20, F.col("tick") == 1) == [1, 4] and kept(0) == []


def test_ema_equals_the_fold(spark):
    values = [40.0, 2.0, 9.0, 9.0, 1.5]
    got = L.final_average(spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i int, v double"), "k", ["i"], "v").first()
    ema = values[0]
    for v in values[1:]:
        ema += (v - ema) / 8
    assert abs(got.ema - ema) < 1e-12


def test_levels_and_sizes(spark):
    level = lambda w, h, b: one(spark, G.resolution_level(F.lit(w), F.lit(h), F.lit(b)))[0]
    assert [level(25000, 25000, 32_000_000), level(4096, 4096, 32_000_000), level(99, 99, 0), level(4096, 4096, 1)] == [3, 0, 0, 8]
    depth = lambda s, panes: one(spark, G.prefetch_depth(F.lit(s), F.lit(panes), F.lit(2), F.lit(30.0)))[0]
    assert depth(0.002, 1) == 3 and depth(0.04, 4) > 3 and depth(5.0, 9) == 8
    assert [one(spark, G.watch_interval(F.lit(n)))[0] for n in (0, 4, 16, 100_000)] == [0.2, 0.2, 0.8, 2.0]
    assert [one(spark, G.wrap_angle(F.lit(a)))[0] for a in (180.0, -180.0, 190.0, -190.0, 725.0)] == [180, 180, -170, 170, 5]


def test_raw_reason(spark):
    fine = {"depths": [16], "spp": 1, "sample_format": 1, "compression": 1, "predictor": 1, "planar": 1, "photometric": 1, "tiled": False, "strip_counts": [8], "w": 2, "h": 2}
    column = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    reason = lambda **k: one(spark, Y.raw_reason({n: column(v) for n, v in (fine | k).items()}))[0]
    assert reason() is None and reason(depths=[32], sample_format=3, strip_counts=[8, 8]) is None
    assert reason(depths=[8, 8, 8], spp=3, photometric=2, strip_counts=[12]) is None
    broken = [{"tiled": True}, {"compression": 5}, {"predictor": 2}, {"planar": 2}, {"depths": [8, 16]}, {"photometric": 0}, {"spp": 2}, {"sample_format": 2}, {"depths": [1]}, {"strip_counts": [9]}]
    assert [reason(**k) for k in broken] == ["stored in tiles", "compressed", "differenced by a predictor", "channels stored apart", "channels of several depths", "colours of another kind", "no such number of channels", "no such sample type", "no such sample type", "strips hold other than the pixels"]


def test_numbering_in_parts(spark):
    rows = spark.createDataFrame([(1 if k % 3 else 2, k * 37 % 1000 // 2, k) for k in range(1000)] + [(3, 5, 5), (4, None, 7)], "m int, at int, id int")
    want = {tuple(r) for r in V.numbered(rows, "m", "at", "id").collect()}
    for most in (0, 10, 400, 5000):
        assert {tuple(r) for r in V.numbered(rows, "m", "at", "id", split_rows=most).collect()} == want


def test_packed_frames(spark):
    frame = spark.createDataFrame([([float(k) for k in range(12)], [NAN, 2.0, -1.0, NAN]), ([NAN] * 12, [INF, -INF, 0.0, 0.0])], "samples array<float>, odd array<float>")
    cut, small = P.crop(F.col("samples"), 4, 1, 1, 3, 3), P.decimate(F.col("samples"), 4, 2)
    assert frame.select(cut, small).first() == ([5, 6, 9, 10], [0, 2, 8, 10])
    assert [tuple(r) for r in frame.select(*P.extent(F.col("odd")), *P.extent(F.col("samples"), 9.0)).collect()] == [(-1, 2, 0, 11), (-INF, INF, 0, 9)]
    assert P.region_bounds(2.4, 1.0, 5.2, 4.5, 8, 8) == (2, 1, 6, 5) and P.region_bounds(9, 9, 12, 12, 8, 8) is None and P.region_bounds(3, 3, 3, 5, 8, 8) is None
    moments = frame.select(*(c.alias(n) for n, c in P.moments(F.col("odd")).items())).first()
    assert (moments.n, moments.lo, moments.hi, moments["mean"]) == (4, -1, 2, 0.25)
    box = frame.select(*(c.alias(n) for n, c in P.bounding_box(F.col("samples"), 4, lambda v: (v > 4) & (v < 11)).items())).collect()
    assert tuple(box[0]) == (0, 1, 3, 2) and tuple(box[1]) == (None,) * 4
    line = frame.select(P.line(F.col("samples"), 4, 3, (0.0, 0.0, 6.0, 0.0)).alias("l")).first().l
    assert [p.v for p in line[:4]] == [0, 1, 2, 3] and all(math.isnan(p.v) for p in line[4:])


def test_bounds_by_region_and_clip(spark):
    frame = spark.createDataFrame([(1, [float(k) for k in range(100)])], "f int, samples array<float>")
    bounds = lambda *k: tuple(S.frame_bounds(frame, ["f"], 10, 10, *k).select("lo", "hi").first())
    region = (0.0, 5.0, 10.0, 10.0)
    assert bounds() == (0, 99) and bounds(None, region) == (50, 99)
    assert bounds(None, (20.0, 0.0, 30.0, 5.0)) == (0, 99) and bounds(10.0, (20.0, 0.0, 30.0, 5.0)) == bounds(10.0)
    lo, hi = bounds(10.0)
    assert 9 <= lo <= 11 and 88 <= hi <= 90.1
    lo, hi = bounds(10.0, region)
    assert 54 <= lo <= 56 and 93 <= hi <= 95


def test_plans_of_frame_queries_have_one_exchange(spark, tiny):
    for name in ("frame_extent", "tone_map_u8", "colormap_turbo", "crop_region", "decimate_step", "line_profile", "pixel_readout", "content_bbox"):
        plan = queries.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 1 and "Join" not in plan, name


@pytest.mark.parametrize("percent", [0.01, 5.0])
def test_nan_never_wins(spark, percent):
    found = S.float_percentiles(px(spark, [NAN, 1, 2, 3, NAN], 5), ["media_id"], percent).first()
    assert found.p_lo >= 1 and found.p_hi <= 3
