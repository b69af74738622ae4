"""Golden cases of views, reordering, changed layouts and composition."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rasterlake.functions import geometry as G
from rasterlake.functions import tokens as K
from rasterlake.functions import tone as T
from rasterlake.operators import compose as C
from rasterlake.operators import layout as Y
from rasterlake.operators import timeline as L


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lits(*values):
    return [F.lit(v) for v in values]


def test_zoom_keeps_the_point_under_the_cursor(spark):
    zoom, cx, cy = G.zoom_at(*lits(2.0, 10.0, 20.0, 3.0, 130.0, 90.0, 100.0, 100.0))
    before = G.to_image(*lits(130.0, 90.0, 2.0, 10.0, 20.0, 100.0, 100.0))
    after = G.to_image(*lits(130.0, 90.0), zoom, cx, cy, *lits(100.0, 100.0))
    got = one(spark, *before, *after, zoom)
    assert abs(got[0] - got[2]) < 1e-9 and abs(got[1] - got[3]) < 1e-9 and got[4] == 6.0
    assert one(spark, G.zoom_at(*lits(500.0, 0.0, 0.0, 9.0, 0.0, 0.0, 0.0, 0.0))[0]) == (512.0,)


def test_rotated_mapping_is_undone(spark):
    view = lits(1.5, 3.0, 4.0, 100.0, 80.0)
    sx, sy = G.rotated_to_screen(*lits(5.0, 6.0, 32, 24, 33.0), *view)
    got = one(spark, *G.rotated_to_image(sx, sy, *lits(32, 24, 33.0), *view))
    assert abs(got[0] - 5) < 1e-9 and abs(got[1] - 6) < 1e-9


def test_indexes_after_reordering(spark):
    swap = lambda v, a, b: one(spark, Y.after_swap(*lits(v, a, b)))[0]
    move = lambda v, a, b: one(spark, Y.after_move(*lits(v, a, b)))[0]
    assert [swap(v, 1, 3) for v in range(5)] == [0, 3, 2, 1, 4]
    order = list("abcde")
    for a, b in ((1, 3), (4, 0), (2, 2)):
        moved = order[:]
        moved.insert(b, moved.pop(a))
        assert [moved[move(v, a, b)] for v in range(5)] == order
    assert [one(spark, Y.after_removal(*lits(v, 2)))[0] for v in range(5)] == [0, 1, None, 2, 3]


def test_layouts_that_change(spark):
    files = spark.createDataFrame([("m", 0, 2), ("m", 1, 3)], "media_id string, file_idx int, pages int")
    known = Y.frame_map(files, "media_id", "file_idx", "pages")
    longer = Y.frame_map(files.withColumn("pages", F.col("pages") + F.when(F.col("file_idx") == 1, 4).otherwise(0)), "media_id", "file_idx", "pages")
    other = Y.frame_map(files.withColumn("pages", F.lit(1)), "media_id", "file_idx", "pages")
    assert tuple(Y.extended(known, longer, "media_id").first()) == ("m", True, 9)
    assert tuple(Y.extended(known, other, "media_id").first()) == ("m", False, 5)
    assert sorted(tuple(r)[1:] for r in Y.reanchored(known, longer.filter("file_idx = 1").withColumn("frame_idx", F.col("frame_idx") - 2), "media_id").collect()) == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 2)]


def test_names_and_lengths(spark):
    assert one(spark, K.label(F.lit("  "), F.lit("clip")), K.label(F.lit(" own "), F.lit("clip"))) == ("clip", "own")
    assert one(spark, *(K.short_number(F.lit(v), 1, 0.05) for v in (45.0, 12.25, -0.02))) == ("45", "12.2", "0")
    assert [one(spark, K.export_format(F.lit(n)))[0] for n in ("a.PNG", "b", "c.mp4", "d.jpeg")] == ["image", "video", "video", "image"]
    assert one(spark, K.log_tail(F.lit("a\nb\nc\nd\n"), 3)) == ("d | c | b",)
    none = F.lit(None)
    frames = lambda n, p, s: one(spark, K.video_frames(n.cast("long"), p.cast("long"), s.cast("double"), F.lit(25.0)))[0]
    assert [frames(F.lit(7), none, none), frames(none, F.lit(0), F.lit(2.0)), frames(none, none, F.lit(2.0)), frames(none, none, none)] == [7, None, 50, None]


def test_plane_shapes(spark):
    shape = lambda *k: one(spark, T.plane_channels(*lits(*k)))[0]
    assert [shape("gray", 1, True, 2), shape("rgb", 3, True, 4), shape("rgb", 3, True, 3), shape("rgb", 3, False, 2), shape("cmyk", 4, False, 4), shape("icc", 3, True, 5), shape("icc", 2, False, 2)] == [1, 4, 3, None, None, 4, None]


def test_spans_hold_the_last_frame(spark):
    media = spark.createDataFrame([(1, 3, True, 0), (2, 2, True, 0), (3, 2, False, 5)], "media_id int, count long, synced boolean, own int")
    frames = spark.createDataFrame([(m, k) for m, n in ((1, 3), (2, 2), (3, 2)) for k in range(n)], "media_id int, frame_idx long")
    got = sorted(tuple(r) for r in L.spans(media, frames).collect())
    assert got == [(1, 0, 0, 0), (1, 1, 1, 1), (1, 2, 2, 2), (2, 0, 0, 0), (2, 1, 2, 1), (3, 0, 2, 1)]


def test_composition(spark):
    """Two cells of 2 x 2 at zoom 1, one turned by half, and a gap that shows no image."""
    frames = spark.createDataFrame([(0, 0, [0.0, 10.0, 20.0, 30.0])], "media_id int, frame_idx long, samples array<float>")
    cell = [0, 0, 2, 2, 1.0, 1.0, 1.0, False, None, None, None, None]
    rows = [(0, 0, 0, *cell[:7], 0.0, *cell[7:]), (0, 1, 0, 3, 0, 2, 2, 1.0, 1.0, 1.0, 180.0, *cell[7:])]
    panes = spark.createDataFrame(rows, "plan int, pane int, media_id int, left int, top int, cell_w int, cell_h int, zoom double, cx double, cy double, degrees double, masked boolean, pin_x0 int, pin_y0 int, pin_x1 int, pin_y1 int")
    got = {(r.ox, r.oy): (r.g, r.a) for r in C.compose(frames, panes, (5.0, 2.0), (5, 2), 2, 2, over=1e9).collect()}
    assert got == {(0, 0): (0, 255), (1, 0): (85, 255), (0, 1): (170, 255), (1, 1): (255, 255), (3, 0): (255, 255), (4, 0): (170, 255), (3, 1): (85, 255), (4, 1): (0, 255)}
    small = panes.filter("pane = 0").withColumns({"zoom": F.lit(0.5)})
    got = {(r.ox, r.oy): r.a for r in C.compose(frames, small, (2.0, 2.0), (4, 4), 2, 2, over=1e9).collect()}
    assert len(got) == 16 and sum(a == 255 for a in got.values()) == 4


def test_saved_pixels_round_products_to_floats(spark, tmp_path):
    """Products that lie under a whole number as doubles and on it as floats, by Spark and by the SQL beside it."""
    values = [float(np.float32(x)) for x in np.arange(1, 500, dtype=np.float32) / np.float32(500)]
    close = [v for v in values if int(v * 500) != int(np.float32(v) * np.float32(500))]
    rows = [(k, (close * 64)[:64], 0) for k in range(2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["saved_pixels"]).fetchall()
    got = entry.queries()["saved_pixels"](spark, str(tmp_path)).collect()
    assert len(close) > 9 and sorted(map(tuple, got)) == sorted(want)
