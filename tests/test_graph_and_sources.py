"""The compute graph and the TIFF source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.plans.graph import Graph, Node, parse_node, reachable
from rasterlake.sources import files, png, tiff


def still(spark, frames):
    return spark.createDataFrame([(k, 0, x, float(v)) for k, f in enumerate(frames) for x, v in enumerate(f)], "frame_idx int, y int, x int, v float")


def test_mean_then_sub_and_cycles(spark):
    g = Graph({0: still(spark, [[0, 10], [4, 20]])}).add(1, Node("mean", 0)).add(2, Node("sub", 0, 1))
    assert sorted(r.v for r in g.plan(1).collect()) == [2, 15]
    assert sorted((r.frame_idx, r.x, r.v) for r in g.plan(2).collect()) == [(0, 0, -2), (0, 1, -5), (1, 0, 2), (1, 1, 5)]
    with pytest.raises(ValueError):
        g.add(1, Node("add", 2, 0))
    assert parse_node("compute:diff:0,1:auto") == Node("sub", 0, 1) and parse_node("compute:bogus:0") is None and parse_node("x.tif") is None


def test_reachable(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (4, 3)], "node int, source int")
    assert {(r.node, r.source) for r in reachable(spark, edges).collect()} == {(3, 2), (2, 1), (4, 3), (3, 1), (4, 2), (4, 1)}


def pages(n, dtype=np.uint16, h=5, w=7):
    return [((k * 1000 + np.arange(h * w) * 97) % 65536).reshape(h, w).astype(dtype) for k in range(n)]


@pytest.mark.parametrize("order,big,dtype", [("<", False, np.uint16), (">", False, np.uint16), ("<", True, np.float32), (">", True, np.uint8)])
def test_tiff_round_trip(spark, tmp_path, order, big, dtype):
    want = pages(4, dtype)
    (tmp_path / "a.tif").write_bytes(tiff.encode(want, order, big))
    tiff.register(spark)
    got = spark.read.format("tiff_frames").load(f"{tmp_path}/*.tif").orderBy("frame_idx").collect()
    assert [r.samples for r in got] == [p.ravel().astype(np.float32).tolist() for p in want]
    assert {(r.w, r.h, r.channels, r.dtype, r.is_mask) for r in got} == {(7, 5, 1, np.dtype(dtype).name, False)}


def test_tiff_headers_filter_and_errors(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff.encode(pages(3)))
    (tmp_path / "bad.tif").write_bytes(b"nothing")
    tiff.register(spark)
    headers = spark.read.format("tiff_frames").option("headers", "true").load(f"{tmp_path}/a.tif").orderBy("frame_idx").collect()
    assert [r.next_off for r in headers][:-1] == [r.off for r in headers][1:] and headers[-1].next_off == 0
    one = spark.read.format("tiff_frames").load(f"{tmp_path}/a.tif").filter(F.col("frame_idx") == 2).collect()
    assert [r.frame_idx for r in one] == [2] and one[0].samples[0] == 2000
    (tmp_path / "c.jp2").write_bytes(b"codec")
    loaded = files.read_frames(spark, str(tmp_path)).filter("media_id NOT LIKE '%jp2'").collect()
    assert len(loaded) == 4 and [r.error for r in loaded if r.error] == ["no TIFF signature"]


def test_broken_page_chains_are_errors(spark, tmp_path):
    whole = tiff.encode(pages(3))
    (tmp_path / "short.tif").write_bytes(whole[: len(whole) - 100])
    got = files.read_frames(spark, str(tmp_path)).collect()
    assert [r.frame_idx for r in got] == [0, 1, None] and got[-1].error
    file = tiff.Tiff(lambda at, n: whole[at : at + n])
    loop = bytearray(whole)
    last = list(file.headers())[-1]
    at = last.off + 2 + 12 * len(last.tags)
    loop[at : at + 4] = file.first.to_bytes(4, "little")
    with pytest.raises(ValueError, match="after 3"):
        list(tiff.Tiff(lambda at, n: bytes(loop[at : at + n])).headers())


def test_reachable_of_diamonds(spark):
    edges = spark.createDataFrame([(k + step, k) for k in range(40) for step in (1, 2)], "node int, source int")
    assert reachable(spark, edges).count() == 41 * 42 // 2 - 1


def test_strips_merge_into_runs():
    assert tiff.merged((10, 20, 50, 60), (10, 10, 10, 5)) == [(10, 20), (50, 15)]


@pytest.mark.parametrize("shape,dtype", [((6, 5), np.uint8), ((6, 5), np.uint16), ((4, 3, 3), np.uint8), ((4, 3, 4), np.uint16)])
def test_png_round_trip(shape, dtype):
    image = ((np.arange(np.prod(shape)) * 4099) % np.iinfo(dtype).max).reshape(shape).astype(dtype)
    got = png.decode(png.encode(image))
    assert got["samples"].tolist() == image.ravel().tolist() and (got["h"], got["w"]) == shape[:2] and got["dtype"] == np.dtype(dtype).name


def test_png_filters():
    rows, bpp = np.random.default_rng(1).integers(0, 256, (5, 12), dtype=np.uint8), 3
    raw, above = bytearray(), np.zeros(12, int)
    for kind, row in enumerate(rows.astype(int)):
        left, corner = np.append([0] * bpp, row[:-bpp]), np.append([0] * bpp, above[:-bpp])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [np.zeros(12, int), left, above, (left + above) // 2, near][kind]
        raw += bytes([kind, *((row - guess) % 256)])
        above = row
    assert png.unfiltered(bytes(raw), 5, 12, bpp).tolist() == rows.tolist()


def test_files_become_one_timeline_and_back(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff.encode(pages(2)))
    (tmp_path / "b.PNG").write_bytes(png.encode(pages(1, np.uint8)[0]))
    (tmp_path / "note.txt").write_text("no image")
    got = files.read_sequence(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.page, r.dtype) for r in got] == [(0, 0, "uint16"), (1, 1, "uint16"), (2, 0, "uint8")]
    frames = files.read_frames(spark, str(tmp_path))
    back = files.encoded(frames, "tif").collect()
    assert sorted(tiff_samples(r.content) for r in back) == sorted(r.samples for r in got)
    shown = {r.frame_idx: png.decode(r.content)["samples"].tolist() for r in files.encoded(frames.filter("media_id LIKE '%PNG'"), "png").collect()}
    assert shown[0] == got[2].samples


def tiff_samples(content):
    file = tiff.Tiff(lambda at, n: content[at : at + n])
    return file.decode(file.header(file.first))["samples"].tolist()
