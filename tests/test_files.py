"""Codecs, the page index and the sink."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.sources import codecs, files, pages, sink, store, tiff

RNG = np.random.default_rng(4)
#: The worked example of each format's description.
PACKED, UNPACKED = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
LZW_CODES, LZW_BYTES = (256, 7, 258, 8, 8, 258, 6, 6, 257), bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def bits(codes, width=9):
    text = "".join(f"{c:0{width}b}" for c in codes)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))


def test_codecs_give_the_formats_examples():
    assert codecs.packbits_decoded(PACKED, 24) == UNPACKED and codecs.packbits_decoded(codecs.packbits_encoded(UNPACKED), 24) == UNPACKED
    assert codecs.lzw_decoded(bits(LZW_CODES), 9) == LZW_BYTES and codecs.lzw_encoded(LZW_BYTES) == bits(LZW_CODES)


@pytest.mark.parametrize("name", ["packbits", "lzw", "deflate"])
@pytest.mark.parametrize("data", [b"", b"x", bytes(500), bytes(range(256)) * 90, RNG.integers(0, 4, 30_000, dtype=np.uint8).tobytes(), RNG.integers(0, 256, 20_000, dtype=np.uint8).tobytes(), b"ab" * 129 + b"c" * 128 + b"d" * 129])
def test_codecs_round_trip(name, data):
    tag, encode = codecs.ENCODERS[name]
    stored = encode(data)
    assert codecs.DECODERS[tag](stored, len(data)) == data
    cut = codecs.DECODERS[tag](stored[: len(stored) // 2], len(data))
    assert data.startswith(cut) and (len(cut) < len(data) or not data or len(data) == 1)


IMAGES = {
    "u1": RNG.integers(0, 256, (21, 37), dtype=np.uint8),
    "u2": RNG.integers(0, 65536, (21, 37, 3), dtype=np.uint16),
    "f4": RNG.normal(size=(21, 37, 2)).astype(np.float32),
    "i4": RNG.integers(-1000, 1000, (21, 37), dtype=np.int32),
}


@pytest.mark.parametrize("kind", IMAGES)
@pytest.mark.parametrize("compression", ["none", "packbits", "lzw", "deflate"])
@pytest.mark.parametrize("how", [{}, {"rows_per_strip": 4}, {"tile": (16, 16)}, {"rows_per_strip": 5, "planar": 2, "big": True}, {"tile": (16, 32), "order": ">", "planar": 2}])
def test_every_layout_decodes_to_the_same_samples(kind, compression, how):
    image = IMAGES[kind]
    for predictor in (1, 3 if kind == "f4" else 2):
        data = tiff.encode([image, image[::-1]], compression=compression, predictor=predictor, **how)
        file = tiff.Tiff(lambda at, n, data=data: data[at : at + n])
        got = [file.decode(h)["samples"] for h in file.headers()]
        assert [g.tolist() for g in got] == [image.astype(np.float32).ravel().tolist(), image[::-1].astype(np.float32).ravel().tolist()]


def masks(compression):
    """A page of bits, white as 0, in strips of three rows."""
    bits_ = RNG.integers(0, 2, (7, 19), dtype=np.uint8)
    layout = tiff.Layout(compression=compression, rows_per_strip=3)
    packed = np.packbits(bits_ ^ 1, axis=1)
    data = bytearray(tiff.Layout.signature.fget(layout) + layout.page(packed, 8, True))
    for tag, value in ((tiff.WIDTH, 19), (tiff.BITS, 1), (tiff.PHOTOMETRIC, 0)):
        at = next(k for k in range(10, 200, 12) if data[k : k + 2] == tag.to_bytes(2, "little"))
        data[at + 8 : at + 12] = value.to_bytes(4, "little")
    return bits_, bytes(data)


@pytest.mark.parametrize("compression", ["none", "packbits", "lzw", "deflate"])
def test_masks_are_the_stored_bits(compression):
    want, data = masks(compression)
    file = tiff.Tiff(lambda at, n: data[at : at + n])
    got = file.decode(file.header(file.first))
    assert got["is_mask"] and got["samples"].tolist() == want.ravel().tolist()


def test_pages_that_cannot_be_read_are_rows_with_the_reason(spark, tmp_path):
    good = tiff.encode([IMAGES["u1"]], compression="deflate", predictor=2)
    short = bytearray(tiff.encode([IMAGES["u1"]], compression="lzw"))
    at = next(k for k in range(10, 200, 12) if short[k : k + 2] == tiff.STRIP_COUNTS.to_bytes(2, "little"))
    short[at + 8 : at + 12] = (40).to_bytes(4, "little")
    other = bytearray(good)
    at = next(k for k in range(10, 200, 12) if other[k : k + 2] == tiff.COMPRESSION.to_bytes(2, "little"))
    other[at + 8 : at + 10] = (7).to_bytes(2, "little")
    for name, data in (("a.tif", good), ("b.tif", short), ("c.tif", other), ("d.tif", b"none"), ("e.tif", good[:-9])):
        (tmp_path / name).write_bytes(data)
    tiff.register(spark)
    want = ["None", "strip or tile 0 is short", "no decoder for compression 7", "no TIFF signature", "strip or tile 0 is short"]
    by_source = spark.read.format("tiff_frames").load(f"{tmp_path}/*.tif").orderBy("media_id").collect()
    assert [str(r.error) for r in by_source] == want and [r.samples is None for r in by_source] == [False, True, True, True, True]
    assert [str(r.error) for r in files.read_frames(spark, str(tmp_path)).orderBy("media_id").collect()] == want


def counting(data):
    file = tiff.Tiff(lambda at, n: data[at : at + n])
    seen, header = [], file.header
    file.header = lambda off: seen.append(off) or header(off)
    return file, seen


def test_index_of_a_hundred_thousand_pages():
    data = tiff.encode([np.full((2, 3), k % 251, np.uint8) for k in range(100_000)])
    file, seen = counting(data)
    index = pages.measured(file, len(data))
    assert len(seen) < 50 and index.count == 100_000
    for k in (0, 1, 777, 99_999):
        assert file.decode(file.header(index.offset(k)))["samples"][0] == k % 251


@pytest.mark.parametrize("count", [1, 2, 3, 64, 65, 200])
def test_index_equals_walk(count):
    data = tiff.encode([np.full((3, 3), k, np.uint16) for k in range(count)])
    for more in (b"", bytes(5000)):  # what stands behind the last page isn't one
        file, _ = counting(data + more)
        index = pages.measured(file, len(data) + len(more))
        assert [index.offset(k) for k in range(index.count)] == [h.off for h in file.headers()]


def test_files_without_a_stride_have_no_index(spark, tmp_path):
    same = [np.full((3, 3), k, np.uint16) for k in range(9)]
    odd = tiff.encode([*same[:5], np.zeros((4, 3), np.uint16), *same[5:]])
    packed = tiff.encode([RNG.integers(0, 1 + 50 * k, (3, 30), dtype=np.uint16) for k in range(9)], compression="deflate")
    for data in (odd, packed):
        assert pages.measured(counting(data)[0], len(data)) is None
    broken = bytearray(tiff.encode(same))
    file, _ = counting(bytes(broken))
    middle = [h.off for h in file.headers()][4]
    at = middle + 2 + 12 * len(file.header(middle).tags)
    broken[at : at + 4] = (middle + 1).to_bytes(4, "little")
    (tmp_path / "odd.tif").write_bytes(odd)
    (tmp_path / "packed.tif").write_bytes(packed)
    tiff.register(spark)
    got = spark.read.format("tiff_frames").load(f"{tmp_path}/*.tif").groupBy("media_id").agg(F.count("*").alias("n"), F.count("error").alias("bad")).orderBy("media_id").collect()
    assert [(r.n, r.bad) for r in got] == [(10, 0), (9, 0)]
    (tmp_path / "broken.tif").write_bytes(bytes(broken))
    reader = tiff.TiffReader(f"{tmp_path}/broken.tif", False)
    plan = reader.partitions()
    assert plan[0].stride == 0 or pytest.raises(ValueError, list, reader.read(plan[0]))


def test_one_page_is_planned_alone(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff.encode([np.full((3, 3), k, np.uint16) for k in range(300)]))
    tiff.register(spark)
    reader = tiff.TiffReader(f"{tmp_path}/a.tif", False)
    assert len(reader.partitions()) == 5
    reader.only = 123
    (only,) = reader.partitions()
    assert (only.first, only.count) == (123, 1) and [r[1] for r in reader.read(only)] == [123]
    got = spark.read.format("tiff_frames").load(f"{tmp_path}/a.tif").filter("frame_idx = 299").collect()
    assert [(r.frame_idx, r.samples[0]) for r in got] == [(299, 299.0)]


def test_paths_of_a_store(tmp_path):
    for name in ("a/x-1.tif", "a/y.txt", "b/x-2.tif"):
        os.makedirs(tmp_path / name[0], exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    assert [x[-7:] for x in store.matching(f"{tmp_path}/*/x-?.tif")] == ["x-1.tif", "x-2.tif"]
    assert store.matching(f"file://{tmp_path}/a/*.tif") and store.matching(f"{tmp_path}/none/*") == []
    read = store.Reader(f"{tmp_path}/a/y.txt")
    assert (read(3, 10), read(9, 1), read.size) == (b"45", b"", 5)


def frames(spark, n=10, media=("a/b c", "x")):
    rows = [(m, k, 3, 2, 1, "uint16", [float(k * 6 + j) for j in range(6)]) for m in media for k in range(n)]
    return spark.createDataFrame(rows, "media_id string, frame_idx int, w int, h int, channels int, dtype string, samples array<float>")


@pytest.mark.parametrize("count,compression", [(1, "lzw"), (4, "none"), (100, "deflate")])
def test_written_frames_come_back(spark, tmp_path, count, compression):
    path = str(tmp_path / "out")
    made = frames(spark)
    sink.write_frames(made, path, pages=count, compression=compression)
    back = sink.read_back(spark, path, count)
    key = lambda r: (r.media_id, r.frame_idx)
    assert [(*key(r), r.samples) for r in sorted(back.collect(), key=key)] == [(*key(r), r.samples) for r in sorted(made.collect(), key=key)]
    assert len(store.matching(f"{path}/part-*/*")) == 2 * -(-10 // count) and not os.path.exists(f"{path}/_staged")
    sink.write_frames(made.filter("frame_idx < 2"), path, pages=count, mode="overwrite")
    assert sink.read_back(spark, path, count).count() == 4


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    sink.write_frames(frames(spark, 2), path)
    before = store.matching(f"{path}/*/*")
    with pytest.raises(Exception, match="boom"):
        sink.write_frames(frames(spark).withColumn("w", F.when(F.col("frame_idx") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("w")).cast("int")), path)
    with pytest.raises(Exception, match="no samples"):
        sink.write_frames(frames(spark).withColumn("samples", F.when(F.col("frame_idx") != 3, F.col("samples"))), path, pages=4)
    with pytest.raises(Exception, match="more than once"):
        sink.write_frames(frames(spark).unionAll(frames(spark)).coalesce(1), path, pages=1)
    assert store.matching(f"{path}/*/*") == before and not os.path.exists(f"{path}/_staged")


def test_attempts_that_do_not_count_are_dropped(tmp_path):
    """A task killed midway, and one that ran twice: the commit takes one attempt of each."""
    writer = sink.FrameWriter(str(tmp_path), "tif", 1, tiff.Layout(), False)
    row = lambda k: {"media_id": "m", "frame_idx": k, "w": 2, "h": 1, "channels": 1, "dtype": "uint8", "samples": [k, k]}

    def killed():
        yield row(0)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(killed())
    first, again = writer.write(iter([row(0), row(1)])), writer.write(iter([row(0), row(1)]))
    os.makedirs(f"{writer._staged()}/lost")
    writer.commit([again, writer.write(iter([])), None])
    found = store.matching(f"{tmp_path}/*/*")
    assert [sink.named(x) for x in found] == [("m", 0), ("m", 1)] and first.folder not in "".join(found) and not os.path.exists(tmp_path / "_staged")
    other = sink.FrameWriter(str(tmp_path), "png", 1, tiff.Layout(), False)
    other.write(iter([row(5)]))
    other.abort([None])
    assert len(store.matching(f"{tmp_path}/*/*")) == 2


def test_inflated_reports_what_is_no_stream():
    with pytest.raises(ValueError):
        codecs.inflated(b"\x00\x01\x02", 10)
    assert codecs.inflated(zlib.compress(b"abc"), 0) == b""


def test_many_small_files_share_tasks(spark, tmp_path):
    """Files of one page and of several, broken ones, and a large one among them: few partitions, the rows of each file on its own."""
    for k in range(200):
        data = tiff.encode([np.full((3, 3), k + j, np.uint16) for j in range(1 + k % 3)])
        (tmp_path / f"f{k:03d}.tif").write_bytes({7: b"none", 8: data[:-9], 9: b""}.get(k, data))
    (tmp_path / "large.tif").write_bytes(tiff.encode([np.full((800, 900), j, np.float32) for j in range(2)]))
    for headers in (False, True):
        reader = tiff.TiffReader(f"{tmp_path}/*.tif", headers)
        plan = reader.partitions()
        assert len(plan) < 110 and [p.count for p in plan if isinstance(p, tiff.Pages)] == [2]
        alone = [r for path in store.matching(f"{tmp_path}/*.tif") for p in reader.planned(path) for r in reader.read(p)]
        assert sorted((r for p in plan for r in reader.read(p)), key=lambda r: r[:2]) == sorted(alone, key=lambda r: r[:2])
        reader.only = 1
        first = [r for path in store.matching(f"{tmp_path}/*.tif") for p in reader.planned(path) for r in reader.read(p)]
        assert sorted((r for p in reader.partitions() for r in reader.read(p)), key=lambda r: r[0]) == first and len(first) > 100
    tiff.register(spark)
    got = spark.read.format("tiff_frames").load(f"{tmp_path}/*.tif")
    assert got.rdd.getNumPartitions() < 110 and got.count() == len(alone)


def test_a_long_listing_is_divided_by_bytes():
    files_ = [(f"/a/{k % 3}/{k}", 1000) for k in range(30_000)] + [("/a/big", store.SMALL_BYTES + 1)]
    alone, together = store.divided(sorted(files_))
    assert alone == ["/a/big"] and sorted(p for t in together for p in t.paths()) == sorted(p for p, _ in files_[:-1])
    assert 50 < len(together) < 80 and max(len(list(t.paths())) for t in together) < 600
    assert store.divided(files_[:64]) == ([p for p, _ in files_[:64]], [])


def test_lzw_reads_and_writes_codes_many_at_a_time():
    """Every cut gives the start of the data and no error, over widening and full tables."""
    data = RNG.integers(0, 250, 9_000, dtype=np.uint8).tobytes() + b"ab" * 4_000
    stored = codecs.lzw_encoded(data)
    for cut in range(0, len(stored), 97):
        assert data.startswith(codecs.lzw_decoded(stored[:cut], len(data)))
