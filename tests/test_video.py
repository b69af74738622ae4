"""Videos whose frames stand alone."""

import io
import struct

import numpy as np
import pytest

from rasterlake.sources import avi, sink, store

RNG = np.random.default_rng(8)
FRAMES = [RNG.integers(0, 256, (5, 7, 3), dtype=np.uint8) for _ in range(150)]


class Kept(io.BytesIO):
    def close(self):
        self.data = self.getvalue()


def written(frames, **how):
    out = Kept()
    stream = avi.AviStream(out, **how)
    for f in frames:
        stream.add(f)
    stream.close()
    return out.data


def reader(data, log=None):
    def read(at, n):
        if log is not None:
            log.append((at, n))
        return data[at : at + n]

    return read


def test_written_frames_are_found_by_the_index():
    data = written(FRAMES[:10], rate=12.5)
    video = avi.opened(reader(data), len(data))
    assert (video.w, video.h, video.rate, len(video.frames)) == (7, 5, 12.5, 10)
    assert all((avi.decoded(video, data[at : at + n]) == f).all() for (at, n), f in zip(video.frames, FRAMES, strict=False))


def test_files_without_an_index_and_with_other_offsets():
    data = written(FRAMES[:6])
    want = avi.opened(reader(data), len(data)).frames
    bare = data[: data.rindex(b"idx1")]
    assert avi.opened(reader(bare), len(bare)).frames == want
    at, movi = data.rindex(b"idx1") + 8, data.index(b"movi")
    moved = bytearray(data)
    for k in range(6):
        (offset,) = struct.unpack("<I", data[at + 16 * k + 8 : at + 16 * k + 12])
        moved[at + 16 * k + 8 : at + 16 * k + 12] = struct.pack("<I", offset + movi)
    assert avi.opened(reader(bytes(moved)), len(moved)).frames == want


def test_motion_jpeg_is_near():
    smooth = [np.tile(np.arange(0, 240, 10, dtype=np.uint8)[:, None, None] + k, (1, 30, 3)) for k in range(3)]
    data = written(smooth, compressed=True)
    video = avi.opened(reader(data), len(data))
    assert max(np.abs(avi.decoded(video, data[at : at + n]).astype(int) - f).max() for (at, n), f in zip(video.frames, smooth, strict=True)) < 8


def test_a_jump_reads_its_range_only(spark, tmp_path):
    (tmp_path / "v.avi").write_bytes(written(FRAMES))
    (tmp_path / "w.avi").write_bytes(b"RIFFxxxxWAVE")
    plan = avi.AviReader(f"{tmp_path}/v.avi")
    assert [(p.first, len(p.video.frames)) for p in plan.partitions()] == [(0, 64), (64, 64), (128, 22)]
    plan.only = 77
    (one,) = plan.partitions()
    assert (one.first, len(one.video.frames)) == (77, 1)
    avi.register(spark)
    got = spark.read.format("avi_frames").load(f"{tmp_path}/*.avi").orderBy("media_id", "frame_idx").collect()
    assert [r.samples for r in got[:150]] == [f.astype(float).ravel().tolist() for f in FRAMES] and got[150].error == "not an AVI file"
    (jumped,) = spark.read.format("avi_frames").load(f"{tmp_path}/*.avi").filter("frame_idx = 149").collect()
    assert jumped.samples == FRAMES[149].astype(float).ravel().tolist() and jumped.seconds == 149 / 25


def test_frames_that_cannot_be_read_are_rows(spark, tmp_path):
    data = bytearray(written(FRAMES[:3]))
    other = data.replace(struct.pack("<H4s", 24, b"\0\0\0\0"), struct.pack("<H4s", 24, b"H264"))
    (tmp_path / "a.avi").write_bytes(other)
    (tmp_path / "b.avi").write_bytes(written(FRAMES[:3])[:-200])
    avi.register(spark)
    got = spark.read.format("avi_frames").load(f"{tmp_path}/*.avi").orderBy("media_id", "frame_idx").collect()
    assert [r.error for r in got[:3]] == ["no decoder for H264 video"] * 3 and [r.error for r in got[3:]] == [None, "frame data is short"]


@pytest.mark.parametrize("kind", ["avi", "mjpg"])
def test_the_sink_writes_runs_of_videos(spark, tmp_path, kind):
    rows = [(m, k, 7, 5, 1, "uint8", [float((k * 3 + j) % 256) for j in range(35)]) for m in ("x", "y/z") for k in range(10)]
    made = spark.createDataFrame(rows, "media_id string, frame_idx int, w int, h int, channels int, dtype string, samples array<float>")
    sink.write_frames(made, str(tmp_path), kind=kind, pages=4, rate=10)
    assert sorted(sink.named(x) for x in store.matching(f"{tmp_path}/*/*.avi")) == [(m, k) for m in ("x", "y/z") for k in range(3)]
    avi.register(spark)
    got = spark.read.format("avi_frames").load(f"{tmp_path}/*/*.avi").collect()
    assert len(got) == 20 and all(not r.error for r in got)
    if kind == "avi":
        want = {(r[0], r[1]): r[6] for r in rows}
        for r in got:
            media, number = sink.named(r.media_id)
            assert r.samples[::3] == want[media, number * 4 + r.frame_idx]
    with pytest.raises(Exception, match="one size"):
        sink.write_frames(made.selectExpr("media_id", "frame_idx", "IF(frame_idx = 2, 5, 7) AS w", "IF(frame_idx = 2, 7, 5) AS h", "channels", "dtype", "samples"), str(tmp_path / "bad"), kind=kind, pages=4)


def test_many_small_videos_share_tasks(tmp_path):
    for k in range(150):
        (tmp_path / f"{k:03d}.avi").write_bytes(b"none" if k == 5 else written(FRAMES[k % 7 : k % 7 + 2]))
    reader = avi.AviReader(f"{tmp_path}/*.avi")
    plan = reader.partitions()
    alone = [r for path in store.matching(f"{tmp_path}/*.avi") for p in reader.planned(path) for r in reader.read(p)]
    assert len(plan) < 80 and [r for p in plan for r in reader.read(p)] == alone and len(alone) == 299
