"""JPEG and BMP stills."""

import struct

import numpy as np
import pytest

from rasterlake.sources import bmp, files, jpeg, sink, store

RNG = np.random.default_rng(3)
Y, X = np.mgrid[:45, :70]
SMOOTH = np.stack([128 + 100 * np.sin(Y / 9), 128 + 90 * np.cos(X / 11), 128 + 80 * np.sin((X + Y) / 13)], axis=2).round().astype(np.uint8)
NOISE = RNG.integers(0, 256, (45, 70), dtype=np.uint8)


def back(data):
    got = jpeg.decode(data)
    return got["samples"].reshape(got["h"], got["w"], got["channels"]).astype(int)


def test_the_stored_order_of_coefficients():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:].tolist() == [55, 62, 63] and sorted(jpeg.ZIGZAG) == list(range(64))


def test_a_block_written_by_hand():
    """One grey 8 x 8 block: a mean, and one horizontal cosine."""
    dht = lambda k, counts, symbols: struct.pack(">BBHB", 0xFF, 0xC4, 19 + len(symbols), k) + bytes(counts + [0] * (16 - len(counts))) + bytes(symbols)
    head = b"\xff\xd8" + b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([2] * 64) + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 8, 8, 1) + bytes([1, 0x11, 0])
    head += dht(0x00, [0, 1], [6]) + dht(0x10, [1, 1], [0x05, 0x00]) + b"\xff\xda" + struct.pack(">H", 8) + bytes([1, 1, 0, 0, 63, 0])
    bits = "00" + format(40, "06b") + "0" + format(20, "05b") + "10"  # DC 40, first AC 20, end of block
    data = int(bits + "1" * (-len(bits) % 8), 2).to_bytes(2)
    wave = np.cos((2 * np.arange(8) + 1) * np.pi / 16) * 40 * np.sqrt(1 / 8) / 2
    want = np.tile(np.round(128 + 80 / 8 + wave), (8, 1))
    assert np.abs(back(head + data + b"\xff\xd9")[:, :, 0] - want).max() <= 1


@pytest.mark.parametrize("shape", [(8, 8), (1, 1), (17, 9), (45, 70)])
def test_grey_at_full_quality_differs_by_rounding(shape):
    image = NOISE[: shape[0], : shape[1]]
    assert np.abs(back(jpeg.encode(image, 100))[:, :, 0] - image).max() <= 2


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (2, 2), (1, 2), (4, 1)])
def test_colour_with_every_sampling(sampling, restart):
    got = back(jpeg.encode(SMOOTH, 100, sampling, restart))
    error = np.abs(got - SMOOTH)
    assert got.shape == SMOOTH.shape and error.mean() < (1.2 if sampling == (1, 1) else 5) and error.max() < (4 if sampling == (1, 1) else 40)


def test_quality_trades_size():
    rough, fine = jpeg.encode(SMOOTH, 40, (2, 2)), jpeg.encode(SMOOTH, 98)
    assert len(rough) < len(fine) and np.abs(back(rough) - SMOOTH).mean() < 12


def test_long_codes_are_cut_to_sixteen_bits():
    from collections import Counter

    counts, symbols = jpeg._lengths(Counter({k: 2**k for k in range(30)}))
    codes = jpeg._codes(counts, symbols)
    assert sum(counts) == 30 and set(codes.values()) == set(range(30)) and sum(2.0**-n for n, _ in codes) < 1
    assert all(code != (1 << n) - 1 for n, code in codes)


def test_what_is_refused():
    whole = jpeg.encode(SMOOTH)
    for data, reason in [
        (b"nothing", "not a JPEG"),
        (whole.replace(b"\xff\xc0", b"\xff\xc2"), "progressive"),
        (whole[: len(whole) // 2], "ends early"),
        (whole[:40], "without an image|can't be read|smaller than"),
        (b"\xff\xd8\xff\xd9", "without an image"),
    ]:
        with pytest.raises(ValueError, match=reason):
            jpeg.decode(data)


def bitmap(image, bits, palette=b"", down=False):
    h, w = image.shape[:2]
    rows = [r.tobytes() for r in (image if down else image[::-1])]
    rows = [r + bytes(-len(r) % 4) for r in rows]
    body = struct.pack("<IiiHHIIiiII", 40, w if bits > 4 else w * 8 // bits, -h if down else h, 1, bits, 0, 0, 0, 0, len(palette) // 4, 0) + palette
    return b"BM" + struct.pack("<IHHI", 14 + len(body) + len(b"".join(rows)), 0, 0, 14 + len(body)) + body + b"".join(rows)


def test_bitmaps():
    rgb = SMOOTH[:5, :7]
    for down in (False, True):
        got = bmp.decode(bitmap(rgb[:, :, ::-1].copy(), 24, down=down))
        assert got["samples"].reshape(5, 7, 3).tolist() == rgb.tolist()
    palette = bytes(v for k in range(4) for v in (k, 10 * k, 20 * k, 0))
    index = RNG.integers(0, 4, (3, 6), dtype=np.uint8)
    assert bmp.decode(bitmap(index, 8, palette))["samples"].reshape(3, 6, 3).tolist() == [[[20 * k, 10 * k, k] for k in r] for r in index.tolist()]
    nibbles = bmp.decode(bitmap(np.array([[0x12, 0x30]], np.uint8), 4, palette))
    assert nibbles["samples"].reshape(4, 3)[:, 2].tolist() == [1, 2, 3, 0]
    clear = np.zeros((2, 2, 4), np.uint8)
    assert bmp.decode(bitmap(clear, 32))["channels"] == 3 and bmp.decode(bitmap(clear + 9, 32))["channels"] == 4
    for bad in (b"BM", bitmap(rgb, 24)[:-20], bitmap(rgb, 24).replace(struct.pack("<HH", 1, 24), struct.pack("<HH", 1, 16))):
        with pytest.raises(ValueError):
            bmp.decode(bad)


def test_stills_of_a_folder_and_back(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(jpeg.encode(SMOOTH, 100))
    (tmp_path / "b.jpeg").write_bytes(jpeg.encode(NOISE, 100)[:300])
    (tmp_path / "c.bmp").write_bytes(bitmap(SMOOTH, 24))
    got = {r.media_id[-6:]: r for r in files.read_frames(spark, str(tmp_path)).collect()}
    assert (got["/a.JPG"].channels, got["/c.bmp"].w, got["b.jpeg"].error) == (3, 70, "the JPEG data ends early")
    sink.write_frames(files.read_frames(spark, f"{tmp_path}/a.JPG"), str(tmp_path / "out"), kind="jpg")
    (path,) = store.matching(f"{tmp_path}/out/*/*.jpg")
    assert np.abs(back(open(path, "rb").read()) - SMOOTH).max() < 6
