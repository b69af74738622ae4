"""Uncompressed Windows bitmaps: palettes of 1, 4 and 8 bits, and 24 and 32 bits a pixel."""

from __future__ import annotations

import struct

import numpy as np


def decode(data: bytes) -> dict:
    """A frame of RGB, or of RGBA where the bitmap has 32 bits and some alpha; ValueError has the reason if it can't be had."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a bitmap")
    start, head, w, h, _, bits, packed, _, _, _, used = struct.unpack("<IIiiHHIIiiI", data[10:50])
    if head < 40 or packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h or (packed == 3 and bits != 32):
        raise ValueError("a bitmap of a kind that isn't read")
    row, rows = -(-w * bits // 32) * 4, abs(h)
    if len(data) < start + row * rows:
        raise ValueError("bitmap data is short")
    lines = np.frombuffer(data, np.uint8, row * rows, start).reshape(rows, row)
    lines = lines[::-1] if h > 0 else lines
    if bits <= 8:
        count = used or 1 << bits
        palette = np.zeros((256, 3), np.uint8)
        palette[:count] = np.frombuffer(data, np.uint8, count * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        index = lines if bits == 8 else np.unpackbits(lines, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1])
        image = palette[index[:, :w]]
    else:
        image = lines[:, : w * bits // 8].reshape(rows, w, bits // 8)
        image = image[:, :, [2, 1, 0, 3]] if bits == 32 and image[:, :, 3].any() else image[:, :, 2::-1]
    return {"w": w, "h": rows, "channels": image.shape[2], "dtype": "uint8", "is_mask": False, "samples": image.ravel().astype(np.float32)}
