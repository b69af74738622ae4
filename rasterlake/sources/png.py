"""PNG at native depth with NumPy and zlib: decode and encode one image."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel of the colour types (grey, RGB, palette, grey and alpha, RGBA).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes):
    at = len(MAGIC)
    while at + 8 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += size + 12


def unfiltered(raw: bytes, h: int, stride: int, bpp: int) -> np.ndarray:
    """Rows of bytes once each row's filter is undone."""
    rows = np.frombuffer(raw, np.uint8, count=h * (stride + 1)).reshape(h, stride + 1)
    out = np.zeros((h + 1, stride + bpp), np.uint8)
    for y in range(h):
        kind, line, above, own = rows[y, 0], rows[y, 1:], out[y], out[y + 1]
        if kind == 0:
            own[bpp:] = line
        elif kind == 2:
            own[bpp:] = line + above[bpp:]
        elif kind == 1:
            for c in range(bpp):
                own[bpp + c :: bpp] = np.cumsum(line[c::bpp], dtype=np.uint8)
        else:
            a, b = own.tolist(), above.tolist()
            for k, v in enumerate(line.tolist(), bpp):
                left, up, corner = a[k - bpp], b[k], b[k - bpp]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda x: abs(p - x))
                a[k] = (v + guess) & 255
            own[:] = a
    return out[1:, bpp:]


def decode(data: bytes) -> dict:
    """A frame; grey with alpha drops its alpha, palettes become RGB. ValueError has the reason if it can't."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG file")
    parts = list(chunks(data))
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", dict(parts)[b"IHDR"])
    if interlaced or colour not in SAMPLES:
        raise ValueError("unsupported PNG layout")
    spp = SAMPLES[colour]
    stride = -(-w * spp * depth // 8)
    rows = unfiltered(zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT")), h, stride, max(1, spp * depth // 8))
    if depth == 16:
        values = np.ascontiguousarray(rows).view(">u2")
    elif depth == 8:
        values = rows
    else:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        values = bits.dot(1 << np.arange(depth - 1, -1, -1))[:, : w * spp]
        values = values if colour == 3 else values * (255 // ((1 << depth) - 1))
    image = values.reshape(h, w, spp)
    if colour == 3:
        image = np.frombuffer(dict(parts)[b"PLTE"], np.uint8).reshape(-1, 3)[image[..., 0]]
    elif colour == 4:
        image = image[..., :1]
    return {"w": w, "h": h, "channels": image.shape[2], "dtype": "uint16" if depth == 16 else "uint8", "is_mask": False, "samples": image.astype(np.float32).ravel()}


def encode(image: np.ndarray) -> bytes:
    """A PNG of a uint8 or uint16 image of 1, 3 or 4 channels."""
    h, w, spp = (*image.shape, 1)[:3]
    colour = {1: 0, 3: 2, 4: 6}[spp]
    rows = image.astype(image.dtype.newbyteorder(">")).tobytes()
    stride = len(rows) // h
    raw = b"".join(b"\0" + rows[y * stride : (y + 1) * stride] for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, image.dtype.itemsize * 8, colour, 0, 0, 0)
    return MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
