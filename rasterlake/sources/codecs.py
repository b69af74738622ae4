"""Byte codecs of TIFF segments, both ways, and the predictors before them.

A decoder takes a segment's bytes and how many it should give; what is cut off gives
fewer, which the caller reports. Repetition is found in C or NumPy where the format
allows it; LZW follows its codes one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

#: Compression tags of TIFF.
NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, END, FIRST_FREE, WIDEST = 256, 257, 258, 12
SINGLES = (*(bytes([k]) for k in range(256)), b"", b"")
#: Bytes of codes that are shifted at once.
LZW_READ = 32


def packbits_decoded(data: bytes, wanted: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < wanted:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 + (n > 128)
    return bytes(out)


def packbits_encoded(data: bytes) -> bytes:
    """Runs of three and more are repeated, the rest goes as it is, 128 bytes at most each."""
    values = np.frombuffer(data, np.uint8)
    if not len(values):
        return b""
    starts = np.append(0, np.flatnonzero(np.diff(values)) + 1)
    out, plain = bytearray(), bytearray()

    def flush() -> None:
        for k in range(0, len(plain), 128):
            out.extend([len(plain[k : k + 128]) - 1])
            out.extend(plain[k : k + 128])
        plain.clear()

    for at, n in zip(starts.tolist(), np.diff(np.append(starts, len(values))).tolist(), strict=True):
        if n < 3:
            plain += data[at : at + n]
            continue
        flush()
        for k in range(0, n, 128):
            part = min(128, n - k)
            out += bytes([257 - part, data[at]]) if part > 1 else bytes([0, data[at]])
    flush()
    return bytes(out)


def lzw_decoded(data: bytes, wanted: int) -> bytes:
    """Codes stand most significant bit first and widen one code early."""
    table, width, mask, held, bits, at, last, out = list(SINGLES), 9, 511, 0, 0, 0, b"", bytearray()
    while True:
        if bits < width:
            more = data[at : at + LZW_READ]
            at += len(more)
            held, bits = (held & (1 << bits) - 1) << 8 * len(more) | int.from_bytes(more), bits + 8 * len(more)
            if bits < width:
                break
        bits -= width
        code = held >> bits & mask
        if code == CLEAR:
            table, width, mask, last = list(SINGLES), 9, 511, b""
            continue
        if code == END or len(out) >= wanted:
            break
        if code < len(table):
            found = table[code]
        elif code == len(table) and last:
            found = last + last[:1]
        else:
            raise ValueError("an LZW code before its entry")
        out += found
        if last:
            table.append(last + found[:1])
            if len(table) >= mask and width < WIDEST:
                width += 1
                mask = (1 << width) - 1
        last = found
    return bytes(out)


def lzw_encoded(data: bytes) -> bytes:
    """A string in the table is named by the code of all but its last byte, and that byte."""
    table: dict[int, int] = {}
    width, free, held, bits, out = 9, FIRST_FREE, CLEAR, 9, bytearray()
    prefix = data[0] if data else -1
    for byte in data[1:]:
        longer = prefix << 8 | byte
        if longer in table:
            prefix = table[longer]
            continue
        held, bits = held << width | prefix, bits + width
        if bits > 8 * LZW_READ:
            out += (held >> bits % 8).to_bytes(bits // 8)
            bits %= 8
            held &= (1 << bits) - 1
        table[longer] = free
        free += 1
        if free == (1 << WIDEST) - 2:
            held, bits = held << width | CLEAR, bits + width
            table, width, free = {}, 9, FIRST_FREE
        elif free == 1 << width:
            width += 1
        prefix = byte
    if prefix >= 0:
        held, bits = held << width | prefix, bits + width
        width += free + 1 == 1 << width and width < WIDEST
    held, bits = held << width | END, bits + width
    return bytes(out) + (held << -bits % 8).to_bytes(-(-bits // 8))


def inflated(data: bytes, wanted: int) -> bytes:
    """As much as there is: a stream that is cut off gives what came before."""
    try:
        return zlib.decompressobj().decompress(data, wanted) if wanted else b""
    except zlib.error as reason:
        raise ValueError(f"a Deflate stream that can't be read: {reason}") from None


DECODERS: dict[int, Callable[[bytes, int], bytes]] = {NONE: lambda data, wanted: data, PACKBITS: packbits_decoded, LZW: lzw_decoded, ADOBE_DEFLATE: inflated, DEFLATE: inflated}
#: Names that writers take.
ENCODERS: dict[str, tuple[int, Callable[[bytes], bytes]]] = {"none": (NONE, bytes), "packbits": (PACKBITS, packbits_encoded), "lzw": (LZW, lzw_encoded), "deflate": (ADOBE_DEFLATE, zlib.compress)}


def unpredicted(rows: np.ndarray, predictor: int, kind: np.dtype, order: str) -> np.ndarray:
    """(rows, columns, channels) of values from the bytes of (rows, columns, channels, itemsize)."""
    n, cols, channels, size = rows.shape
    values = rows.reshape(n, -1).view(kind.newbyteorder(order)).reshape(n, cols, channels)
    if predictor == 2:
        return np.add.accumulate(values.astype(kind), axis=1, dtype=kind) if kind.kind in "iu" else _no_predictor(predictor)
    if predictor == 3:
        if kind.kind != "f":
            _no_predictor(predictor)
        planes = np.add.accumulate(rows.reshape(n, cols * size, channels), axis=1, dtype=np.uint8)
        joined = np.ascontiguousarray(planes.reshape(n, size, cols * channels).transpose(0, 2, 1))
        return joined.view(kind.newbyteorder(">")).reshape(n, cols, channels).astype(kind)
    return values.astype(kind) if predictor == 1 else _no_predictor(predictor)


def _no_predictor(predictor: int):
    raise ValueError(f"predictor {predictor} doesn't go with these samples")


def predicted(values: np.ndarray, predictor: int, order: str) -> bytes:
    """The bytes of (rows, columns, channels) after differencing."""
    n, cols, channels = values.shape
    if predictor == 2 and values.dtype.kind in "iu":
        values = np.concatenate([values[:, :1], np.diff(values, axis=1)], axis=1)
    elif predictor == 3 and values.dtype.kind == "f":
        size = values.dtype.itemsize
        planes = values.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(n, cols * channels, size).transpose(0, 2, 1).reshape(n, cols * size, channels)
        return np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).tobytes()
    elif predictor != 1:
        _no_predictor(predictor)
    return values.astype(values.dtype.newbyteorder(order)).tobytes()
