"""Vectorised word spans and hashes over the UTF-8 buffers of Arrow columns.

Word classes here only ever exclude ASCII characters, so every byte above 0x7F
belongs to a word and the split can be done on bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; texts above it are hashed in blocks of whole words.
CHUNK_BYTES = 1 << 20
NEWLINE = 10

_rng = np.random.default_rng(20240611)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_U = np.uint64


def _class(excluded: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for lo, hi in excluded:
        table[lo : hi + 1] = False
    return table


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = _class([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on text whose A-Z are lower-cased.
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, CHUNK_BYTES + 1)
_INV = _powers(_BASE_INV, CHUNK_BYTES + 1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=column.offset + n + 1)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def batches(rows: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in chunks of bounded bytes."""
    for batch in rows:
        data, offsets = buffers(batch.column(text))
        for i, j in chunks(offsets, limit):
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of maximal runs of ``inside`` bytes; runs end with their row."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    is_in = np.zeros(n + 2, dtype=bool)
    is_in[1:-1] = inside[data]
    first = is_in[1:-1] & ~is_in[:-2]
    last = is_in[1:-1] & ~is_in[2:]
    edges = np.unique(offsets)
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] |= is_in[1:-1][edges]
    last[edges - 1] |= is_in[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal bytes hash alike wherever they stand."""
    values = _BYTE_VALUE[_LOWER] if lower else _BYTE_VALUE
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        size = int(ends[j - 1]) - base
        power, inverse = (_POW, _INV) if size <= CHUNK_BYTES else (_powers(_BASE, size + 1), _INV)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(values[data[base : base + size]] * power[:size], out=total[1:])
        at = starts[i:j] - base
        out[i:j] = (total[ends[i:j] - base] - total[at]) * inverse[at]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _STEP[63])


def gram_hashes(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of each run of n words within one row."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out += hashes[k : k + size] * _STEP[k]
    at = np.flatnonzero(rows[:size] == rows[n - 1 :])
    return mix(out[at] + _U(n)), at


def row_starts(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Index of each row's first word, and the number of words at the end."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte, and the total at the end."""
    total = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total
