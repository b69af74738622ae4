"""Quality rules: compression bands.

Zstandard ratios (compressed bytes / bytes) of the whole document and of its
fixed chunks are held against limits for their length. A ratio below the band
means repetitive text, one above it incompressible text. A document is kept if
its whole-text ratio is inside its band and at most half of its bytes lie in
chunks outside theirs.

Defined cases: a null or empty text has no words and fails the base rule; texts
too short to compress (under the first limit) are in band; equal rows get equal
verdicts; an empty table gives an empty result; columns besides id and text are
not read. A very long text is one chunk of its own, compressed whole in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from rasterlake.llm import words as W
from rasterlake.llm.shared import per_row, text_only

#: (bytes from, lowest ratio, highest ratio). Short frames carry headers, long texts have more to repeat.
BANDS = ((0, 0.0, 9.9), (128, 0.35, 0.97), (256, 0.32, 0.88), (512, 0.29, 0.82), (1024, 0.26, 0.76), (4096, 0.22, 0.70), (16384, 0.18, 0.68), (131072, 0.12, 0.66))
CHUNK = 4096
LEVEL = 3
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"

SCHEMA_TAIL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, n_chunks long, chunk_bytes_out long"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[W.NEWLINE] = False


def in_band(n_bytes: int, ratio: float, bands=BANDS) -> bool:
    _, low, high = next(b for b in reversed(bands) if n_bytes >= b[0])
    return low <= ratio <= high


def compression(raw: bytes, compress, chunk: int = CHUNK) -> tuple[float, int, int, bool]:
    """(ratio of the whole, chunks, bytes of chunks out of band, verdict)."""
    n = len(raw)
    if not n:
        return 1.0, 0, 0, True
    ratio = len(compress(raw)) / n
    if n <= chunk:
        ok = in_band(n, ratio)
        return ratio, 1, 0 if ok else n, ok
    out = 0
    for at in range(0, n, chunk):
        part = raw[at : at + chunk]
        out += 0 if in_band(len(part), len(compress(part)) / len(part)) else len(part)
    return ratio, -(-n // chunk), out, in_band(n, ratio) and 2 * out <= n


def _keyed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return W.mix(hashes + (rows.astype(np.uint64) + W._U(1)) * W._STEP[40])


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of a chunk."""
    n = len(offsets) - 1
    starts, ends, rows = W.spans(data, offsets, W.NOT_SPACE)
    points = W.code_points(data)
    symbols = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_IS_SYMBOL[data], out=symbols[1:])

    l_starts, l_ends, l_rows = W.spans(data, offsets, _NOT_NEWLINE)
    first_word = np.searchsorted(starts, l_starts)
    has_word = np.append(starts, len(data) + 1)[first_word] < l_ends
    l_rows = l_rows[has_word]
    keys = _keyed(W.hash_spans(data, l_starts[has_word], l_ends[has_word], lower=False), l_rows)
    distinct_rows = l_rows[np.unique(keys, return_index=True)[1]]

    grams, at = W.gram_hashes(W.hash_spans(data, starts, ends, lower=False), rows, REPEAT_WINDOW)
    _, inverse, counts = np.unique(_keyed(grams, rows[at]), return_inverse=True, return_counts=True)
    twice = at[counts[inverse] > 1]
    cover = np.zeros(len(starts) + REPEAT_WINDOW + 1, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + REPEAT_WINDOW, -1)
    return {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": per_row(points[ends] - points[starts], rows, n),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(l_rows, minlength=n) - np.bincount(distinct_rows, minlength=n),
        "n_repeat_words": per_row((np.cumsum(cover)[: len(starts)] > 0).astype(np.int64), rows, n),
    }


def _verdicts(data: np.ndarray, offsets: np.ndarray, compress) -> tuple[dict[str, np.ndarray], np.ndarray, list[tuple]]:
    """(counts, base failures, compression figures) of the rows of a chunk."""
    counts = base_counts(data, offsets)
    failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
    raw = data.tobytes()
    return counts, failed, [compression(raw[offsets[i] : offsets[i + 1]], compress) for i in range(len(offsets) - 1)]


def _score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch, data, offsets in W.batches(rows):
        counts, failed, verdicts = _verdicts(data, offsets, compress)
        ratio, chunks, out, ok = zip(*verdicts, strict=True)
        columns = [pa.array(v.astype(np.int64)) for v in counts.values()]
        columns += [pa.array(failed), pa.array(~failed & np.array(ok)), pa.array(ratio, pa.float64()), pa.array(chunks, pa.int64()), pa.array(out, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *counts, "base_failed", "kept", "zstd_ratio", "n_chunks", "chunk_bytes_out"])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, ratios and verdict. Narrow: no shuffle."""
    only = text_only(docs, id_col, text_col)
    return only.mapInArrow(_score, f"doc_id {only.schema['doc_id'].dataType.simpleString()}, {SCHEMA_TAIL}")


def _filter(text_col: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch, data, offsets in W.batches(rows, text_col):
            _, failed, verdicts = _verdicts(data, offsets, compress)
            yield batch.filter(pa.array(~failed & np.array([v[-1] for v in verdicts], dtype=bool)))

    return run


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose verdict is kept."""
    return docs.mapInArrow(_filter(text_col), docs.schema)
