"""Substring dedup: content-defined chunking with a gear rolling hash.

A gear hash over the last ``REACH`` bytes cuts texts where it is the least of some
``WINDOW`` positions in a row, so cuts follow content, every passage has them at
bounded distances, and an insertion moves only the chunks around it. A cut depends on
the bytes near it, not on the chunks before. Chunks
are deduplicated by digest: the first document (by id) that holds a digest keeps
it, and later documents lose runs of consecutive shared chunks of at least
``MIN_RUN`` bytes; shorter coincidences stay. The chunks at the ends of a passage hold
what surrounds it, so a passage may be some 100 bytes longer than its run: the
bound is far below fifty words. Digests are counted with partial
aggregates, so a passage of a third of all documents is one row a task, and rows
of shared digests alone are joined back.

Defined cases: null and empty texts have no chunk; repeats inside one document
stay; rows with equal id are one document, so none loses text to itself; a null
id takes part as the first of all; an empty table gives an empty result; other
columns are not read. A very long text is hashed whole, as one block of its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm import words as W
from rasterlake.llm.shared import signed, text_only

MIN_CHUNK, MAX_CHUNK = 8, 1024
SPREAD = 32
REACH, WINDOW = 24, 80
MIN_RUN = 96
#: A chunk's place is one long, its start times this plus its size.
_PLACE = 2048
_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hashes of the 32 bytes up to each byte: h = 2 h + gear[byte], by doubling windows."""
    h = _GEAR[data]
    width = 1
    while width < 32:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by doubling windows."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def cuts(part: np.ndarray, follows: np.ndarray) -> list[int]:
    """Ends of chunks inside a text: the least of a window; of those crowded together, as in a repeated word, the first and then one in ``SPREAD`` bytes."""
    if len(part) < REACH + WINDOW:
        return []
    # the low bits come from the last REACH bytes; odd multiples keep them apart
    value = ((gear(part) & np.uint32((1 << REACH) - 1)) * np.uint32(0x9E3779B1)) >> np.uint32(1)
    value = np.where(follows, np.uint32(0xFFFFFFFF), value)[REACH - 1 :]
    window = _least(value, WINDOW)
    # the largest of the leasts of a position's windows is its own value where it is the least of one
    around = ~_least(~np.pad(window, WINDOW - 1), WINDOW)
    found = np.flatnonzero(around == value) + REACH
    kept, last, before = [], -SPREAD, -MIN_CHUNK
    for cut in found.tolist():
        if cut - before >= MIN_CHUNK or cut - last >= SPREAD:
            kept.append(cut)
            last = cut
        before = cut
    return kept


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the chunks of each row; cuts fall between code points."""
    starts, ends, rows = [], [], []
    follows = np.append((data[1:] & 0xC0) == 0x80, False) if len(data) else np.zeros(0, bool)
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a == b:
            continue
        part = data[a:b]
        at = 0
        for cut in [*cuts(part, follows[a:b]), b - a]:
            while cut - at > MAX_CHUNK:
                stop = at + MAX_CHUNK
                while follows[a + stop - 1]:
                    stop -= 1
                starts.append(a + at), ends.append(a + stop), rows.append(row)
                at = stop
            if cut > at:
                starts.append(a + at), ends.append(a + cut), rows.append(row)
                at = cut
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array(rows, np.int64)


def _chunks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in W.batches(rows):
        starts, ends, owner = chunk_bounds(data, offsets)
        take = pa.array(owner)
        columns = [signed(W.hash_spans(data, starts, ends, lower=False)), pa.array((starts - offsets[owner]) * _PLACE + ends - starts)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_key").take(take), *columns], names=["doc_id", "text_key", "digest", "place"])


def shared_runs(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, text_key, start, stop, first_doc, later) of shared chunks in runs of min_run bytes or more."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chunks = docs.mapInArrow(_chunks, f"doc_id {id_type}, text_key long, digest long, place long")
    key = F.struct("doc_id")
    # a digest tells chunks of different sizes apart
    first = chunks.groupBy("digest").agg(F.min(key).alias("first"), F.max(key).alias("last")).filter("NOT first <=> last").select("digest", F.col("first.doc_id").alias("first_doc"))
    held = chunks.join(first, "digest").withColumn("later", ~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    held = held.withColumns({"start": F.expr(f"place div {_PLACE}"), "size": F.col("place") % _PLACE})
    own = ["doc_id", "text_key", "later"]
    # chunks that follow each other start where the sizes before them end
    runs = held.withColumn("run", F.col("start") + F.col("size") - F.sum("size").over(Window.partitionBy(*own).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*own, "run")
    long_runs = runs.withColumn("bytes", F.sum("size").over(whole)).filter(F.col("bytes") >= min_run)
    return long_runs.select("doc_id", "text_key", "start", (F.col("start") + F.col("size")).alias("stop"), "first_doc", "later")


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("dropped").to_pylist(), strict=True):
                if spans:
                    raw, kept, stop = text.encode(), [], 0
                    for span in sorted(spans, key=lambda s: s["start"]):
                        kept.append(raw[stop : span["start"]])
                        stop = span["stop"]
                    text = b"".join([*kept, raw[stop:]]).decode()
                texts.append(text)
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def dedup_substrings(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_shared, n_dropped, dropped, first_docs) of every document.

    ``dropped`` are byte spans of the original text; ``first_docs`` keep what was dropped.
    """
    keyed = text_only(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    runs = shared_runs(keyed, min_run).distinct()
    later = F.col("later")
    found = runs.groupBy("doc_id", "text_key").agg(
        F.count("*").alias("n_shared"), F.count(F.when(later, 1)).alias("n_dropped"), F.collect_list(F.when(later, F.struct("start", "stop"))).alias("dropped"), F.array_sort(F.collect_set(F.when(later, F.col("first_doc")))).alias("first_docs")
    )
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_key") == F.col("r.text_key"))
    joined = keyed.alias("d").join(found.alias("r"), same, "left").select("d.doc_id", "d.text", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "dropped", "first_docs")
    return joined.mapInArrow(_cut, joined.schema)
