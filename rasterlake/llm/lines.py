"""Line dedup: range-partitioned line hashes, streamed in order, to keep bitmaps.

Each line with a key becomes a row (key hash, document, line number). The rows
are range-partitioned by hash and document and sorted within the partitions, so
all of a key's documents stand one after another, and a key of a third of all
rows spreads over as many partitions as it fills. A task streams its rows once:
runs that lie inside the partition are decided at once; a run cut by a partition
edge is decided by the sum of its parts' document counts, two rows a partition at
most. What returns is one compressed keep bitmap per document that loses a line.

Defined cases: null and empty texts are one empty line; a line that is empty
after stripping has no key and stays; a document's own repeats of a line count
as one document, and so do rows with equal id and text; an empty table gives an
empty result. The texts never enter the sort. A very long text is split whole by the
task that reads it; its lines are rows like any others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from rasterlake.llm.shared import staged

#: What ``[\x20\x09-\x0D]`` strips.
BLANK = b" \t\n\x0b\x0c\r"
MIN_DOCS = 10
DROP, OPEN, EDGE = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _keyed(docs: DataFrame, id_col: str, text_col: str, rest: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = [F.struct(*(F.col(c) for c in rest)).alias("rest")] if rest else []
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), *carried)


def _hash_lines(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            digests, owner, numbers, sizes = [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                lines = text.encode().split(b"\n")
                for number, line in enumerate(lines):
                    if key := line_key(line):
                        digests.append(xxhash.xxh3_128_digest(key))
                        owner.append(i)
                        numbers.append(number)
                sizes.append(len(lines))
            halves = np.frombuffer(b"".join(digests), dtype=">i8").reshape(-1, 2).astype(np.int64)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), part.column("doc_id").take(take), part.column("text_key").take(take), pa.array(numbers, pa.int32()), pa.array(sizes, pa.int32()).take(take)],
                names=["h1", "h2", "doc_id", "text_key", "line", "n_lines"],
            )


class _Run:
    """The run of one key that is being streamed."""

    def __init__(self, key, first: bool, min_docs: int):
        self.key, self.first, self.min_docs, self.n_docs, self.held = key, first, min_docs, 0, []

    def add(self, rows: pa.RecordBatch, n_docs: int) -> Iterator[pa.RecordBatch]:
        self.n_docs += n_docs
        self.held.append(rows)
        if self.n_docs >= self.min_docs:
            yield from (_tagged(x, DROP, self.n_docs) for x in self.held)
            self.held.clear()

    def close(self, cut: bool, last: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if cut:
            yield _tagged(last, EDGE, self.n_docs)
            yield from (_tagged(x, OPEN, self.n_docs) for x in self.held)


def _tagged(batch: pa.RecordBatch, kind: int, count: int) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, count, np.int64)), *batch.columns], names=["kind", "n_docs", *batch.schema.names])


def _stream_runs(min_docs: int):
    """Rows to drop, rows of cut runs that are still open, and the cut runs' document counts.

    Held back are the rows of one run while fewer than min_docs documents of it have come.
    """

    def stream(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, last_doc = None, None, None
        for batch in rows:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, text_key = (batch.column(c).to_numpy() for c in ("h1", "h2", "text_key"))
            doc = batch.column("doc_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
            new_key = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            new_doc = new_key.copy()
            new_doc[1:] |= (doc[1:] != doc[:-1]) | (text_key[1:] != text_key[:-1])
            cuts = np.append(np.flatnonzero(new_key), n)
            counts = np.add.reduceat(new_doc.astype(np.int64), cuts[:-1])
            key, first_doc = (h1[0], h2[0]), (batch.column("doc_id")[0].as_py(), text_key[0])
            if run is not None and run.key == key:
                counts[0] -= first_doc == last_doc
            else:
                if run is not None:
                    yield from run.close(run.first, last)
                run = _Run(key, run is None, min_docs)
            yield from run.add(batch.slice(0, cuts[1]), int(counts[0]))
            if len(counts) > 1:
                yield from run.close(run.first, batch.slice(cuts[1] - 1, 1))
                drop = np.repeat(counts >= min_docs, np.diff(cuts))
                drop[: cuts[1]] = drop[cuts[-2] :] = False
                yield _tagged(batch.filter(pa.array(drop)), DROP, min_docs)
                run = _Run((h1[-1], h2[-1]), False, min_docs)
                yield from run.add(batch.slice(cuts[-2], n - cuts[-2]), int(counts[-1]))
            last = batch.slice(n - 1, 1)
            last_doc = (batch.column("doc_id")[n - 1].as_py(), text_key[-1])
        if run is not None:
            yield from run.close(True, last)

    return stream


@F.pandas_udf(BinaryType())
def _bitmap(lines: pd.Series, n_lines: pd.Series) -> pd.Series:
    def pack(drop, n):
        keep = np.ones(n, dtype=bool)
        keep[np.asarray(drop)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([pack(d, n) for d, n in zip(lines, n_lines, strict=True)], dtype=object)


def kept_lines(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, keep) of each document that loses lines found in min_docs documents."""
    keyed = _keyed(docs, id_col, text_col)
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    row = f"h1 long, h2 long, doc_id {id_type}, text_key long, line int, n_lines int"
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = keyed.select("doc_id", "text_key", "text").mapInArrow(_hash_lines, row).repartitionByRange(n, "h1", "h2", "doc_id", "text_key").sortWithinPartitions("h1", "h2", "doc_id", "text_key", "line")
    found = staged(ordered.mapInArrow(_stream_runs(min_docs), f"kind int, n_docs long, {row}"), "line-runs")
    cut = found.filter(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n")).filter(F.col("n") >= min_docs)
    still = found.filter(F.col("kind") == OPEN).join(cut, ["h1", "h2"], "left_semi")
    where = ["doc_id", "text_key", "n_lines", "line"]
    drops = found.filter(F.col("kind") == DROP).select(*where).unionByName(still.select(*where))
    lists = drops.groupBy("doc_id", "text_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("line").alias("lines"))
    return lists.select("doc_id", "text_key", "n_lines", F.size("lines").cast("long").alias("n_dropped"), _bitmap("lines", "n_lines").alias("keep"))


def _apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = []
            for text, keep in zip(part.column("text").to_pylist(), part.column("keep").to_pylist(), strict=True):
                if keep is not None:
                    lines = text.split("\n")
                    text = "\n".join(x for x, k in zip(lines, kept_lines(keep, len(lines)), strict=True) if k)
                texts.append(text)
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, part.schema.field("text").type)).drop_columns(["keep"])


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", rest: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every document's text without the lines that its bitmap drops.

    ``rest`` names columns to carry along; they return in one struct, ``rest``.
    """
    keyed = _keyed(docs, id_col, text_col, rest)
    maps = keep_bitmaps(docs, min_docs, id_col, text_col).select("doc_id", "text_key", "n_dropped", "keep")
    n_lines = F.length("d.text") - F.length(F.replace("d.text", F.lit("\n"), F.lit(""))) + 1
    columns = ["d.doc_id", "d.text", n_lines.cast("long").alias("n_lines"), F.coalesce("b.n_dropped", F.lit(0)).cast("long").alias("n_dropped"), *(["d.rest"] if rest else []), "b.keep"]
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_key") == F.col("b.text_key"))
    joined = keyed.alias("d").join(maps.alias("b"), same, "left").select(*columns)
    return joined.mapInArrow(_apply, joined.drop("keep").schema)
