"""Benchmark decontamination: a prefix-filtered set join with exact verification.

An item's windows are sets of word shingles in order. The windows' shingles are
counted over all documents and ordered by rarity; a document that contains a
window contains its rarest shingle, so that one prefix token is what is joined
(for containment of a whole window, one token is the necessary prefix). A
document's occurrence of a prefix token gives the only place where the window
can stand; places before the first or beyond the last word fail the positional
and length bounds, and the rest are compared word by word.

The benchmark is taken in blocks of at most about ``BLOCK_WINDOWS`` distinct
windows; only a block's tokens and windows are broadcast, so that bound holds
however large the benchmark is. Passages that many documents share stay within
their documents: no pair of documents is ever formed.

Defined cases: a null, empty or word-free document has no words and isn't hit;
a word-free item has no window; items with equal windows are all reported; rows
with equal id and text get the same answer; an empty documents or benchmark
table gives an empty result or no hits; other columns are not read. A very long text is split in
blocks of whole words, and each occurrence carries only the words around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm import words as W
from rasterlake.llm.shared import signed, small, staged, text_only

WINDOW = 13
SHINGLE = 4
BLOCK_WINDOWS = 200_000


def _item_windows(window: int, shingle: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.batches(rows):
            starts, ends, owner = W.spans(data, offsets, W.ALNUM)
            hashes = W.hash_spans(data, starts, ends)
            lowered = data.tobytes().lower()
            terms = [lowered[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            first = W.row_starts(owner, batch.num_rows).tolist()
            out: dict[str, list] = {k: [] for k in ("item", "window", "terms", "shingles")}
            for i in range(batch.num_rows):
                a, b = first[i], first[i + 1]
                size = min(window, b - a)
                if not size:
                    continue
                k = min(shingle, size)
                grams = W.gram_hashes(hashes[a:b], owner[a:b], k)[0].view(np.int64)
                for at in range(b - a - size + 1):
                    text = terms[a + at : a + at + size]
                    out["item"].append(i)
                    out["window"].append(xxhash.xxh3_64_intdigest(" ".join(text)) - (1 << 63))
                    out["terms"].append(text)
                    out["shingles"].append(grams[at : at + size - k + 1].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(out["item"], pa.int64())), pa.array(out["window"], pa.int64()), pa.array(out["terms"], pa.list_(pa.string())), pa.array(out["shingles"], pa.list_(pa.int64()))],
                names=["item_id", "window", "terms", "shingles"],
            )

    return run


def _found(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in hashes, places in the sorted known) of the hashes that are known."""
    if not len(known) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    at = np.flatnonzero(known[place] == hashes)
    return at, place[at]


def _count_shingles(known: Broadcast, sizes: list[int]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        counts = np.zeros(len(table), dtype=np.int64)
        for _, data, offsets in W.batches(rows):
            starts, ends, owner = W.spans(data, offsets, W.ALNUM)
            hashes = W.hash_spans(data, starts, ends)
            for k in sizes:
                counts += np.bincount(_found(W.gram_hashes(hashes, owner, k)[0], table)[1], minlength=len(table))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([signed(table[at]), pa.array(counts[at])], names=["shingle", "n"])

    return run


def _candidates(known: Broadcast, sizes: list[int], reach: int):
    """Each document's word count and its prefix tokens with the words around them."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        kind = pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("around", pa.list_(pa.string()))]))
        for batch, data, offsets in W.batches(rows):
            starts, ends, owner = W.spans(data, offsets, W.ALNUM)
            hashes = W.hash_spans(data, starts, ends)
            first = W.row_starts(owner, batch.num_rows)
            lists: list[list] = [[] for _ in range(batch.num_rows)]
            lowered = None
            for k in sizes:
                grams, at = W.gram_hashes(hashes, owner, k)
                hit, place = _found(grams, table)
                for g, token in zip(at[hit].tolist(), table[place].view(np.int64).tolist(), strict=True):
                    lowered = lowered or data.tobytes().lower()
                    i = int(owner[g])
                    a, b = max(int(first[i]), g - reach), min(int(first[i + 1]), g + reach)
                    lists[i].append({"shingle": token, "at": g - int(first[i]), "first": a - int(first[i]), "around": [lowered[x:y].decode() for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(np.diff(first).astype(np.int64)), pa.array(lists, kind)], names=["doc_id", "text_key", "n_words", "tokens"])

    return run


def _known(tokens: DataFrame) -> np.ndarray:
    """The distinct shingles of one block of the benchmark, sorted; Arrow brings them to the driver as one array."""
    return np.sort(tokens.select("shingle").distinct().toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with word counts, occurrences of windows, items of each window)."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    windows = staged(items.mapInArrow(_item_windows(window, shingle), f"item_id {items.schema['item_id'].dataType.simpleString()}, window long, terms array<string>, shingles array<long>"), "windows")
    distinct = windows.dropDuplicates(["window"]).select("window", "terms", "shingles")
    n_blocks = max(1, -(-distinct.count() // block_windows))
    keyed = text_only(docs).withColumn("text_key", F.xxhash64("text"))
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    base, hits = None, None
    for block in range(n_blocks):
        part = distinct.filter(F.pmod("window", F.lit(n_blocks)) == block)
        tokens = part.select("window", F.size("terms").alias("size"), F.posexplode("shingles").alias("offset", "shingle"))
        sizes = sorted(r[0] for r in tokens.select(F.least("size", F.lit(shingle))).distinct().collect())
        shared = spark.sparkContext.broadcast(_known(tokens))
        rarity = keyed.select("text").mapInArrow(_count_shingles(shared, sizes), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        prefix = tokens.join(rarity, "shingle").groupBy("window").agg(F.count("*").alias("present"), F.min(F.struct("n", "shingle", "offset")).alias("rarest"), F.first("size").alias("size"))
        # a window lacking one of its shingles in every document is in none
        prefix = prefix.filter(F.col("present") == F.col("size") - F.least("size", F.lit(shingle)) + 1)
        chosen = staged(part.join(prefix, "window").select("window", "terms", "size", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset")), "prefixes")
        rare = spark.sparkContext.broadcast(_known(chosen))
        found = staged(keyed.mapInArrow(_candidates(rare, sizes, window), f"doc_id {id_type}, text_key long, n_words long, tokens array<struct<shingle:long,at:long,first:long,around:array<string>>>"), "candidates")
        base = base or found.select("doc_id", "text_key", "n_words")
        token = found.filter(F.size("tokens") > 0).select("doc_id", "text_key", "n_words", F.explode("tokens").alias("t")).select("doc_id", "text_key", "n_words", "t.*")
        start = F.col("at") - F.col("offset")
        placed = token.join(F.broadcast(chosen), "shingle").withColumn("start", start).filter((start >= F.col("first")) & (start >= 0) & (start + F.col("size") <= F.col("n_words")))
        exact = placed.filter(F.slice("around", (F.col("start") - F.col("first") + 1).cast("int"), F.col("size")) == F.col("terms"))
        exact = exact.select("doc_id", "text_key", "window", "start", "size")
        hits = exact if hits is None else hits.unionByName(exact)
    return base, hits, windows.select("window", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: its words, the words that windows cover, and the items found in it."""
    return _measured(docs, benchmark, **options).drop("text_key")


def _measured(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    base, hits, items = find_windows(docs, benchmark, **options)
    hits = staged(hits.distinct(), "hits")
    key = ["doc_id", "text_key"]
    covered = hits.select(*key, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("word")).distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    of = hits.select(*key, "window").distinct().join(items, "window").select(*key, F.col("item_id").cast("string").alias("item_id")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    h = covered.alias("c").join(of.alias("i"), F.col("c.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("c.text_key") == F.col("i.text_key"))).select("c.doc_id", "c.text_key", "n_hit", "items")
    n_hit, listed = F.coalesce("h.n_hit", F.lit(0)), F.coalesce("h.items", F.array().cast("array<string>"))
    return (
        base.alias("b")
        .join(h.alias("h"), F.col("b.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("b.text_key") == F.col("h.text_key")), "left")
        .select("b.doc_id", "b.text_key", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows, with all their columns, of documents that aren't contaminated; other texts of an id stay."""
    bad = staged(_measured(docs, benchmark, **options).filter("contaminated").select("doc_id", "text_key").distinct(), "contaminated")
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_key") == F.col("b.text_key"))
    return keyed.alias("d").join(small(bad, bad.count()).alias("b"), same, "left_anti").select("row.*")
