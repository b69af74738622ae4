"""Best-fit packing improved by swap-based local search.

Documents become token ids plus an end id; longer ones are cut into full pieces
with the remainder first. Full pieces are sequences already. The remainders are
dealt round robin into groups of about ``GROUP_PIECES``, so no key can make a
group large, and each group is packed in one task: best-fit decreasing first,
then a local search that empties underfull sequences. It takes the emptiest and
moves a piece to another underfull one, exchanges one piece for a smaller one
there, or two pieces for one, always increasing the squared fill, until a
round empties no sequence or their number has reached a lower bound. A group wastes less than one sequence beyond
that bound when its pieces allow it, a share that does not grow with the input.

The ids are those of ``tokenizers`` for the vocabulary file; tiktoken computes
them from the same vocabulary four times as fast, and texts that it can't take
(a special token's string, very long runs of blanks) go through ``tokenizers``.

Defined cases: a null or empty text is the end id alone; equal rows are packed
as often as they come; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.shared import staged, text_only

CAPACITY = 1024
END_ID = 2
GROUP_PIECES = 4096
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids of a byte-level vocabulary in its two public forms."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._json_path = json_path

    @functools.cached_property
    def _plain(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._json_path)

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL not in text:
            try:
                return self._fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its pattern engine gives up on very long runs of blanks
                pass
        return np.array(self._plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.cache
def encoder(name: str) -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the remainder first, then full ones."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _pieces(vocabulary: str, capacity: int, end_id: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, dealt = encoder(vocabulary).ids, TaskContext.get().partitionId() * 7919
        for batch in rows:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[tuple] = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.append(ids_of(text), end_id).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        out.append((i, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), dealt))
                        dealt += 1
                owner, *columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32", "dealt"])

    return run


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item indexes; each item goes to the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g: some bin has gap g
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = open_gaps >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_gap[gap - size].append(b)
        open_gaps |= 1 << (gap - size)
    return bins


def fewest_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound: of the tokens, and of pieces too long to share a bin with ones above each size."""
    best = -(-int(lengths.sum()) // capacity)
    half = lengths > capacity // 2
    for least in np.unique(lengths[~half]).tolist():
        alone = lengths > capacity - least
        large, small = half & ~alone, ~half & (lengths >= least)
        spare = int(large.sum()) * capacity - int(lengths[large].sum())
        best = max(best, int(alone.sum() + large.sum()) + max(0, -(-(int(lengths[small].sum()) - spare) // capacity)))
    return max(best, int(half.sum()))


class LocalSearch:
    """Pieces of underfull bins, moved and exchanged until bins empty.

    A round takes each underfull bin, the emptiest first, and applies the exchange
    of highest gain in squared fill as long as one gains ``capacity``. The search
    ends at the lower bound, or when a round has emptied no bin.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        fill = np.array([lengths[b].sum() for b in bins])
        self.full = [b for b, f in zip(bins, fill, strict=True) if f == capacity]
        underfull = [b for b, f in zip(bins, fill, strict=True) if f < capacity]
        self.capacity, self.fill = capacity, fill[fill < capacity]
        self.item = np.array([i for b in underfull for i in b], dtype=np.int64)
        self.size = lengths[self.item]
        self.bin = np.repeat(np.arange(len(underfull)), [len(b) for b in underfull])
        self.least = fewest_bins(lengths, capacity) - len(self.full)

    def run(self) -> list[list[int]]:
        used, emptied = len(self.fill), True
        while emptied and used > self.least:
            emptied = False
            for source in np.argsort(self.fill, kind="stable"):
                if not self.fill[source]:
                    continue
                while self.fill[source] and self._exchange(source):
                    pass
                if not self.fill[source]:
                    emptied, used = True, used - 1
                    if used <= self.least:
                        break
        order = np.argsort(self.bin, kind="stable")
        kept = np.split(self.item[order], np.flatnonzero(np.diff(self.bin[order])) + 1) if len(order) else []
        return self.full + [b.tolist() for b in kept]

    def _exchange(self, source: int) -> bool:
        own = np.flatnonzero(self.bin == source)
        offers = {int(self.size[k]): [k] for k in own}
        room = self.capacity - self.fill
        room[source] = 0
        room[self.fill == 0] = 0
        movable = [size for size in offers if size <= room.max(initial=0)]
        if movable:
            size = max(movable)
            return self._apply(source, int(np.argmin(np.where(room >= size, room, self.capacity + 1))), offers[size], [])
        for a, k in enumerate(own.tolist()):
            for other in own[:a].tolist():
                offers.setdefault(int(self.size[k] + self.size[other]), [k, other])
        space, (best, choice) = room[self.bin], (self.capacity - 1, None)
        candidates = np.flatnonzero(space > 0)
        size, space, fill = self.size[candidates], space[candidates], self.fill[self.bin[candidates]]
        for offered, give in offers.items():
            more = offered - size
            gain = np.where((more > 0) & (more <= space), 2 * more * (fill - self.fill[source] + more), 0)
            at = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[at] > best:
                best, choice = gain[at], (give, candidates[at])
        if choice is None:
            return False
        give, take = choice
        return self._apply(source, int(self.bin[take]), give, [take])

    def _apply(self, source: int, target: int, give: list[int], take: list[int]) -> bool:
        moved = int(self.size[give].sum()) - int(self.size[take].sum() if take else 0)
        self.bin[give] = target
        self.bin[take] = source
        self.fill[source] -= moved
        self.fill[target] += moved
        return True


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return LocalSearch(best_fit_decreasing(lengths, capacity), lengths, capacity).run()


def _pack_group(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["dealt"], ignore_index=True)
        lengths = pieces["length"].to_numpy()
        sequence, offset = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for number, items in enumerate(pack(lengths, capacity)):
            sequence[items] = number
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
        pieces["sequence_id"], pieces["offset"] = pieces["bin_group"] * (1 << 20) + sequence, offset
        return pieces[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    only = text_only(docs, id_col, text_col)
    head = f"doc_id {only.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    pieces = staged(only.mapInArrow(_pieces(vocabulary, capacity, end_id), f"{head}, dealt long"), "pieces")
    short = pieces.filter(F.col("length") < capacity)
    n_groups = max(1, -(-short.count() // group_pieces))
    dealt = short.withColumn("bin_group", F.pmod("dealt", F.lit(n_groups)))
    packed = dealt.groupBy("bin_group").applyInPandas(_pack_group(capacity), f"{head}, sequence_id long, offset long")
    full = pieces.filter(F.col("length") == capacity).drop("dealt").withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)
