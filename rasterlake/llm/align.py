"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Both tokenizers encode a document; running sums of token lengths are the byte
offsets where tokens end, offsets found on both sides cut the document into groups,
and every A token of a group is linked to every B token of it. Texts of some
megabytes are handled at once as one array: ``cumsum`` for the ends, ``intersect1d``
for common cuts, ``searchsorted`` for group labels, ``repeat`` for the links.

An id pair's count is the number of documents that hold it. A document's distinct
pairs go to the shared folder packed by hash block, against the pairs of their slice
of documents, with the slice's counts beside them. Those counts are summed by pair
and salt, then by pair; each A id's highest is found; and the counted pairs of a block
stream past the packed documents of that block, salted again, so that a task holds
one block of counted pairs and one batch of documents. A pair that a third of all
documents hold costs one row a slice.

Defined cases: texts that are null, empty, or that a tokenizer changes have no tokens;
rows with equal ids or texts are documents of their own; ties for an A id's highest
count are all best; an empty table gives an empty result; other columns are not read.
A very long text is one slice, encoded whole by one task. A group of many tokens is
linked by its distinct ids and their numbers, so it takes no more than its distinct pairs.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.shared import staged, text_only

BYTES_VOCABULARY, PIECES_VOCABULARY = "byte_bpe_50k", "piece_bpe_32k"
#: Text that is aligned at once, unless one document is longer.
SLICE_BYTES = 2 << 20
#: Hash blocks of id pairs; a block of all pairs there can be would be 50 million.
BLOCKS = 32
#: An odd number below 2**31, so that its products with codes fit a long.
MULTIPLIER = 1640531527
#: Above so many links a group is reduced to its distinct ids first.
CROWDED = 256


class Bytes:
    """Byte-level ids of texts as they stand: special tokens' strings are plain text."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._json_path = public_tokenizers.path(f"{name}.json")
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    @functools.cached_property
    def _plain(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self._json_path)
        found.encode_special_tokens = True
        return found

    def ids(self, text: str) -> np.ndarray:
        try:
            return self._fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except ValueError:  # its pattern engine gives up on very long runs of blanks
            return np.array(self._plain.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """Pieces with byte fallback; each stands for the bytes that it covers."""

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
        self.table = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self._model.id_to_piece(i)) for i in range(self._model.get_piece_size()))]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self._model.encode(texts, num_threads=1)]


@functools.cache
def vocabularies(a: str, b: str) -> tuple[Bytes, Pieces]:
    return Bytes(a), Pieces(b)


@functools.cache
def _lengths(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(t) for t in v.table], np.int64) for v in vocabularies(a, b))


@functools.cache
def _written(a: str, b: str) -> list[str]:
    """Each id with the sign that follows it: A ids with ``,`` then with ``|``, B ids with ``,`` then with ``;``."""
    na, nb = (len(v.table) for v in vocabularies(a, b))
    return [f"{i}{sign}" for n, signs in ((na, ",|"), (nb, ",;")) for sign in signs for i in range(n)]


def tokens(text: str, a: str = BYTES_VOCABULARY, b: str = PIECES_VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(A ids, B ids) of one text; empty if its tokens' bytes aren't a space and the text."""
    return _tokens([text], a, b)[0]


def _tokens(texts: list[str], a: str, b: str) -> list[tuple[np.ndarray, np.ndarray]]:
    bytes_, pieces = vocabularies(a, b)
    none, out = np.zeros(0, np.int64), []
    for text, of_b in zip(texts, pieces.batch(texts), strict=True):
        raw = f" {text}".encode()
        of_a = bytes_.ids(f" {text}") if text and b"".join(map(pieces.table.__getitem__, of_b.tolist())) == raw else none
        whole = len(of_a) and b"".join(map(bytes_.table.__getitem__, of_a.tolist())) == raw
        out.append((of_a, of_b) if whole else (none, none))
    return out


class Alignment:
    """The documents of a slice that have tokens, end to end: groups by number, documents by place."""

    def __init__(self, of_a: list[np.ndarray], of_b: list[np.ndarray], len_a: np.ndarray, len_b: np.ndarray):
        self.a, self.b = np.concatenate(of_a), np.concatenate(of_b)
        ends_a, ends_b = np.cumsum(len_a[self.a]), np.cumsum(len_b[self.b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        self.size_a, self.size_b = (np.bincount(g, minlength=len(cuts)) for g in (self.group_a, self.group_b))
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (of_a, of_b))
        self.doc = np.searchsorted(ends_a[np.cumsum(self.n_a) - 1], cuts)
        self.n_groups = np.bincount(self.doc, minlength=len(of_a))
        self.links = self.size_a * self.size_b
        self.n_links = np.add.reduceat(self.links, np.cumsum(self.n_groups) - self.n_groups)

    def texts(self, written: list[str], na: int, nb: int) -> Iterator[str]:
        """Each document's groups written out, A and B ids interleaved by their places."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (self.group_a, self.group_b))
        before_b, before_a = np.cumsum(self.size_b) - self.size_b, np.cumsum(self.size_a)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + before_b[self.group_a]] = self.a + na * last_a
        order[np.arange(len(self.b)) + before_a[self.group_b]] = self.b + 2 * na + nb * last_b
        at = 0
        for n in (self.n_a + self.n_b).tolist():
            yield "".join(map(written.__getitem__, order[at : at + n].tolist()))[:-1]
            at += n

    def pairs(self, nb: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair code, links) of the distinct pairs of each document, in order; a code is A id times nb plus B id."""
        first_a, first_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        plain = np.flatnonzero(self.links <= CROWDED)
        n = self.links[plain]
        group = np.repeat(plain, n)
        place = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        code = self.a[first_a[group] + place // self.size_b[group]] * nb + self.b[first_b[group] + place % self.size_b[group]]
        key, times = np.unique(self.doc[group] << 32 | code, return_counts=True)
        if crowded := np.flatnonzero(self.links > CROWDED).tolist():
            keys, number = [key], [times]
            for g in crowded:
                ids_a, times_a = np.unique(self.a[first_a[g] : first_a[g] + self.size_a[g]], return_counts=True)
                ids_b, times_b = np.unique(self.b[first_b[g] : first_b[g] + self.size_b[g]], return_counts=True)
                keys.append((self.doc[g] << 32 | ids_a[:, None] * nb + ids_b).ravel())
                number.append(np.outer(times_a, times_b).ravel())
            all_, number = np.concatenate(keys), np.concatenate(number)
            order = np.argsort(all_, kind="stable")
            key, starts = np.unique(all_[order], return_index=True)
            times = np.add.reduceat(number[order], starts)
        return key >> 32, key & 0xFFFFFFFF, times


def block_of(code):
    """The top five of the low 32 bits of a multiple: of an array, or of a column."""
    if isinstance(code, np.ndarray):
        return code * MULTIPLIER >> 27 & BLOCKS - 1
    return F.shiftright(code * MULTIPLIER, 27).bitwiseAND(BLOCKS - 1).cast("int")


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in the smallest type that holds them, compressed."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    return kind.char.encode() + zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), data[:1].decode()).astype(np.int64)


def _gaps(sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Rising indexes of each document as steps from the one before, its first from 0."""
    gaps = np.diff(index, prepend=0)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    gaps[starts] = index[starts]
    return gaps


def _rising(sizes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    total = np.cumsum(gaps)
    starts = np.cumsum(sizes) - sizes
    before = np.append(0, total)[starts[sizes > 0]]
    return total - np.repeat(before, sizes[sizes > 0])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``SLICE_BYTES`` of text together."""
    sizes, start, held = pc.binary_length(batch.column("text")).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


_DOC = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_PAIRS = [("block", pa.int32()), ("codes", pa.binary()), ("holders", pa.binary()), ("sizes", pa.binary()), ("index", pa.binary()), ("times", pa.binary())]
_ROW = "key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block int, codes binary, holders binary, sizes binary, index binary, times binary"


def _block_rows(doc: np.ndarray, code: np.ndarray, times: np.ndarray, n_docs: int) -> Iterator[tuple]:
    """Per block: distinct codes and how many documents hold each, each document's number of them, which they are, and their links."""
    block = block_of(code)
    by_block = np.argsort(block.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(block, minlength=BLOCKS))
    for b, take in enumerate(np.split(by_block, ends[:-1])):
        if len(take):
            codes, index = np.unique(code[take], return_inverse=True)
            sizes = np.bincount(doc[take], minlength=n_docs)
            yield b, *map(pack, (np.diff(codes, prepend=0), np.bincount(index), sizes, _gaps(sizes, index), times[take]))


def _align(a: str, b: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, (len_a, len_b), written = TaskContext.get().partitionId() << 40, _lengths(a, b), _written(a, b)
        for batch in rows:
            for part in _slices(batch):
                n = part.num_rows
                ids = _tokens(part.column("text").to_pylist(), a, b)
                whole = np.flatnonzero([len(x) > 0 for x, _ in ids])
                counts, digests, blocks = np.zeros((4, n), np.int64), [""] * n, []
                if len(whole):
                    found = Alignment([ids[i][0] for i in whole], [ids[i][1] for i in whole], len_a, len_b)
                    counts[:, whole] = found.n_a, found.n_b, found.n_groups, found.n_links
                    for i, text in zip(whole.tolist(), found.texts(written, len(len_a), len(len_b)), strict=True):
                        digests[i] = hashlib.sha256(text.encode()).hexdigest()
                    doc, code, times = found.pairs(len(len_b))
                    blocks = list(_block_rows(whole[doc], code, times, n))
                m = len(blocks)
                columns = [part.column("doc_id"), pa.array(np.arange(key, key + n)), *map(pa.array, counts), pa.array(digests, pa.string())]
                columns = [pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in columns]
                columns[1] = pa.concat_arrays([columns[1].slice(0, n), pa.array(np.full(m, key, np.int64))])
                made = list(zip(*blocks, strict=True)) or [()] * len(_PAIRS)
                columns += [pa.concat_arrays([pa.nulls(n, kind), pa.array(values, kind)]) for (_, kind), values in zip(_PAIRS, made, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", *(name for name, _ in _DOC), *(name for name, _ in _PAIRS)])
                key += n

    return run


def _slice_counts(salts: int, nb: int):
    """Pairs and how many documents of a batch's slices hold them, one salt a task."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % salts
        for batch in rows:
            if batch.num_rows:
                codes = np.concatenate([np.cumsum(unpack(x)) for x in batch.column("codes").to_pylist()])
                holders = np.concatenate([unpack(x) for x in batch.column("holders").to_pylist()])
                order = np.argsort(codes, kind="stable")
                code, starts = np.unique(codes[order], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(code // nb), pa.array(code % nb), pa.array(np.full(len(code), salt, np.int32)), pa.array(np.add.reduceat(holders[order], starts))], names=["a", "b", "salt", "n"])

    return run


_SUMS = ["key", "n_best", "count_sum"]


def _document_sums(table: tuple[np.ndarray, ...], key: int, packed: list[bytes]) -> pa.RecordBatch:
    """Of each document of a slice, over its links in this block: how many are best, and the sum of their counts."""
    codes, sizes, index, times = map(unpack, packed)
    known, n, best = table
    place = np.searchsorted(known, np.cumsum(codes))[_rising(sizes, index)]
    has = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[has]
    return pa.RecordBatch.from_arrays([pa.array(key + has), *(pa.array(np.add.reduceat(times * x[place], starts)) for x in (best, n))], names=_SUMS)


def _look_up(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by block, salt and kind: a block's counted pairs come first and are held; documents' pairs stream past them."""
    at, held, table = None, [], None
    for batch in rows:
        block, salt = (batch.column(c).to_numpy() for c in ("block", "salt"))
        counted = batch.column("code").is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(salt) != 0) | (counted[1:] != counted[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if lo < hi and (block[lo], salt[lo]) != at:
                at, held, table = (block[lo], salt[lo]), [], None
            part = batch.slice(lo, hi - lo)
            if lo < hi and counted[lo]:
                held.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n", "best")])
            elif lo < hi:
                if table is None:
                    code, n, best = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(code)
                    table, held = (code[order], n[order], best[order].astype(np.int64)), []
                for key, *packed in zip(*(part.column(c).to_pylist() for c in ("key", "codes", "sizes", "index", "times")), strict=True):
                    yield _document_sums(table, key, packed)


def pair_counts(kept: DataFrame, salts: int, nb: int) -> DataFrame:
    """(a, b, n, best): in how many documents an id pair is linked, and whether no pair of its A id is in more."""
    by_salt = kept.filter("block IS NOT NULL").select("codes", "holders").mapInArrow(_slice_counts(salts, nb), "a long, b long, salt int, n long").groupBy("a", "b", "salt").agg(F.sum("n").alias("n"))
    counts = by_salt.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def aligned(docs: DataFrame, a: str = BYTES_VOCABULARY, b: str = PIECES_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): each document's tokens, groups and links and what its pairs count; each id pair's count."""
    spark = docs.sparkSession
    nb = len(vocabularies(a, b)[1].table)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    salts = -(-partitions // BLOCKS)
    texts = text_only(docs, id_col, text_col)
    kept = staged(texts.mapInArrow(_align(a, b), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {_ROW}"), "aligned")
    counts = staged(pair_counts(kept, salts, nb), "pair-counts")


    code = F.col("a") * nb + F.col("b")
    table = counts.select(code.alias("code"), "n", "best").withColumn("block", block_of(F.col("code"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    packed = kept.filter("block IS NOT NULL").select("key", "block", "codes", "sizes", "index", "times").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    both = table.unionByName(packed, allowMissingColumns=True).withColumn("documents", F.col("code").isNull())
    streamed = both.repartition(partitions, "block", "salt").sortWithinPartitions("block", "salt", "documents")
    sums = streamed.mapInArrow(_look_up, "key long, n_best long, count_sum long").groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    documents = kept.filter("block IS NULL").select("key", "doc_id", *(name for name, _ in _DOC)).join(sums, "key", "left")
    return documents.drop("key").fillna(0, ["n_best", "count_sum"]), counts
