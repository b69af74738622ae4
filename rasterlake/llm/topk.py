"""Exact top-k search: block-at-a-time pruning over document ranges.

A vector's components, quantised, are the weights of signed terms: component j is
the terms ``+j`` and ``-j``. Vectors are put in order by their heaviest term, and
ranges of that order become groups of blocks. A block holds its forward index (the
weights of its ``BLOCK`` documents) and each term's maximum over them; the sum of a
query's weights times the maxima bounds every score in the block.

A query starts with a threshold: its k-th score within its own group. Batches of
queries meet directories of group maxima, and only the pairs whose bounds reach a
threshold go on. There each query takes the group's blocks by falling bound and
scores through their forward indexes until the next bound is below its k-th score.
What each group leaves is ranked by query at the end. Queries and vectors meet as
rows of batches and groups, shuffled by Spark; the driver sees none of them.

Scores are exact integers: products that fit 53 bits are summed by float64 matrix
products, larger ones as 64-bit integers; where a sum could leave 64 bits the task
fails and says so.

Defined cases: vectors that are null or hold null or non-finite components take no
part; an empty vector scores 0; vectors of other lengths are compared up to the
shorter one (missing components are 0). A row with a null id is a candidate, after
other ids of its score; rows that share a query's id are its own. Rows repeated under
another id are candidates as often as they come. Ties go to the smaller id. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.shared import staged

SCALE = 256
QUERY_STEP = 50
K = 5
BLOCK = 64
#: Bytes of weights in one group, queries in one batch, groups in one directory.
GROUP_BYTES, BATCH, DIRECTORY = 1 << 19, 1024, 1024
#: Below every score; its negative is still a 64-bit integer.
NO_SCORE = np.iinfo(np.int64).min + 1


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, weights) of the vectors that take part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    weights = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    return vectors.filter(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), weights.alias("weights"))


def narrow(weights: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    low, high = (int(weights.min()), int(weights.max())) if weights.size else (0, 0)
    return weights.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def stored(weights: np.ndarray) -> bytes:
    kept = narrow(weights)
    return bytes([kept.itemsize]) + kept.tobytes()


def loaded(data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"i{data[0]}", offset=1).reshape(rows, width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact as 64-bit integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not (len(a) and len(b) and width):
        return np.zeros((len(a), len(b)), np.int64)
    most = max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max()))) * width
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    raise ValueError("scores could leave the range of 64-bit integers")


def maxima(weights: np.ndarray) -> np.ndarray:
    """The largest weight of each signed term: of ``+j``, then of ``-j``; never below 0, as a document may lack a term."""
    return np.concatenate([np.maximum(weights.max(0), 0), np.maximum(-weights.min(0).astype(np.int64), 0)])


def bounds(queries: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """Summed term maxima: what no document with these maxima can score above."""
    half = tops.shape[1] // 2
    width = min(queries.shape[1], half)
    wide = queries[:, :width].astype(np.int64)
    return products(np.concatenate([np.maximum(wide, 0), np.maximum(-wide, 0)], axis=1), np.concatenate([tops[:, :width], tops[:, half : half + width]], axis=1))


class Best:
    """The k best (score, id) of each query so far; ids are positions in an ascending order of ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.full((n, k), NO_SCORE, np.int64)
        self.place = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    @property
    def threshold(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def take(self, rows: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        score = np.concatenate([self.score[rows], score], axis=1)
        place = np.concatenate([self.place[rows], np.broadcast_to(place, (len(rows), len(place)))], axis=1)
        first = np.lexsort((place, -score), axis=1)[:, : self.k]
        self.score[rows], self.place[rows] = np.take_along_axis(score, first, 1), np.take_along_axis(place, first, 1)


def search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """Each query's k best of a group; blocks by falling bound, in waves of growing length, until bounds fall below the k-th score.

    ``ids`` ascend as object order wants them: positions break ties.
    """
    best = Best(len(queries), k, floor)
    starts = range(0, len(weights), BLOCK)
    tops = np.stack([maxima(weights[s : s + BLOCK]) for s in starts])
    bound = bounds(queries, tops)
    order = np.argsort(-bound, axis=1, kind="stable")
    falling = np.take_along_axis(bound, order, 1)
    at, length = 0, 1
    while at < len(tops):
        wave = falling[:, at : at + length] >= best.threshold[:, None]
        if not wave.any():
            break
        who, which = np.nonzero(wave)
        block = order[:, at : at + length][who, which]
        by_block = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[by_block])) + 1
        for part in np.split(by_block, cuts):
            rows, b = who[part], block[part[0]]
            member = np.arange(b * BLOCK, min((b + 1) * BLOCK, len(weights)))
            score = products(queries[rows], weights[member])
            score[query_ids[rows][:, None] == ids[member]] = NO_SCORE
            best.take(rows, score, member)
        at, length = at + length, length * 2
    return best


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which are null; a null reads as 0 and equals no query's id through the mask."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


GROUP_ROW = "kind int, part long, width int, ids array<long>, weights binary, tops binary, floors array<long>"
GROUP, QUERIES = 0, 1
_GROUP_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("weights", pa.binary()), ("tops", pa.binary()), ("floors", pa.list_(pa.int64()))])


def _group_rows(part: int, ids: np.ndarray, null: np.ndarray, weights: np.ndarray, k: int, step: int) -> Iterator[dict]:
    by_id = np.lexsort((ids, null))
    ids, null, weights = ids[by_id], null[by_id], weights[by_id]
    width = weights.shape[1]
    tops = maxima(weights)[None, :] if width else np.zeros((1, 0), np.int64)
    yield {"kind": GROUP, "part": part, "width": width, "ids": [None if x else int(i) for i, x in zip(ids, null, strict=True)], "weights": stored(weights), "tops": stored(tops), "floors": None}
    asked = np.flatnonzero(~null & (ids % step == 0))
    if len(asked):
        score = products(weights[asked], weights)
        score[(ids[asked][:, None] == ids) & ~null] = NO_SCORE
        floors = np.sort(score, axis=1)[:, -k] if len(ids) >= k else np.full(len(asked), NO_SCORE)
        yield {"kind": QUERIES, "part": part, "width": width, "ids": ids[asked].tolist(), "weights": stored(weights[asked]), "tops": None, "floors": floors.tolist()}


def _grouped(k: int, step: int):
    """Runs of equal width, in their order, as groups of blocks and the queries among them."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, width = TaskContext.get().partitionId() << 32, [], None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal part, held
            if held:
                ids, null, weights = (np.concatenate(x) for x in zip(*held, strict=True))
                held, part = [], part + 1
                yield pa.RecordBatch.from_pylist(list(_group_rows(part, ids, null, weights, k, step)), _GROUP_SCHEMA)

        for batch in rows:
            lists = batch.column("weights")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))
            ids, null = _ids(batch.column("vec_id"))
            for run_ in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(sizes)) + 1) if len(sizes) else []:
                if width != sizes[run_[0]]:
                    yield from close()
                    width = int(sizes[run_[0]])
                most = max(BLOCK, GROUP_BYTES // (2 * max(width, 1)) // BLOCK * BLOCK)
                while len(run_):
                    take, run_ = np.split(run_, [most - sum(len(x[0]) for x in held)])
                    held.append((ids[take], null[take], flat[at[take[0]] : at[take[-1] + 1]].reshape(len(take), width)))
                    if sum(len(x[0]) for x in held) == most:
                        yield from close()
        yield from close()

    return run


def _packed(most: int):
    """Rows of queries, or of group maxima, gathered up to ``most`` a row as long as their width stays."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId() << 32, []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal part, held
            if held:
                width = held[0]["width"]
                table = np.concatenate([loaded(r["data"], len(r["ids"]), width) for r in held])
                row = {"part": part, "width": width, "ids": [i for r in held for i in r["ids"]], "data": stored(table), "floors": [f for r in held for f in r["floors"]]}
                held, part = [], part + 1
                yield pa.RecordBatch.from_pylist([row], _PACKED_SCHEMA)

        for batch in rows:
            for r in batch.to_pylist():
                if held and (held[0]["width"] != r["width"] or sum(len(x["ids"]) for x in held) + len(r["ids"]) > most):
                    yield from close()
                held.append(r)
        yield from close()

    return run


PACKED_ROW = "part long, width int, ids array<long>, data binary, floors array<long>"
_PACKED_SCHEMA = pa.schema([("part", pa.int64()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("data", pa.binary()), ("floors", pa.list_(pa.int64()))])


def _reached(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a batch and a group in which some query's bound reaches its threshold."""
    for batch in rows:
        for r in batch.to_pylist():
            queries = loaded(r["data"], len(r["floors"]), r["width"])
            tops = loaded(r["tops"], len(r["groups"]), r["tops_width"])
            hit = np.flatnonzero((bounds(queries, tops) >= np.array(r["floors"], np.int64)[:, None]).any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), r["batch"], np.int64)), pa.array(np.array(r["groups"], np.int64)[hit])], names=["batch", "group"])


def _searched(k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in batch.to_pylist():
                asked, floors = np.array(r["query_ids"], np.int64), np.array(r["floors"], np.int64)
                queries = loaded(r["queries"], len(asked), r["width"])
                ids = pa.array(r["ids"], pa.int64())
                weights = loaded(r["weights"], len(ids), r["group_width"])
                known, null = _ids(ids)
                best = search(queries, asked, floors, weights, np.where(null, np.iinfo(np.int64).min, known), k)
                who, rank = np.nonzero((best.score > NO_SCORE) & (best.score >= floors[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(asked[who]), ids.take(pa.array(best.place[who, rank])), pa.array(best.score[who, rank])], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product with each row whose id ``step`` divides."""
    rows = quantised(vectors, scale, id_col, vector_col)
    size = F.transform("weights", lambda x: F.abs(x))
    heaviest = F.array_position(size, F.array_max(size)).cast("int")
    rows = rows.withColumns({"width": F.size("weights"), "lead": heaviest}).withColumn("lead_weight", F.element_at("weights", F.nullif("lead", F.lit(0))))
    order = ["width", "lead", "lead_weight", "vec_id"]
    n = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranges = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("vec_id", "weights")
    kept = staged(ranges.mapInArrow(_grouped(k, step), GROUP_ROW), "vector-groups")

    queries = kept.filter(F.col("kind") == QUERIES).select("part", "width", "ids", F.col("weights").alias("data"), "floors")
    batches = staged(queries.mapInArrow(_packed(BATCH), PACKED_ROW), "query-batches")
    tops = kept.filter(F.col("kind") == GROUP).select("part", (F.col("width") * 2).cast("int").alias("width"), F.array("part").alias("ids"), F.col("tops").alias("data"), F.array(F.lit(0).cast("long")).alias("floors"))
    directories = staged(tops.mapInArrow(_packed(DIRECTORY), PACKED_ROW), "directories")
    lane = directories.select("part", (F.row_number().over(Window.orderBy("part")) - 1).alias("lane"))
    lanes = batches.select(F.col("part").alias("batch"), "width", "data", "floors", F.explode(F.sequence(F.lit(0), F.lit(max(directories.count() - 1, 0)))).alias("lane"))
    met = lanes.join(lane, "lane").join(directories.select("part", F.col("width").alias("tops_width"), F.col("ids").alias("groups"), F.col("data").alias("tops")), "part")
    pairs = met.mapInArrow(_reached, "batch long, group long")
    payload = kept.filter(F.col("kind") == GROUP).select(F.col("part").alias("group"), F.col("width").alias("group_width"), "ids", "weights")
    asked = batches.select(F.col("part").alias("batch"), "width", F.col("ids").alias("query_ids"), F.col("data").alias("queries"), "floors")
    found = pairs.join(payload, "group").join(asked, "batch").mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
