"""Linear recurrences whose factors depend on the gap between rows.

A step ``v -> a v + b`` is an affine map, and affine maps compose, so rows needn't be
folded one by one. Rows are range-partitioned by key and place, however many there are
of a key. A task composes the maps of its partition by doubling; a key's first row sets
``v`` whatever came before, so each row's value is ``A v + B`` of the value at the
partition's first row, where only the key that was cut there has an ``A``. One row a
partition says what its first and last rows are and what map lies between; those are
chained, and what comes out of each is put into the rows after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.plans.stage import cut


def step(dt, change, tau: float, gap: float):
    """(a, b) of a row ``dt`` after the one before it: its rate is taken in by ``dt / tau``; a long gap starts again at 0."""
    safe = np.where(dt > 0, dt, 1.0)
    k = np.minimum(safe / tau, 1.0)
    a, b = np.where(dt > 0, 1 - k, 1.0), np.where(dt > 0, change / safe * k, 0.0)
    return np.where(dt > gap, 0.0, a), np.where(dt > gap, 0.0, b)


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps from the start to each row."""
    a, b, d = a.copy(), b.copy(), 1
    while d < len(a):
        b[d:], a[d:] = a[d:] * b[:-d] + b[d:], a[d:] * a[:-d]
        d *= 2
    return a, b


_NAMES = ["key", "tie", "part", "a", "b", "first_key", "first_at", "first_value", "last_at", "last_value"]
_ROW = "key long, tie long, part int, a double, b double, first_key long, first_at double, first_value double, last_at double, last_value double"


def _local(tau: float, gap: float):
    """Every row with its map from the partition's first row, then one row for the partition."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last = TaskContext.get().partitionId(), None, None
        for batch in rows:
            n = batch.num_rows
            if not n:
                continue
            key, tie, at, value = (batch.column(c).to_numpy() for c in ("key", "tie", "at", "value"))
            before = last or (key[0], at[0], value[0], 1.0, 0.0)
            dt, change = np.diff(at, prepend=before[1]), np.diff(value, prepend=before[2])
            a, b = step(dt, change, tau, gap)
            new = np.diff(key, prepend=before[0]) != 0
            a[new], b[new] = 0.0, 0.0
            if last is None:
                first, a[0], b[0] = (key[0], at[0], value[0]), 1.0, 0.0
            a[0], b[0] = a[0] * before[3], a[0] * before[4] + b[0]
            a, b = composed(a, b)
            last = (key[-1], at[-1], value[-1], a[-1], b[-1])
            none = [pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.float64()) for _ in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tie), pa.array(np.full(n, part, np.int32)), pa.array(a), pa.array(b), *none], names=_NAMES)
        if last is not None:
            edge = [last[0], None, part, last[3], last[4], *first, last[1], last[2]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(edge, kinds, strict=True)], names=_NAMES)

    return run


def _carried(tau: float, gap: float):
    """What each partition's first row starts from, partition after partition."""

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        out, end = [], None
        for e in edges.sort_values("part").itertuples():
            start = 0.0
            if end is not None and end.key == e.first_key:
                a, b = step(np.float64(e.first_at - end.last_at), e.first_value - end.last_value, tau, gap)
                start = float(a * value + b)
            value, end = e.a * start + e.b, e
            out.append((e.part, start))
        return pd.DataFrame(out, columns=["part", "start"])

    return run


def smoothed_rate(rows: DataFrame, key: str, at: str, tie: str, value: str, tau: float, gap: float) -> DataFrame:
    """(key, tie, rate): how fast ``value`` changes by ``at`` (both numbers) in each key, smoothed over ``tau``, 0 after a gap.

    Rows follow ``at``, then ``tie``. A row at its predecessor's place leaves the rate as it was. Rows
    without a key, place or value take no part.
    """
    kept = rows.select(F.col(key).cast("long").alias("key"), F.col(tie).cast("long").alias("tie"), F.col(at).cast("double").alias("at"), F.col(value).cast("double").alias("value")).dropna()
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = kept.repartitionByRange(n, "key", "at", "tie").sortWithinPartitions("key", "at", "tie")
    found = cut(ordered.mapInArrow(_local(tau, gap), _ROW))
    edges = found.filter("first_key IS NOT NULL")
    starts = edges.groupBy().applyInPandas(_carried(tau, gap), "part int, start double")
    within = found.filter("first_key IS NULL").join(F.broadcast(starts), "part")
    return within.select(F.col("key").cast(rows.schema[key].dataType).alias(key), F.col("tie").alias(tie), (F.col("a") * F.col("start") + F.col("b")).alias("rate"))
