"""Change detection on source files: signatures, debounce, generations.

A signature is a hash of length, time and 16 windows of 4 KiB, or of the whole
file up to 64 KiB. A change is reported once the signature has stayed the same
for the gap; each further change re-arms it, and a return to the baseline cancels
it. Reports carry a generation, so that results of older ones can be dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Sampled windows, their bytes, and the gap.
WINDOWS, WINDOW_BYTES, GAP_MS = 16, 4096, 250


def signed(files: DataFrame) -> DataFrame:
    """(path, modified, signature, bytes) of (path, modificationTime, length, content) rows."""
    step = F.greatest(F.lit(1), F.floor((F.col("length") - WINDOW_BYTES) / (WINDOWS - 1))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.substring(F.col("content"), k * step + 1, F.lit(WINDOW_BYTES)))
    sample = F.when(F.col("length") <= WINDOWS * WINDOW_BYTES, F.array("content")).otherwise(parts)
    return files.select("path", F.col("modificationTime").alias("modified"), F.xxhash64("length", "modificationTime", sample).alias("signature"), F.col("length").alias("bytes"))


def signatures(spark: SparkSession, path: str) -> DataFrame:
    return signed(spark.read.format("binaryFile").load(path))


def group_signature(files: DataFrame, group: str) -> DataFrame:
    """(group, signature, bytes) over the files of each group; a sum of hashes needs no order and no list."""
    return files.groupBy(group).agg(F.sum(F.xxhash64("path", "signature").cast("decimal(38,0)")).cast("string").alias("signature"), F.sum("bytes").alias("bytes"))


def step(state: tuple | None, signature: int) -> tuple[int, int | None, int]:
    """(baseline, pending, generation) after one signature; the first is the baseline."""
    if state is None:
        return signature, None, 0
    baseline, _, generation = state
    return baseline, None if signature == baseline else signature, generation


def _debounce(gap_ms: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            baseline, pending, generation = state.get
            state.update((pending, None, generation + 1))
            yield pd.DataFrame({"path": [key[0]], "generation": [generation + 1], "signature": [pending]})
            return
        now = state.get if state.exists else None
        for batch in batches:
            for signature in batch.sort_values("seq")["signature"].tolist():
                now = step(now, signature)
        state.update(now)
        if now[1] is not None:
            state.setTimeoutDuration(gap_ms)
        yield pd.DataFrame({"path": pd.Series([], dtype=str), "generation": pd.Series([], dtype="int64"), "signature": pd.Series([], dtype="int64")})

    return update


def debounced(changes: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """(path, generation, signature) of (path, seq, signature) rows, each after its gap."""
    return changes.groupBy("path").applyInPandasWithState(_debounce(gap_ms), "path string, generation long, signature long", "baseline long, pending long, generation long", "update", GroupStateTimeout.ProcessingTimeTimeout)
