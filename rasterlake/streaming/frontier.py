"""Lengths of sequences that are still being discovered, as a stateful stream.

Only the index equal to the known length extends it; later ones are dropped and
asked for again, and an end counts only at the frontier. State is one number a
media, whatever the sequence's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def advance(length: int, ended: bool, indexes: list[int], hits: list[bool]) -> tuple[int, bool]:
    """The known length after probes in order of arrival; a miss at the frontier is the end."""
    for index, hit in zip(indexes, hits, strict=True):
        if not ended and index == length:
            length, ended = (length + 1, False) if hit else (length, True)
    return length, ended


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    length, ended = state.get if state.exists else (0, False)
    for batch in batches:
        batch = batch.sort_values("probe")
        length, ended = advance(length, ended, batch["frame_idx"].tolist(), batch["hit"].tolist())
    state.update((length, ended))
    yield pd.DataFrame({"media_id": [key[0]], "length": [length], "at_end": [ended]})


def frontier(probes: DataFrame) -> DataFrame:
    """(media_id, length, at_end) after each batch of (media_id, probe, frame_idx, hit)."""
    return probes.groupBy("media_id").applyInPandasWithState(_update, "media_id string, length long, at_end boolean", "length long, ended boolean", "update", GroupStateTimeout.NoTimeout)
