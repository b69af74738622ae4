"""Stateful image operators over frames, as Arrow iterators.

An operator is created for a frame size, applied to frames of that size in place, and
closed. A task keeps a few instances of each by size, the least recently used going
first, and closes all of them when its rows end or fail. Operators run in order; one
that asks for a companion also gets the 8-bit form of what the ones before it left.
One that isn't there, or whose creation gives nothing, is passed over and named in the
row. Only frames of one 16-bit channel are worked on; others stay as they are.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Instances of an operator that a task keeps.
INSTANCES = 3


class LutAlpha:
    """Minimum and maximum stretched to the whole range; a flat frame stays."""

    def __init__(self, width: int, height: int):
        self.top = 65535.0

    def apply(self, data: np.ndarray) -> None:
        lo, hi = int(data.min()), int(data.max())
        if hi > lo:
            data[:] = np.floor((data.astype(np.float64) - lo) * self.top / (hi - lo)).astype(np.uint16)

    def close(self) -> None:
        """Nothing to free."""


class Details:
    """The place of a detail operator: leaves frames as they are."""

    def __init__(self, width: int, height: int):
        self.size = (width, height)

    def apply(self, data: np.ndarray, companion: np.ndarray) -> None:
        if companion.shape != data.shape:
            raise ValueError("the companion is of another size")

    def close(self) -> None:
        """Nothing to free."""


class EdgeLift:
    """A detail operator: adds the companion, weighed by how far a sample lies from the centre."""

    def __init__(self, width: int, height: int):
        y, x = np.mgrid[:height, :width]
        self.weight = np.abs(2 * x + 1 - width) + np.abs(2 * y + 1 - height)

    def apply(self, data: np.ndarray, companion: np.ndarray) -> None:
        data[:] = np.minimum(data + companion * self.weight, 65535)

    def close(self) -> None:
        self.weight = None


@dataclass(frozen=True)
class Step:
    """A place in the chain; without ``create`` the operator is absent."""

    name: str
    create: Callable[[int, int], object] | None
    companion: bool = False


#: The chain in its fixed order; replace a step's ``create`` to plug an operator in.
CHAIN = (Step("lut_alpha", LutAlpha), Step("details", Details, companion=True))


class Instances:
    """One task's instances of each step, by frame size."""

    def __init__(self, most: int = INSTANCES):
        self.most, self.kept = most, {}

    def of(self, step: Step, size: tuple[int, int]):
        own = self.kept.setdefault(step.name, OrderedDict())
        if size in own:
            own.move_to_end(size)
            return own[size]
        while len(own) >= self.most:
            own.popitem(last=False)[1].close()
        made = step.create(*size) if step.create else None
        if made is not None:
            own[size] = made
        return made

    def close(self) -> None:
        with ExitStack() as all_:
            for own in self.kept.values():
                for instance in own.values():
                    all_.callback(instance.close)
        self.kept.clear()


def run_chain(frame: np.ndarray, chain: tuple[Step, ...], instances: Instances) -> list[str]:
    """Works on a (height, width) frame in place; the names of what was passed over."""
    absent = []
    for step in chain:
        instance = instances.of(step, frame.shape[::-1])
        if instance is None:
            absent.append(step.name)
        elif step.companion:
            instance.apply(frame, (frame >> 8).astype(np.uint8))
        else:
            instance.apply(frame)
    return absent


def _run(chain: tuple[Step, ...], keys: list[str]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        instances = Instances()
        try:
            for batch in rows:
                w, h, channels, dtype = (batch.column(c).to_pylist() for c in ("w", "h", "channels", "dtype"))
                lists = batch.column("samples")
                at = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                absent = []
                for i in range(batch.num_rows):
                    part = flat[at[i] : at[i + 1]]
                    if channels[i] != 1 or dtype[i] != "uint16" or len(part) != (w[i] or 0) * (h[i] or 0) or not len(part):
                        absent.append([s.name for s in chain])
                        continue
                    frame = part.astype(np.uint16).reshape(h[i], w[i])
                    absent.append(run_chain(frame, chain, instances))
                    flat[at[i] : at[i + 1]] = frame.ravel()
                samples = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat), mask=lists.is_null())
                kept = [*keys, "w", "h", "channels", "dtype"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), samples, pa.array(absent, pa.list_(pa.string()))], names=[*kept, "samples", "absent"])
        finally:
            instances.close()

    return run


def apply_chain(frames: DataFrame, chain: tuple[Step, ...] = CHAIN, keys: tuple[str, ...] = ("media_id", "frame_idx")) -> DataFrame:
    """Frames (keys, w, h, channels, dtype, samples) after the chain, with the names of what was ``absent``; no shuffle."""
    rows = frames.select(*keys, "w", "h", "channels", "dtype", "samples").withColumn("samples", frames["samples"].cast("array<float>"))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_run(chain, list(keys)), f"{head}, absent array<string>")
