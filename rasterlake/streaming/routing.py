"""Results of decoding, routed as they arrive: frames, pages that exist, ends, errors.

A media is a run of files whose lengths nobody knows yet. Probes of (file, page) come
back in any order. The frontier takes the next page of the current file, an end at the
frontier rolls on to the next file, and one of the last file ends the media; so each page
gets its place on the media's timeline once its predecessors are known. What is ahead of
the frontier waits in the state, as it came and without its pixels; what comes twice, or
again after the frontier has passed, is a repeat. Errors extend nothing and go out at once.

``Sinks`` writes the routes of a micro-batch under its number, so a batch that is replayed
replaces what it wrote, and each result appears once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROUTES = ("frame", "exists", "end", "error", "repeat")
PROBE = ("media_id", "probe", "file", "page", "kind", "files")
ROUTED = "media_id long, probe long, file int, page int, route string, frame_idx long"
STATE = "file int, page int, length long, ended boolean, ahead_probe array<long>, ahead_file array<int>, ahead_page array<int>, ahead_kind array<string>"


class Frontier:
    """How far a media's timeline is known, and the probes that wait ahead of it."""

    def __init__(self, file: int = 0, page: int = 0, length: int = 0, ended: bool = False, ahead: list[tuple] = ()):
        self.file, self.page, self.length, self.ended = file, page, length, ended
        self.ahead = {(f, p): (probe, kind) for probe, f, p, kind in ahead}

    def take(self, probe: int, file: int, page: int, kind: str, files: int) -> Iterator[tuple]:
        """(probe, file, page, route, frame_idx) of this probe, and of those that it lets through."""
        if kind == "error":
            yield probe, file, page, "error", None
            return
        if self.ended or (file, page) < (self.file, self.page) or (file, page) in self.ahead or file >= files:
            yield probe, file, page, "repeat", None
            return
        self.ahead[file, page] = (probe, kind)
        while not self.ended and (self.file, self.page) in self.ahead:
            at = self.file, self.page
            found, route = self.ahead.pop(at)
            yield found, *at, route, None if route == "end" else self.length
            if route == "end":
                self.file, self.page = self.file + 1, 0
                self.ended = self.file >= files
            else:
                self.page, self.length = self.page + 1, self.length + 1

    def state(self) -> tuple:
        waiting = [(probe, f, p, kind) for (f, p), (probe, kind) in sorted(self.ahead.items())] if not self.ended else []
        return (self.file, self.page, self.length, self.ended, *([w[k] for w in waiting] for k in range(4)))


def _route(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    file, page, length, ended, *waiting = state.get if state.exists else (0, 0, 0, False, [], [], [], [])
    frontier = Frontier(file, page, length, ended, list(zip(*waiting, strict=True)))
    for batch in batches:
        rows = [r for b in batch.sort_values("probe")[list(PROBE[1:])].itertuples(index=False) for r in frontier.take(*b)]
        out = pd.DataFrame(rows, columns=["probe", "file", "page", "route", "frame_idx"])
        out.insert(0, "media_id", key[0])
        yield out.astype({"frame_idx": "Int64"})
    state.update(frontier.state())


def routed(probes: DataFrame) -> DataFrame:
    """(media_id, probe, file, page, route, frame_idx) of probes (media_id, probe, file, page, kind, files).

    ``kind`` is frame, exists, end or error; an end is that of a page past its file's last one. A batch's
    probes of a media are taken in the order of their numbers.
    """
    rows = probes.select(*(F.col(c) for c in PROBE))
    return rows.groupBy("media_id").applyInPandasWithState(_route, ROUTED, STATE, "append", GroupStateTimeout.NoTimeout)


def settled(probes: DataFrame) -> DataFrame:
    """What a stream of all these probes has let through in the end: (media_id, probe, file, page, route, frame_idx), without errors and repeats.

    The batch form: windows over the pages of a file and the files of a media, so no task needs a whole media.
    """
    first = probes.filter((F.col("kind") != "error") & (F.col("file") < F.col("files"))).groupBy("media_id", "file", "page").agg(F.min_by(F.struct("probe", "kind"), "probe").alias("p"))
    rank = F.row_number().over(Window.partitionBy("media_id", "file").orderBy("page")) - 1
    gapless = first.select("media_id", "file", "page", "p.probe", F.col("p.kind").alias("route"), rank.alias("rank")).filter(F.col("rank") == F.col("page")).drop("rank")
    files = gapless.groupBy("media_id", "file").agg(F.min(F.when(F.col("route") == "end", F.col("page"))).alias("end"))
    by_file = Window.partitionBy("media_id").orderBy("file")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.min(F.col("end").isNotNull()).over(before), F.lit(True)) & (F.row_number().over(by_file) - 1 == F.col("file"))
    placed = files.select("media_id", "file", "end", reached.alias("reached"), F.coalesce(F.sum("end").over(before), F.lit(0)).alias("offset")).filter("reached")
    through = gapless.join(placed, ["media_id", "file"]).filter(F.col("end").isNull() | (F.col("page") <= F.col("end")))
    return through.select("media_id", "probe", "file", "page", "route", F.when(F.col("route") != "end", F.col("offset") + F.col("page")).cast("long").alias("frame_idx"))


class Sinks:
    """For ``foreachBatch``: each route's results below ``folder/route=.../batch=...``."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id))
        rows.write.partitionBy("route", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.folder)

    def read(self, spark, route: str | None = None) -> DataFrame:
        found = spark.read.schema(f"{ROUTED}, batch long").parquet(self.folder)
        return found if route is None else found.filter(F.col("route") == route)


def summary(found: DataFrame) -> DataFrame:
    """(media_id, length, files_ended) of routed results: the length that is known, and how many files have come to their end."""
    known = F.col("route").isin("frame", "exists")
    return found.groupBy("media_id").agg(F.count_if(known).alias("length"), F.count_if(F.col("route") == "end").alias("files_ended"))
