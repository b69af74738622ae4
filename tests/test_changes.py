"""Rates, operator chains, kept headers and incremental refresh."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import anchors, chain, scan
from rasterlake.plans.graph import Node
from rasterlake.streaming.refresh import Refresh

# --- rates -------------------------------------------------------------------


def plain_rates(rows, tau, gap):
    out, last = {}, {}
    for key, at, tie, value in sorted(r for r in rows if None not in r):
        rate = 0.0
        if key in last:
            t, x, rate = last[key]
            if at - t > gap:
                rate = 0.0
            elif at > t:
                rate += ((value - x) / (at - t) - rate) * min((at - t) / tau, 1)
        last[key] = (at, value, rate)
        out[key, tie] = rate
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_rates_equal_the_fold(spark, partitions):
    rng = random.Random(5)
    rows = [(0 if k % 3 == 0 else rng.randrange(40), round(rng.random() * 30, rng.choice([1, 6])), k, rng.random() * 9) for k in range(3000)]
    rows += [(None, 1.0, -1, 2.0), (1, None, -2, 2.0), (1, 3.0, -3, None), (99, 4.0, -4, 1.0)]
    table = spark.createDataFrame(rows, "user int, at double, id long, v double")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r.user, r.id): r.rate for r in scan.smoothed_rate(table, "user", "at", "id", "v", 0.2, 1.0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    want = plain_rates(rows, 0.2, 1.0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, abs(want[k])) for k in want)


def test_a_hot_key_takes_several_tasks(spark):
    """A third of all rows of one key lie in several partitions, and none holds most of them."""
    table = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("user"), (F.col("id") * 0.01).alias("at"), "id", F.sin("id").alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        ordered = table.repartitionByRange(12, "user", "at", "id").filter("user = 7")
        sizes = [r[0] for r in ordered.groupBy(F.spark_partition_id()).count().select("count").collect()]
        got = {r.id: r.rate for r in scan.smoothed_rate(table, "user", "at", "id", "v", 0.2, 1.0).filter("user = 7").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(sizes) >= 4 and max(sizes) < 5000
    want = plain_rates([(7, r.at, r.id, r.v) for r in table.filter("user = 7").collect()], 0.2, 1.0)
    assert all(abs(got[i] - x) < 1e-6 for (_, i), x in want.items())


def test_rates_of_nothing(spark):
    assert scan.smoothed_rate(spark.createDataFrame([], "user int, at double, id long, v double"), "user", "at", "id", "v", 1, 1).count() == 0


# --- operator chains -----------------------------------------------------------

FRAME = "media_id int, frame_idx int, w int, h int, channels int, dtype string, samples array<double>"


def test_the_chain_in_order(spark):
    rows = [(1, 0, 2, 2, 1, "uint16", [10.0, 20.0, 30.0, 50.0]), (1, 1, 2, 1, 1, "uint16", [7.0, 7.0]), (1, 2, 1, 1, 3, "uint16", [1.0, 2.0, 3.0]), (1, 3, 2, 1, 1, "uint8", [1.0, 2.0]), (1, 4, 2, 1, 1, "uint16", None), (1, 5, 0, 0, 1, "uint16", [])]
    table = spark.createDataFrame(rows, FRAME)
    got = {r.frame_idx: (r.samples, r.absent) for r in chain.apply_chain(table).collect()}
    names = ["lut_alpha", "details"]
    assert got == {0: ([0, 16383, 32767, 65535], []), 1: ([7, 7], []), 2: ([1, 2, 3], names), 3: ([1, 2], names), 4: (None, names), 5: ([], names)}
    lifted = chain.apply_chain(table, (chain.Step("lut_alpha", chain.LutAlpha), chain.Step("gone", None), chain.Step("none", lambda w, h: None), chain.Step("details", chain.EdgeLift, True)))
    (first,) = lifted.filter("frame_idx = 0").collect()
    assert first.samples == [min(65535, v + (v >> 8) * 2) for v in (0, 16383, 32767, 65535)] and first.absent == ["gone", "none"]
    assert chain.apply_chain(table.limit(0)).count() == 0


class Counted:
    """Tells what became of every instance."""

    log: list = []

    def __init__(self, w, h):
        self.size = (w, h)
        self.log.append(("made", self.size))

    def apply(self, data):
        if data[0, 0] == 999:
            raise RuntimeError("boom")
        data += 1

    def close(self):
        self.log.append(("closed", self.size))


def batches(sizes, poison=None):
    import pyarrow as pa

    for k, n in enumerate(sizes):
        samples = [[999 if k == poison else 5] * n]
        yield pa.RecordBatch.from_pydict({"media_id": [1], "frame_idx": [k], "w": [n], "h": [1], "channels": [1], "dtype": ["uint16"], "samples": pa.array(samples, pa.list_(pa.float32()))})


def test_instances_are_few_and_always_closed():
    run = chain._run((chain.Step("counted", Counted),), ["media_id", "frame_idx"])
    Counted.log.clear()
    out = list(run(batches([1, 2, 3, 1, 4, 1, 2])))
    assert [b.column("samples")[0].as_py()[0] for b in out] == [6] * 7
    made, closed = ([s for what, s in Counted.log if what == x] for x in ("made", "closed"))
    assert [s[0] for s in made] == [1, 2, 3, 4, 2] and sorted(made) == sorted(closed)
    Counted.log.clear()
    with pytest.raises(RuntimeError):
        list(run(batches([1, 2, 3], poison=2)))
    assert sorted(s for what, s in Counted.log if what == "closed") == [(1, 1), (2, 1), (3, 1)]
    Counted.log.clear()
    partly = run(batches([1, 2]))
    next(partly)
    partly.close()
    assert Counted.log == [("made", (1, 1)), ("closed", (1, 1))]


def test_the_chain_needs_no_shuffle(spark):
    plan = chain.apply_chain(spark.createDataFrame([], FRAME))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


# --- kept headers ------------------------------------------------------------

HEADER = "file string, page int, off long, next long, w int"


def headers(spark, files):
    """Files as lists of (off, w); the last page ends the chain."""
    rows = [(f, k, off, pages[k + 1][0] if k + 1 < len(pages) else 0, w) for f, pages in files.items() for k, (off, w) in enumerate(pages)]
    return spark.createDataFrame(rows, HEADER)


def facts(spark, files):
    return spark.createDataFrame([(f, p[0][0], n) for f, (p, n) in files.items()], "file string, first long, length long")


OLD = {"a": [(8, 4), (16, 4), (24, 4)], "b": [(8, 4), (16, 4)], "c": [(8, 4), (16, 4)], "d": [(8, 4)], "e": [(8, 4), (16, 4), (24, 4)], "f": [(8, 4), (16, 4), (24, 4)]}
NEW = {"a": [(8, 4), (16, 4), (24, 4)], "b": [(8, 4), (16, 4), (24, 4)], "c": [(8, 4)], "e": [(8, 4), (16, 5), (24, 4)], "f": [(12, 4), (16, 4), (24, 4)], "g": [(8, 1)]}


def test_what_became_of_files(spark):
    got = {r.file: (r.change, r.pages, r.kept) for r in anchors.changes(headers(spark, OLD), headers(spark, NEW)).collect()}
    assert got == {"a": ("same", 3, 3), "b": ("grown", 3, 2), "c": ("cut", 1, 1), "d": ("gone", 0, 0), "e": ("rewritten", 3, 1), "f": ("rewritten", 3, 0), "g": ("new", 1, 0)}


def test_anchors_that_hold(spark):
    old = anchors.anchors(headers(spark, OLD))
    length = {f: 100 + 10 * (f == "b") for f in NEW}
    found = anchors.still_anchored(old, facts(spark, {f: (p, 100) for f, p in OLD.items()}), headers(spark, NEW), facts(spark, {f: (p, length[f]) for f, p in NEW.items()}))
    got = {(r.file, r.page): r.reason for r in found.collect()}
    assert [got["a", k] for k in range(3)] == [None] * 3 and [got["e", k] for k in range(3)] == [None, "header changed", None]
    assert {got["b", 0], got["b", 1]} == {"length changed"} and got["d", 0] == "gone" and got["f", 1] == "first page moved"
    assert [got["c", k] for k in range(2)] == ["header changed"] * 2
    spliced = headers(spark, {"a": [(8, 4), (40, 4), (24, 4)]}).unionByName(spark.createDataFrame([("a", 9, 16, 24, 4)], HEADER))
    same = facts(spark, {"a": (OLD["a"], 100)})
    chained = anchors.still_anchored(old.filter("file = 'a'"), same, spliced, same)
    assert {r.page: r.reason for r in chained.collect()} == {0: "header changed", 1: "chain changed", 2: None}


def test_groups_count_all_or_nothing(spark):
    rows = [("g", 0, "x", 3, None), ("g", 1, "y", 4, None), ("h", 0, "x", 2, None), ("h", 1, "y", None, "no stride"), ("h", 2, "z", 9, None), ("i", 0, "x", None, "gone")]
    got = {r.group: (r.files, r.failed, r.pages, r.usable) for r in anchors.group_counts(spark.createDataFrame(rows, "group string, place int, file string, pages int, error string")).collect()}
    assert got == {"g": (2, 0, 7, 7), "h": (3, 1, None, 2), "i": (1, 1, None, 0)}


# --- refresh -------------------------------------------------------------------

NODES = {12: Node("add", 1, 11), 10: Node("mean", 0), 11: Node("sub", 1, 10), 13: Node("std", 2)}
ROW = "input int, frame_idx int, y int, x int, v float"


def samples(spark, input_, frames):
    return spark.createDataFrame([(input_, k, 0, x, float(v)) for k, f in frames.items() for x, v in enumerate(f)], ROW)


def values(refresh, spark, node):
    return sorted((r.frame_idx, r.x, r.v) for r in refresh.results(spark).filter(F.col("node") == node).collect())


def recomputed(refresh, spark, batch):
    return sorted(r.node for r in refresh.state(spark).filter((F.col("batch") == batch) & F.col("recomputed") & (F.col("node") >= 10)).collect())


def test_only_what_changed_is_computed_again(spark, tmp_path):
    refresh = Refresh(NODES, str(tmp_path))
    assert refresh.order.index(10) < refresh.order.index(11) < refresh.order.index(12)
    refresh(samples(spark, 0, {0: [1, 3], 1: [3, 5]}).unionByName(samples(spark, 2, {0: [1, 1]})), 0)
    assert recomputed(refresh, spark, 0) == [10, 13]  # the others wait for media 1
    refresh(samples(spark, 1, {0: [10, 10], 1: [20, 20]}), 1)
    assert recomputed(refresh, spark, 1) == [11, 12] and values(refresh, spark, 11) == [(0, 0, 8), (0, 1, 6), (1, 0, 18), (1, 1, 16)]
    refresh(samples(spark, 2, {0: [5, 5]}), 2)
    assert recomputed(refresh, spark, 2) == [13]
    refresh(samples(spark, 0, {1: [7, 9]}), 3)
    assert recomputed(refresh, spark, 3) == [10, 11, 12] and values(refresh, spark, 10) == [(0, 0, 4), (0, 1, 6)]
    before = refresh.results(spark).collect()
    refresh(samples(spark, 0, {1: [100, 100]}), 3)  # the same batch again
    assert sorted(map(str, refresh.results(spark).collect())) == sorted(map(str, before)) and recomputed(refresh, spark, 3) == [10, 11, 12]


def test_refresh_as_a_stream_survives_a_cut(spark, tmp_path, monkeypatch):
    source, folder = tmp_path / "in", tmp_path / "out"
    samples(spark, 0, {0: [1, 3]}).unionByName(samples(spark, 1, {0: [10, 10]})).coalesce(1).write.parquet(str(source))
    stream = lambda f: spark.readStream.schema(ROW).parquet(str(source)).writeStream.foreachBatch(f).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    broken = Refresh(NODES, str(folder))
    write = broken._one

    def cut(node, stored):
        if node.kind == "sub":
            raise RuntimeError("executor lost")
        return write(node, stored)

    broken._one = cut
    with pytest.raises(Exception, match="executor lost"):
        stream(broken).awaitTermination()
    again = Refresh(NODES, str(folder))
    stream(again).awaitTermination()
    assert values(again, spark, 12) == [(0, 0, 19), (0, 1, 17)] and recomputed(again, spark, 0) == [10, 11, 12]
    samples(spark, 1, {0: [20, 20]}).coalesce(1).write.mode("append").parquet(str(source))
    stream(again).awaitTermination()
    assert values(again, spark, 12) == [(0, 0, 39), (0, 1, 37)] and recomputed(again, spark, 1) == [11, 12]


def test_steps_are_vectors():
    a, b = scan.step(np.array([0.1, 0.5, 2.0, 0.0]), np.array([1.0, 1.0, 1.0, 1.0]), 0.2, 1.0)
    assert np.allclose(a, [0.5, 0, 0, 1]) and np.allclose(b, [5, 2, 0, 0])
