"""Routing of decode results over runs of files."""

import random

import pytest

from rasterlake.streaming import routing

PROBE = "media_id long, probe long, file int, page int, kind string, files int"


def run_of(media, lengths):
    return [(media, f, p, ("frame", "exists")[p % 2]) for f, n in enumerate(lengths) for p in range(n)] + [(media, f, n, "end") for f, n in enumerate(lengths)]


def numbered(rows, files, seed):
    random.Random(seed).shuffle(rows)
    return [(m, k, f, p, kind, files) for k, (m, f, p, kind) in enumerate(rows)]


@pytest.mark.parametrize("seed", range(20))
def test_any_order_ends_at_the_summed_length(seed):
    lengths = [3, 0, 5]
    frontier, got = routing.Frontier(), []
    for _, probe, file, page, kind, files in numbered(run_of(1, lengths), 3, seed):
        got += frontier.take(probe, file, page, kind, files)
        frontier = routing.Frontier(*frontier.state()[:4], list(zip(*frontier.state()[4:], strict=True)))  # through the state
    assert frontier.ended and frontier.length == 8 and not frontier.ahead
    places = [(f, p, i) for _, f, p, route, i in got if route in ("frame", "exists")]
    assert places == [(0, 0, 0), (0, 1, 1), (0, 2, 2), *((2, k, 3 + k) for k in range(5))] and len({r[0] for r in got}) == len(got)


def test_repeats_errors_and_what_waits():
    frontier = routing.Frontier()
    take = lambda *r: [x[3:] for x in frontier.take(*r, 2)]
    assert take(0, 0, 1, "frame") == [] and take(1, 0, 1, "frame") == [("repeat", None)]
    assert take(2, 0, 0, "error") == [("error", None)] and take(3, 0, 0, "exists") == [("exists", 0), ("frame", 1)]
    assert take(4, 0, 0, "frame") == [("repeat", None)] and take(5, 0, 2, "end") == [("end", None)] and frontier.file == 1
    assert take(6, 1, 0, "end") == [("end", None)] and frontier.ended and take(7, 1, 0, "frame") == [("repeat", None)]
    assert take(8, 5, 0, "frame") == [("repeat", None)]


def test_a_stream_routes_each_result_once(spark, tmp_path):
    rows = numbered(run_of(1, [4, 2, 3]), 3, 1) + numbered(run_of(2, [5]), 1, 2) + [(3, 0, 0, 0, "error", 1)]
    rows += [(1, 99, 0, 0, "frame", 3)]
    sinks, batches = routing.Sinks(str(tmp_path / "out")), []

    def both(batch, batch_id):
        batch.persist()
        sinks(batch, batch_id)
        sinks(batch, batch_id)  # a replay
        batches.append(batch_id)
        batch.unpersist()

    for k in range(3):
        part = spark.createDataFrame([r for r in rows if r[1] % 3 == k], PROBE)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = routing.routed(spark.readStream.schema(PROBE).parquet(str(tmp_path / "in")))
        stream.writeStream.outputMode("append").foreachBatch(both).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    found = sinks.read(spark).toPandas()
    assert len(batches) >= 3 and len(found) == len(rows)
    own = found[(found.media_id == 1) & found.route.isin(["frame", "exists"])].sort_values("frame_idx")
    assert own.frame_idx.tolist() == list(range(9)) and own.file.tolist() == [0] * 4 + [1] * 2 + [2] * 3
    assert sorted(found[found.media_id == 1].route.value_counts().to_dict().items()) == [("end", 3), ("exists", 4), ("frame", 5), ("repeat", 1)]
    assert sinks.read(spark, "error").count() == 1
    lengths = {r.media_id: (r.length, r.files_ended) for r in routing.summary(sinks.read(spark)).collect()}
    assert lengths == {1: (9, 3), 2: (5, 1), 3: (0, 0)}


@pytest.mark.parametrize("seed", range(3))
def test_the_batch_form_equals_the_stream(spark, seed):
    rng, rows = random.Random(seed), []
    for media in range(8):
        own = [r for r in run_of(media, [rng.randrange(6) for _ in range(3)]) if rng.random() > 0.04]
        own += [(m, f, p, "error") for m, f, p, _ in own[:2]] + own[:3] + [(media, 7, 0, "frame")]
        rows += numbered(own, 3, seed)
    want = []
    for media in range(8):
        frontier = routing.Frontier()
        want += [(media, *r) for m, *probe in rows if m == media for r in frontier.take(*probe) if r[3] not in ("error", "repeat")]
    got = routing.settled(spark.createDataFrame(rows, PROBE)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_nothing_is_routed_to_nothing(spark):
    assert routing.settled(spark.createDataFrame([], PROBE)).count() == 0
