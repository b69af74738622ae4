"""Frontier and debounce: the state machines, and as streams over files."""

import time

from rasterlake.streaming import frontier as fr
from rasterlake.streaming import watch as wa


def test_frontier_rules():
    assert fr.advance(1, False, [7, 6, 5, 4], [False] * 4) == (1, False)
    assert fr.advance(1, False, [1, 2, 3, 4], [True, True, True, False]) == (4, True)
    assert fr.advance(4, True, [4], [True]) == (4, True)


def test_watch_rules():
    state = wa.step(None, 5)
    assert state == (5, None, 0) and wa.step(state, 6) == (5, 6, 0)
    assert wa.step(wa.step(state, 6), 7) == (5, 7, 0) and wa.step(wa.step(state, 6), 5) == (5, None, 0)


def stream(spark, tmp_path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def write(tmp_path, name, *rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text("\n".join(rows))
    time.sleep(0.05)


def test_frontier_stream(spark, tmp_path):
    row = '{{"media_id":"m","probe":{},"frame_idx":{},"hit":{}}}'.format
    write(tmp_path, "1.json", row(0, 3, "true"), row(1, 0, "true"))
    write(tmp_path, "2.json", row(2, 1, "true"), row(3, 2, "false"))
    probes = stream(spark, tmp_path, "media_id string, probe long, frame_idx long, hit boolean")
    query = fr.frontier(probes).writeStream.outputMode("update").format("memory").queryName("frontier").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        got = [(r.length, r.at_end) for r in spark.sql("SELECT * FROM frontier").collect()]
    finally:
        query.stop()
    assert got == [(1, False), (2, True)]


def test_debounce_stream(spark, tmp_path):
    row = '{{"path":"a","seq":{},"signature":{}}}'.format
    write(tmp_path, "1.json", row(0, 5))
    write(tmp_path, "2.json", row(1, 6), row(2, 7))
    changes = stream(spark, tmp_path, "path string, seq long, signature long")
    query = wa.debounced(changes, 50).writeStream.outputMode("update").format("memory").queryName("watch").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            got = [(r.generation, r.signature) for r in spark.sql("SELECT * FROM watch").collect()]
            if got:
                break
    finally:
        query.stop()
    assert got == [(1, 7)]


def test_signatures_change_with_content(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"x" * 200_000)
    sign = lambda: wa.signatures(spark, str(tmp_path / "d")).first().signature
    first = sign()
    assert first == sign()
    (tmp_path / "d" / "a.bin").write_bytes(b"x" * 199_999 + b"y")
    assert sign() != first
