"""Structure repair, tokenizer alignment and exact search against plain versions, and on odd tables."""

import os
import random

import duckdb
import numpy as np
import plain
import pytest
from samples import prose

from rasterlake.llm import align, registry, repair, topk
from rasterlake.llm.shared import staged

TURNS = "turn long, conv_id long, text string, role string, cost string"


def repaired(spark, rows):
    table = spark.createDataFrame([(t, c, x, r, "other") for c, t, r, x in rows], TURNS)
    damaged = repair.damaged(table)
    found = staged(repair.audits(damaged), "audits")
    out = repair.with_digests(found, repair.repaired_turns(damaged, found)).collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


def talk(seed, n, roles=("user", "assistant", "system", "tool", "")):
    rng = random.Random(seed)
    ends = [".", "!", "", "?\t", " ", ". x"]
    return [(rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(["", " \n", "ok.", "yes", prose(rng.randrange(9), 5) + rng.choice(ends)])) for _ in range(n)]


def test_repair_equals_plain(spark):
    rows = [(c, t, r, x) for c in range(300) for t, (r, x) in enumerate(talk(c, c % 12))]
    assert repaired(spark, rows) == plain.repaired(rows)


def test_repair_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "hi."), (None, 1, "user", "hi."), (1, None, "assistant", "a."), (1, -5, None, "x"), (1, 9, "user", None), (2, 7, "system", "only")]
    rows += [(3, 0, "user", prose(1, 60_000) + "."), (3, 1, "assistant", "x" * 200_000)] + [(4, 2, "user", "same.")] * 5
    rows += [(c, t, "user", "q?") for c in range(10, 60) for t in (0,)]
    got = repaired(spark, rows)
    assert got == plain.repaired(rows)
    assert any(v[-2] == "" and v[5] == 0 for v in got.values())  # nothing is left of some
    assert repaired(spark, []) == {}


def test_repair_by_segments(spark, monkeypatch):
    """Distances recorded a few rows at a time give the audit of one piece."""
    for seed in range(60):
        marks = bytes(random.Random(seed).randrange(16) & (random.Random(seed + k).choice([3, 7, 11])) for k in range(40))
        whole = repair.cheapest(marks)
        for size in (1, 3, 16):
            monkeypatch.setattr(repair, "SEGMENT", size)
            assert repair.cheapest(marks) == whole
            monkeypatch.undo()


def test_repair_long_conversation(spark):
    rows = [(8, t, r, x) for t, (r, x) in enumerate(talk(5, 9_000))]
    assert repaired(spark, rows) == plain.repaired(rows)


def test_repair_streams_texts_once_sorted(spark):
    """Repaired turns are rows in order, with what was inserted empty."""
    table = spark.createDataFrame([(1, 0, "assistant", "a."), (1, 1, "user", "b."), (1, 2, "user", "c.")], "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS copies")
    found = repair.audits(table)
    turns = [tuple(r) for r in repair.repaired_turns(table, staged(found, "audits")).collect()]
    assert found.first().audit == "DKR" and turns == [(1, 0, "user", "b."), (1, 1, "assistant", "c.")]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_a int")


def counted(spark, texts):
    found, _ = align.aligned(documents(spark, texts))
    rows = sorted(found.collect(), key=lambda r: r.doc_id)
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


ODD = ["▁", " ", "  two  blanks ", "<s> </s> <unk> <0x41> <|endoftext|>", "\x00 nul", "naïve café — “quotes” 中文字符 😀👩‍👩‍👧 ١٢٣", "line\n\n\tline  \r\n", "�", "a" * 3000, "=" * 500 + "-" * 300, "ﬁ ² ｆｕｌｌ"]


def test_align_equals_plain(spark, odd_texts, monkeypatch):
    texts = [*odd_texts, *ODD, *(prose(k, 40) for k in range(60)), *(prose(1, 80) for _ in range(30)), " " * 100_000]
    want = plain.aligned(texts)
    assert sum(w[2] > 0 for w in want) > 90 and sum(w[2] == 0 for w in want) >= 3
    assert counted(spark, texts) == want
    monkeypatch.setattr(align, "CROWDED", 1)
    monkeypatch.setattr(align, "SLICE_BYTES", 1000)
    assert counted(spark, texts) == want


def test_align_crowded_groups():
    """Distinct ids and their numbers give the links of every pair."""
    len_a, len_b = np.array([1, 2, 3]), np.array([1, 5, 7])
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = rng.integers(0, 3, 40)
        fill = int(len_a[a].sum())
        b = np.array([1] * (fill // 5) + [0] * (fill % 5))
        found = align.Alignment([a, a], [b, b], len_a, len_b)
        doc, code, times = found.pairs(3)
        assert times.sum() == found.n_links.sum() and len(set(zip(doc.tolist(), code.tolist(), strict=True))) == len(code)
        align.CROWDED, kept = 0, align.CROWDED
        assert all((x == y).all() for x, y in zip(found.pairs(3), (doc, code, times), strict=True))
        align.CROWDED = kept


def test_align_packs_exactly():
    rng = np.random.default_rng(2)
    for n in (0, 1, 500):
        values = rng.integers(0, 1 << int(rng.integers(1, 33)), n)
        assert (align.unpack(align.pack(values)) == values).all()
    sizes = np.array([0, 3, 0, 2, 1, 0])
    index = np.array([4, 9, 11, 0, 700, 3])
    assert (align._rising(sizes, align._gaps(sizes, index)) == index).all()


def test_align_empty_and_pairs(spark):
    assert align.aligned(documents(spark, []))[0].count() == 0
    _, pairs = align.aligned(documents(spark, ["the cat", "the dog", None]))
    best = {(r.a, r.b): (r.n, r.best) for r in pairs.collect()}
    assert max(n for n, _ in best.values()) == 2 and all(b for n, b in best.values() if n == 2)


def searched(spark, rows, **more):
    table = spark.createDataFrame([(v, i, 0, 0) for i, v in rows], "embedding array<double>, vec_id long, rank int, score int")
    return sorted(tuple(r) for r in topk.top_k(table, **more).collect())


def vectors(seed, n, width, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, width))
    return [(i, (centre[i % 6] + spread * rng.normal(size=width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("width,spread", [(8, 0.05), (16, 1.0), (1, 1.0)])
def test_search_equals_plain(spark, monkeypatch, width, spread):
    monkeypatch.setattr(topk, "GROUP_BYTES", 4096)
    monkeypatch.setattr(topk, "BATCH", 3)
    monkeypatch.setattr(topk, "DIRECTORY", 4)
    rows = vectors(width, 700, width, spread)
    assert searched(spark, rows) == sorted(plain.top_k(rows))


def test_search_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (100, None), (150, [None, 1.0]), (200, [nan, 1.0]), (250, [float("inf"), 1.0]), (300, []), (350, [3e6, -3e6]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0, 9.0]), (9, [-0.001, 0.0]), (-50, [0.5])]
    got = searched(spark, rows)
    assert got == sorted(plain.top_k(rows)) and {r[0] for r in got} == {0, 50, 300, 350, -50}
    with_null = [*rows, (None, [4.0, 4.0])]
    assert sorted(map(str, searched(spark, with_null))) == sorted(map(str, plain.top_k(with_null)))
    assert searched(spark, []) == [] and len(searched(spark, rows[:1])) == 0


def test_search_skips_blocks():
    """Blocks whose bound is below the k-th score aren't scored."""
    rows = [v for _, v in sorted(vectors(3, 640, 12, 0.01), key=lambda r: r[0] % 6)]
    weights = np.floor(256 * np.array(rows)).astype(np.int64)
    scored, real = [], topk.products
    topk.products = lambda a, b: scored.append(len(a) * len(b)) or real(a, b)
    try:
        best = topk.search(weights[:1], np.array([0]), np.array([topk.NO_SCORE]), weights, np.arange(640), 5)
    finally:
        topk.products = real
    exact = sorted(((-int(weights[0] @ w), i) for i, w in enumerate(weights) if i), key=lambda x: x)[:5]
    assert [(-s, i) for s, i in zip(best.score[0].tolist(), best.place[0].tolist(), strict=True)] == exact
    assert sum(scored[1:]) < 320


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_exact_top_k"])
def test_query_equals_sql(spark, tiny, name):
    con = duckdb.connect(config={"threads": 1})
    for file in os.listdir(tiny):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{tiny}/{file}'")
    want = con.sql(registry.ORACLE_SQL[name])
    made = registry.QUERIES[name](spark, tiny).select(want.columns)
    assert sorted(map(tuple, made.collect())) == sorted(want.fetchall())
