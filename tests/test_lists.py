"""Lists of settings, playback and dispatch order."""

import pytest
from pyspark.sql import functions as F

from rasterlake.functions import tokens as K
from rasterlake.functions.tone import ALIASES
from rasterlake.operators import timeline as L


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [("linear,LUT_ALPHA , clip", ["linear", "lut_alpha", "linear"]), ("Colormap,colormap:BWR", ["colormap:turbo", "colormap:diverging"]), ("linear,", None), ("colormap:x", None), ("", None), (None, None)],
)
def test_tones(spark, text, want):
    assert one(spark, lambda t: K.tone_list(t, ALIASES, "turbo"), text) == want


def test_clips_numbers_and_flags(spark):
    assert one(spark, K.clip_list, "Off, 0.5,none") == [-1.0, 0.5, -1.0] and one(spark, K.clip_list, "1,x") is None
    assert one(spark, K.number_list, " 1, -2.5,1e2") == [1.0, -2.5, 100.0] and one(spark, K.number_list, "1,,2") is None
    pair = lambda t: K.number_list(t, 2)
    assert one(spark, pair, "3,4") == [3.0, 4.0] and one(spark, pair, "3,4,5") is None and one(spark, pair, "3") is None
    assert one(spark, K.flag_list, "1, on,true,yes,,0") == [True, True, True, False, False, False]


def test_settings_onto_panes(spark):
    panes = spark.createDataFrame([(0, 5.0), (1, 6.0), (2, 7.0)], "pane int, angle double")
    got = L.onto_panes(panes, "none", "pane", {"angle": F.array(F.lit(1.0), F.lit(2.0))}).orderBy("pane")
    assert [r.angle for r in got.collect()] == [1.0, 2.0, 7.0]
    assert [r.angle for r in L.onto_panes(panes, "none", "pane", {"angle": F.lit(None).cast("array<double>")}).orderBy("pane").collect()] == [5.0, 6.0, 7.0]


@pytest.mark.parametrize("lo,hi,stride", [(0, 9, 1), (2, 9, 3), (2, 9, 7), (2, 9, 50), (4, 4, 2), (5, 3, 1)])
@pytest.mark.parametrize("loops", [True, False])
def test_playback_equals_its_steps(spark, lo, hi, stride, loops):
    got = [r[0] for r in spark.range(30).orderBy("id").select(L.played(F.col("id"), F.lit(lo), F.lit(hi), F.lit(stride), F.lit(loops))).collect()]
    want = [lo]
    for _ in range(29):
        f = want[-1]
        want.append(lo if hi <= lo else f + stride if f + stride <= hi else hi if f < hi else lo if loops else f)
    assert got == want


def test_turns(spark):
    rows = [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0), ("c", 1)]
    got = {(r.pane, r.k): r.turn for r in L.interleaved(spark.createDataFrame(rows, "pane string, k int"), "pane", "k").collect()}
    assert sorted(got, key=got.get) == [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("c", 1), ("a", 2)] and sorted(got.values()) == list(range(6))
