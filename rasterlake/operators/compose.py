"""Composition of panes into output frames.

Which source sample an output pixel shows depends on the panes alone, not on the frame, so
the mapping is computed once for a plan and joined to packed frames; pixels appear last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import geometry as G
from rasterlake.functions import tone as T
from rasterlake.operators import packed as P


def _view() -> tuple[Column, ...]:
    """A pane's view: its zoom, the image point at its centre, and its cell's centre."""
    return F.col("zoom"), F.col("cx"), F.col("cy"), F.col("left") + F.col("cell_w") / 2.0, F.col("top") + F.col("cell_h") / 2.0


def source_places(panes: DataFrame, canvas: tuple[float, float], size: tuple[int, int], w: int, h: int) -> DataFrame:
    """(plan, pane, media_id, places): the output pixels of each pane with the samples that they show, none where it shows no image.

    panes has plan, pane, media_id, the cell (left, top, cell_w, cell_h), the view (zoom, cx, cy) and
    degrees. The canvas is resampled to ``size`` by nearest samples; the first cell that holds a pixel shows it.
    """
    step_x, step_y = canvas[0] / size[0], canvas[1] / size[1]
    # each cell lists its own output pixels: no pixel meets the cells that can't hold it
    first = lambda at, step: F.greatest(F.lit(0), F.ceil(F.col(at) / step - 0.5))
    last = lambda at, n, step, most: F.least(F.lit(most), F.ceil((F.col(at) + F.col(n)) / step - 0.5)) - 1
    spans = {"ox": (first("left", step_x), last("left", "cell_w", step_x, size[0])), "oy": (first("top", step_y), last("top", "cell_h", step_y, size[1]))}
    px = panes
    for name, (lo, hi) in spans.items():
        px = px.withColumn(name, F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))))
    px = px.withColumns({"x": (F.col("ox") + 0.5) * step_x, "y": (F.col("oy") + 0.5) * step_y})
    shown = px.groupBy("plan", "ox", "oy").agg(F.min_by(F.struct(*[c for c in px.columns if c not in ("plan", "ox", "oy")]), "pane").alias("p")).select("plan", "ox", "oy", "p.*")
    ix, iy = G.rotated_to_image(F.col("x"), F.col("y"), F.lit(w), F.lit(h), F.col("degrees"), *_view())
    inside = (ix >= 0) & (iy >= 0) & (ix < w) & (iy < h)
    place = F.when(inside, F.floor(iy) * w + F.floor(ix)).cast("int")
    return shown.groupBy("plan", "pane", "media_id").agg(F.collect_list(F.struct(F.col("ox").cast("int").alias("ox"), F.col("oy").cast("int").alias("oy"), place.alias("place"))).alias("places"))


def source_boxes(panes: DataFrame, w: int, h: int) -> DataFrame:
    """(plan, pane, x0, y0, x1, y1): the samples that a cell can show, a pixel wider, inside the frame."""
    corners = [G.rotated_to_image(F.col("left") + dx * F.col("cell_w"), F.col("top") + dy * F.col("cell_h"), F.lit(w), F.lit(h), F.col("degrees"), *_view()) for dx in (0, 1) for dy in (0, 1)]
    xs, ys = zip(*corners, strict=True)
    low = lambda c: F.greatest(F.lit(0), F.floor(F.least(*c)) - 1).cast("int")
    high = lambda c, n: F.least(F.lit(n), F.ceil(F.greatest(*c)) + 1).cast("int")
    return panes.select("plan", "pane", low(xs).alias("x0"), low(ys).alias("y0"), high(xs, w).alias("x1"), high(ys, h).alias("y1"))


def compose(frames: DataFrame, panes: DataFrame, canvas: tuple[float, float], size: tuple[int, int], w: int, h: int, over: float, colour: int = 10, alpha: int = 128) -> DataFrame:
    """(plan, frame_idx, ox, oy, g, a) of every output frame; alpha is 0 where no image is.

    A pane's window is measured on its pinned region of the whole frame (pin_x0, pin_y0, pin_x1, pin_y1),
    or, where that is null, on the box of samples that its cell shows. Panes with ``masked`` carry their own samples above
    ``over`` as a mask on top. The panes are layouts, few beside the frames; adaptive execution broadcasts them.
    """
    places = source_places(panes, canvas, size, w, h).join(source_boxes(panes, w, h), ["plan", "pane"])
    pins = panes.select("plan", "pane", "masked", *(F.coalesce(f"pin_{k}", F.lit(None)).alias(f"pin_{k}") for k in ("x0", "y0", "x1", "y1")))
    both = frames.join(places.join(pins, ["plan", "pane"]), "media_id")
    at = lambda k: F.coalesce(f"pin_{k}", k)
    measured = F.filter("samples", lambda _, i: (i % w >= at("x0")) & (i % w < at("x1")) & (F.floor(i / w) >= at("y0")) & (F.floor(i / w) < at("y1")))
    # measured before the places are taken apart: once a frame and pane, not once a pixel
    lo, hi = P.extent(F.col("measured"))
    windows = both.withColumn("measured", measured).select("plan", "frame_idx", "samples", "masked", "places", lo.alias("lo"), hi.alias("hi"))
    px = windows.select("plan", "frame_idx", "samples", "masked", "lo", "hi", F.inline("places")).withColumn("v", F.get("samples", F.col("place")))
    g = T.linear(F.col("v"), F.col("lo"), F.col("hi"))
    g = F.when(F.col("masked") & (F.col("v") > over), T.blend(g, F.lit(colour), F.lit(alpha))).otherwise(g)
    return px.select("plan", "frame_idx", "ox", "oy", F.when(F.col("v").isNull(), T.BACKGROUND[0]).otherwise(g).alias("g"), F.when(F.col("v").isNull(), 0).otherwise(255).alias("a"))
