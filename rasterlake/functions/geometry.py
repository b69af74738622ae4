"""View, rotation, tick and layout arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit_zoom(pane_w: Column, pane_h: Column, w: Column, h: Column) -> Column:
    return F.greatest(F.least(pane_w / w, pane_h / h), F.lit(1e-4))


def clamp_zoom(zoom: Column) -> Column:
    return F.least(F.lit(512.0), F.greatest(F.lit(1e-4), zoom))


def rotate(x: Column, y: Column, px: Column, py: Column, degrees: Column) -> tuple[Column, Column]:
    a = F.radians(degrees)
    dx, dy = x - px, y - py
    return px + dx * F.cos(a) - dy * F.sin(a), py + dx * F.sin(a) + dy * F.cos(a)


def wrap_angle(degrees: Column) -> Column:
    """To above -180 and at most 180."""
    return F.lit(180.0) - F.pmod(F.lit(180.0) - degrees, F.lit(360.0))


def segment_distance(px: Column, py: Column, ax: float, ay: float, bx: float, by: float) -> Column:
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / squared)) if squared else F.lit(0.0)
    return F.sqrt((px - (ax + t * dx)) ** 2 + (py - (ay + t * dy)) ** 2)


def nice(x: Column, nearest: bool) -> Column:
    """The nearest 1, 2, 5 or 10 times a power of ten, or the smallest that encloses x; 1 for x <= 0."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    part = x / power
    a, b, c = (part < 1.5, part < 3.0, part < 7.0) if nearest else (part <= 1.0, part <= 2.0, part <= 5.0)
    return F.when(x <= 0, 1.0).otherwise(F.when(a, 1.0).when(b, 2.0).when(c, 5.0).otherwise(10.0) * power)


def ticks(lo: Column, hi: Column, target: int, most: int = 64) -> Column:
    """Evenly spaced nice values that span [lo, hi]."""
    step = nice(nice(hi - lo, False) / (max(target, 2) - 1), True)
    first, last = F.floor(lo / step), F.ceil(hi / step)
    return F.when(hi <= lo, F.array(lo)).otherwise(F.transform(F.sequence(first, F.least(last, first + most - 1)), lambda k: k * step))


def level_size(n: Column, level: Column) -> Column:
    """Halved ``level`` times, rounding up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(n / F.pow(F.lit(2.0), level))).cast("int")


def resolution_level(w: Column, h: Column, budget: Column, max_level: int = 8) -> Column:
    """The finest level of at most ``budget`` pixels, or the last; no budget is level 0."""
    levels = F.filter(F.sequence(F.lit(0), F.lit(max_level)), lambda k: level_size(w, k).cast("long") * level_size(h, k) <= budget)
    return F.when(budget <= 0, 0).otherwise(F.coalesce(F.try_element_at(levels, F.lit(1)), F.lit(max_level)))


def decimation(zoom: Column) -> Column:
    return F.when(zoom >= 1, 1).otherwise(F.floor(1 / zoom)).cast("int")


def power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1))))).cast("int")


def prefetch_depth(latency_s: Column, panes: Column, workers: Column, fps: Column) -> Column:
    return F.least(F.lit(8), F.greatest(F.lit(3), F.ceil(latency_s * panes / (workers / fps)) + 1)).cast("int")


def watch_interval(files: Column) -> Column:
    return F.least(F.lit(2.0), 0.2 * F.greatest(files / 4.0, F.lit(1.0)))


def even_size(height: Column, aspect: Column) -> tuple[Column, Column]:
    """(width, height) of an output: both even, at least 2 high."""
    h = F.greatest(F.lit(2), height - height % 2).cast("int")
    w = F.greatest(F.lit(2), F.floor(h * aspect + 0.5).cast("int"))
    return (w - w % 2).cast("int"), h


def zoom_at(zoom: Column, cx: Column, cy: Column, factor: Column, ax: Column, ay: Column, pane_x: Column, pane_y: Column) -> tuple[Column, Column, Column]:
    """(zoom, centre x, centre y) after zooming about a screen point, which keeps the image point under it."""
    new = clamp_zoom(zoom * factor)
    moved = lambda c, a, p: c + (a - p) / zoom - (a - p) / new
    return new, moved(cx, ax, pane_x), moved(cy, ay, pane_y)


def to_screen(x: Column, y: Column, zoom: Column, cx: Column, cy: Column, pane_x: Column, pane_y: Column) -> tuple[Column, Column]:
    """Where an image point lies on the screen, for a view centred on (cx, cy) in a pane centred on (pane_x, pane_y)."""
    return pane_x + (x - cx) * zoom, pane_y + (y - cy) * zoom


def to_image(sx: Column, sy: Column, zoom: Column, cx: Column, cy: Column, pane_x: Column, pane_y: Column) -> tuple[Column, Column]:
    return cx + (sx - pane_x) / zoom, cy + (sy - pane_y) / zoom


def rotated_to_screen(x: Column, y: Column, w: Column, h: Column, degrees: Column, *view: Column) -> tuple[Column, Column]:
    """As ``to_screen`` for a view that is turned about the image's centre."""
    return rotate(*to_screen(x, y, *view), *to_screen(w / 2.0, h / 2.0, *view), degrees)


def rotated_to_image(sx: Column, sy: Column, w: Column, h: Column, degrees: Column, *view: Column) -> tuple[Column, Column]:
    return to_image(*rotate(sx, sy, *to_screen(w / 2.0, h / 2.0, *view), -degrees), *view)


def fit_step(w: Column, h: Column, side: Column | int) -> Column:
    """The least decimation after which neither side is longer than ``side``; 1 if there is no limit."""
    limit = F.lit(side)
    return F.when(limit <= 0, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.greatest(w, h) / F.greatest(limit, F.lit(1))))).cast("int")


#: Fixed value: pixels of a thumbnail's longer side.
THUMBNAIL = 240


def stepped(n: Column, step: Column) -> Column:
    """Samples left of n when every step-th stays."""
    return F.greatest(F.lit(1), F.ceil(n / step)).cast("int")


def anchor_fractions(anchor: Column) -> tuple[Column, Column]:
    """Where a label stands in its free space, for anchors 0 to 8 counted by rows of three."""
    return (anchor % 3) / 2.0, F.floor(anchor / 3) / 2.0


def union(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """The box around two rectangles of x0, y0, x1, y1."""
    return {k: (F.least if k.endswith("0") else F.greatest)(a[k], b[k]) for k in a}


def intersection(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """What two rectangles share; x1 < x0 or y1 < y0 where they don't meet."""
    return {k: (F.greatest if k.endswith("0") else F.least)(a[k], b[k]) for k in a}
