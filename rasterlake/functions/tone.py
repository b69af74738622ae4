"""Value to display mapping: windows, palettes, overlays, blends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Palette anchors as (position, red, green, blue).
ANCHORS = {
    "viridis": ((0.0, 68, 1, 84), (0.25, 59, 82, 139), (0.5, 33, 145, 140), (0.75, 94, 201, 98), (1.0, 253, 231, 37)),
    "turbo": ((0.0, 48, 18, 59), (0.25, 31, 150, 225), (0.5, 120, 209, 84), (0.75, 249, 158, 45), (1.0, 122, 4, 3)),
    "diverging": ((0.0, 59, 76, 192), (0.5, 242, 242, 242), (1.0, 180, 4, 38)),
}
#: Other names of the palettes.
ALIASES = {"turbo": "turbo", "viridis": "viridis", "diverging": "diverging", "diff": "diverging", "bwr": "diverging"}
#: The colour behind transparent pixels.
BACKGROUND = (24, 24, 24)


def palette(name: str) -> list[tuple[int, int, int]]:
    """256 colours, linear between the anchors."""
    anchors = ANCHORS[ALIASES[name.strip().lower()]]

    def colour(i: int) -> tuple[int, int, int]:
        t = i / 255
        k = next(k for k in range(len(anchors) - 1) if t <= anchors[k + 1][0])
        (p, *a), (q, *b) = anchors[k], anchors[k + 1]
        return tuple(int(x + (y - x) * (t - p) / (q - p) + 0.5) for x, y in zip(a, b, strict=True))

    return [colour(i) for i in range(256)]


def palette_column(name: str, index: Column) -> Column:
    """The colour at ``index`` (0 to 255) as 0xRRGGBB; a literal array, so no join."""
    return F.element_at(F.array(*(F.lit(r << 16 | g << 8 | b) for r, g, b in palette(name))), index + 1)


def packed_abgr(rgb: Column) -> Column:
    """A 24-bit colour as one opaque number of alpha, blue, green and red bytes."""
    red, green, blue = F.shiftright(rgb, 16), F.shiftright(rgb, 8).bitwiseAND(255), rgb.bitwiseAND(255)
    return F.lit(0xFF000000) + F.shiftleft(blue, 16) + F.shiftleft(green, 8) + red


def linear(s: Column, lo: Column, hi: Column, top: int = 255) -> Column:
    """The linear window to 0..top in single precision; truncates, NaN is 0, a flat window maps all to 0."""
    s, lo, hi = (c.cast("float") for c in (s, lo, hi))
    scale = F.when(hi > lo, F.lit(float(top)).cast("float") / (hi - lo)).otherwise(F.lit(0.0)).cast("float")
    mapped = ((s - lo) * scale).cast("float")
    clamped = F.least(F.lit(float(top)).cast("float"), F.greatest(F.lit(0.0).cast("float"), mapped))
    return F.when(F.isnan(mapped) | mapped.isNull(), 0).otherwise(clamped.cast("int"))


def masked(s: Column) -> Column:
    """Mask frames ignore the window."""
    return F.when(s != 0, 255).otherwise(0)


def histogram_bin(s: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin over [lo, hi]; only the maximum reaches the last one."""
    span = F.greatest((hi - lo).cast("float"), F.lit(1.1754943508222875e-38).cast("float"))
    part = ((s - lo).cast("float") / span).cast("float")
    return F.least(F.lit(bins - 1), (part * F.lit(float(bins - 1)).cast("float")).cast("int"))


def opacity(o: Column) -> Column:
    return (F.least(F.lit(1.0), F.greatest(F.lit(0.0), o)) * 255).cast("int")


def intensity_alpha(s: Column, lo: Column, hi: Column, alpha: Column | int) -> Column:
    span = F.greatest((hi - lo).cast("float"), F.lit(1.1754943508222875e-38).cast("float"))
    part = F.least(F.lit(1.0).cast("float"), F.greatest(F.lit(0.0).cast("float"), ((s - lo).cast("float") / span).cast("float")))
    return F.round((part * F.lit(alpha).cast("float")).cast("double")).cast("int")


def blend(base: Column, over: Column, alpha: Column) -> Column:
    """Round half up of base (1 - a) + over a, a in 0..255."""
    a = alpha / 255.0
    return F.floor(base * (1.0 - a) + over * a + 0.5).cast("int")


def nominal_max(dtype: Column) -> Column:
    return F.when(dtype == "uint8", 255.0).when(dtype == "uint16", 65535.0).otherwise(1.0)


def operator_input(dtype: Column, channels: Column) -> Column:
    """Whether a frame may go through the 16-bit operators."""
    return (channels == 1) & (dtype == "uint16")


def deep(dtype: Column) -> Column:
    """More than 8 bits a sample; such frames are clipped by default."""
    return dtype != "uint8"


def may_overlay(channels: Column) -> Column:
    """Mono frames and those of three colours can lie over others."""
    return channels.isin(1, 3, 4)


def table_entries(dtype: Column) -> Column:
    """Entries of a tone table: every value of an integer type, 256 levels of a float."""
    return F.when(dtype == "uint16", 65536).otherwise(256)


def clip_percent(tone: Column, enabled: Column, percent: Column) -> Column:
    """The tails that are clipped; none when that is off, and none for the look that makes its own contrast."""
    return F.when(enabled & (tone != "lut_alpha"), percent)


def uses_palette(tone: Column, channels: Column, mask: Column) -> Column:
    """Palettes colour frames of one colour that aren't masks."""
    return (tone == "colormap") & channels.isin(1, 2) & ~mask


def label_blend(base: Column, covered: Column, colour: Column, a: Column) -> Column:
    """A label's channel over an image's, or over the background where no image is."""
    return F.floor(F.when(covered, base).otherwise(BACKGROUND[0]) * (1 - a) + colour * a + 0.5).cast("int")


def on_white(value: Column, alpha: Column) -> Column:
    """What a format without alpha stores."""
    return F.when(alpha == 0, 255).otherwise(value)


def plane_channels(space: Column, stated: Column, alpha: Column, planes: Column) -> Column:
    """Channels that decoded planes become: one or three colours, and alpha beside three if a plane is left for it; null if they can't be shown."""
    named = F.when(space == "gray", 1).when(space == "rgb", 3)
    colours = F.when(space.isin("icc", "unknown"), F.when(stated.isin(1, 3), stated)).otherwise(named)
    full = F.when(alpha & (planes > colours), 4).otherwise(3)
    return F.when(planes >= colours, F.when(colours == 1, 1).otherwise(full)).cast("int")


def interleave(planes: Column, channels: int, size: int, top: Column) -> Column:
    """Planes one after another as pixels, rounded half away from zero and clamped to 0..top."""
    held = F.transform(planes, lambda v: F.greatest(F.lit(0), F.least(top, F.round(v))).cast("int"))
    return F.flatten(F.transform(F.arrays_zip(*(F.slice(held, c * size + 1, size).alias(f"c{c}") for c in range(channels))), lambda z: F.array(*(z[f"c{c}"] for c in range(channels)))))
