"""Sequence tokens, numbered names and parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that open as images and as videos.
IMAGES = ("tif", "tiff", "png", "jpg", "jpeg", "bmp", "webp", "jp2", "j2k", "j2c", "jpc")
VIDEOS = ("mp4", "avi")

NAME = r"^(.*?)([0-9]+)([^0-9]*)$"
TOKEN = r"^(.*?)%0?([0-9]*)u(.*),([0-9]+),([0-9]+)$"


def padded(number: Column, width: Column) -> Column:
    """Zero-padded to ``width``; longer numbers stay whole."""
    text = number.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), width - F.length(text))), text)


def split_name(name: Column) -> dict[str, Column]:
    """Prefix, number, width and suffix at the last run of digits; no digits gives nulls."""
    found = name.rlike(r"[0-9]")
    part = lambda k: F.when(found, F.regexp_extract(name, r"^(.*[^0-9]|)([0-9]+)([^0-9]*)$", k))
    return {"prefix": part(1), "number": part(2).cast("long"), "width": F.length(part(2)), "suffix": part(3)}


def expand(token: Column) -> Column:
    """The names of ``PREFIX%0WuSUFFIX,START,END``; none if END is before START or it is no token."""
    part = lambda k: F.regexp_extract(token, TOKEN, k)
    start, stop = F.nullif(part(4), F.lit("")).cast("long"), F.nullif(part(5), F.lit("")).cast("long")
    width = F.coalesce(F.nullif(part(2), F.lit("")).cast("int"), F.lit(0))
    numbers = F.when(stop >= start, F.sequence(start, stop)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda n: F.concat(part(1), padded(n, width), part(3)))


def token(prefix: Column, width: Column, suffix: Column, start: Column, stop: Column) -> Column:
    return F.concat(prefix, F.lit("%0"), width.cast("string"), F.lit("u"), suffix, F.lit(","), start.cast("string"), F.lit(","), stop.cast("string"))


def extension(path: Column) -> Column:
    return F.lower(F.when(path.contains("."), F.element_at(F.split(path, r"\."), -1)).otherwise(""))


def is_loadable(path: Column) -> Column:
    return extension(path).isin(*IMAGES, *VIDEOS)


def is_video(path: Column) -> Column:
    return extension(path).isin(*VIDEOS)


def compute_token(text: Column) -> dict[str, Column]:
    """Kind and sources of ``compute:kind:a[,b][:auto]``; nulls if it is no node."""
    kind = F.regexp_extract(text, r"^compute:([a-z]+):[0-9]", 1)
    kind = F.when(kind.isin("sub", "diff"), "sub").when(kind.isin("add", "mean", "std"), kind)
    a, b = (F.nullif(F.regexp_extract(text, r"^compute:[a-z]+:([0-9]+)(?:,([0-9]+))?", k), F.lit("")).cast("int") for k in (1, 2))
    valid = kind.isNotNull() & (kind.isin("mean", "std") | b.isNotNull())
    return {"kind": F.when(valid, kind), "a": F.when(valid, a), "b": F.when(valid & kind.isin("add", "sub"), b)}


def rate(text: Column) -> Column:
    """A rational frame rate; null if the denominator is 0 or it is no rate."""
    top, bottom = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
    return F.try_divide(top.try_cast("double"), F.coalesce(F.nullif(bottom, F.lit("")), F.lit("1")).try_cast("double"))


def ellipsize(text: Column, longest: int) -> Column:
    return F.when(F.length(text) <= longest, text).otherwise(F.concat(F.left(text, F.lit(longest - 1)), F.lit("…")))


def quoted(text: Column) -> Column:
    return F.when(text.rlike(r"\s"), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)


def readout(value: Column, is_float: bool) -> Column:
    return F.format_string("%.4f", value.cast("double")) if is_float else value.cast("long").cast("string")


def reduced_name(name: Column, level: Column) -> Column:
    """A name says by how much its image is reduced."""
    return F.when(level == 0, name).otherwise(F.concat(name, F.lit(" (1/"), F.pow(F.lit(2), level).cast("int").cast("string"), F.lit(")")))


def label(custom: Column, name: Column) -> Column:
    """The user's text; a media's own name where that is unset or blank."""
    return F.coalesce(F.nullif(F.trim(custom), F.lit("")), name)


def short_number(value: Column, digits: int, whole: float) -> Column:
    """Without decimals if the fraction is below ``whole``, else with ``digits``, rounded half to even."""
    fraction = F.abs(value - value.cast("long"))
    return F.when(fraction < whole, F.round(value).cast("long").cast("string")).otherwise(F.call_function("format_number", value, F.lit(f"0.{'0' * digits}")))


def computed_name(title: Column, a: Column, sign: str, b: Column) -> Column:
    return F.concat(title, F.lit(" · "), a, F.lit(f" {sign} "), b)


def export_format(name: Column) -> Column:
    return F.when(F.lower(F.regexp_extract(F.trim(name), r"\.([^.]*)$", 1)).isin("png", "jpg", "jpeg"), "image").otherwise("video")


def log_tail(log: Column, lines: int) -> Column:
    """The last lines, the latest first; a final line break ends a line and begins none."""
    return F.array_join(F.slice(F.reverse(F.split(F.regexp_replace(log, r"\n$", ""), "\n")), 1, lines), " | ")


def video_frames(stated: Column, packets: Column, seconds: Column, fps: Column) -> Column:
    """The number of frames that a probe gives; null if it gives none."""
    counted = F.coalesce(packets, F.round(seconds * fps).cast("long"))
    return F.coalesce(stated, F.when(counted > 0, counted))


def _items(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def _whole(items: Column) -> Column:
    """The list, or nothing if one of its items is none."""
    return F.when(~F.exists(items, lambda x: x.isNull()), items)


def tone_list(text: Column, palettes: dict[str, str], default: str) -> Column:
    """The tone of each pane of a comma-separated list: linear, lut_alpha or colormap:name. One unknown item voids the list."""
    names = F.create_map(*(F.lit(x) for pair in palettes.items() for x in pair))

    def tone(item: Column) -> Column:
        name = F.lower(item)
        named = F.when(name.startswith("colormap:"), F.concat(F.lit("colormap:"), F.try_element_at(names, F.trim(F.substring(name, 10, 1 << 20)))))
        return F.when(name.isin("linear", "linearclip", "clip"), "linear").when(name.isin("lutalpha", "lut_alpha"), "lut_alpha").when(name == "colormap", f"colormap:{default}").otherwise(named)

    return _whole(F.transform(_items(text), tone))


def clip_list(text: Column) -> Column:
    """The percentile of each pane, -1 for off. One item that is neither voids the list."""
    return _whole(F.transform(_items(text), lambda x: F.when(F.lower(x).isin("off", "none"), F.lit(-1.0).cast("float")).otherwise(x.try_cast("float"))))


def number_list(text: Column, length: int | None = None) -> Column:
    """Comma-separated numbers, of that many if ``length`` is given. One item that is no number voids the list."""
    found = _whole(F.transform(_items(text), lambda x: x.try_cast("double")))
    return found if length is None else F.when(F.size(found) == length, found)


def flag_list(text: Column) -> Column:
    """Whether each item says yes; whatever else it says is no."""
    return F.transform(_items(text), lambda x: x.isin("1", "true", "on"))
