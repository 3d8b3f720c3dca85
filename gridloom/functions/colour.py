"""Colour arithmetic (COL operators)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb(hex_: Column) -> Column:
    """COL-01: struct (r, g, b) of '#RRGGBB' or 'RRGGBB'."""
    h = F.regexp_replace(hex_, "^#", "")
    return F.struct(*(F.conv(F.substring(h, p, 2), 16, 10).cast("int").alias(n) for p, n in ((1, "r"), (3, "g"), (5, "b"))))


def distance2(a: Column, b: Column) -> Column:
    """Squared distance of two (r, g, b) structs."""
    return sum(((a[x] - b[x]) * (a[x] - b[x]) for x in ("g", "b")), (a["r"] - b["r"]) * (a["r"] - b["r"]))


def distance(a: Column, b: Column) -> Column:
    """COL-02."""
    return F.sqrt(distance2(a, b).cast("double"))


def _hue(c: Column) -> tuple[Column, Column]:
    r, g, b = (c[x].cast("double") for x in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    # one sector of 60 degrees for each leading channel; red leads ties, then green
    turn = F.when(top == r, F.try_divide(g - b, d)).when(top == g, F.try_divide(b - r, d) + 2).otherwise(F.try_divide(r - g, d) + 4)
    return d, turn * 60


def hue(c: Column) -> Column:
    """COL-03: 0 to 360 rounded; grey 0, negatives wrapped."""
    d, h = _hue(c)
    return F.when(d == 0, 0).otherwise(F.round(F.when(h < 0, h + 360).otherwise(h))).cast("int")


def sort_hue(c: Column) -> Column:
    """COL-04: grey -1, negatives kept."""
    d, h = _hue(c)
    return F.when(d == 0, -1.0).otherwise(h)


def brightness(c: Column) -> Column:
    """COL-05."""
    return F.floor((c["r"] + c["g"] + c["b"]) / 3).cast("int")


def luma709(c: Column) -> Column:
    """COL-06, in 0 to 1."""
    return (0.2126 * c["r"] + 0.7152 * c["g"] + 0.0722 * c["b"]) / 255


def luma601(c: Column) -> Column:
    """COL-07, COL-08, in 0 to 255."""
    return 0.299 * c["r"] + 0.587 * c["g"] + 0.114 * c["b"]


def text_colour(c: Column) -> Column:
    """COL-06: black on light, white on dark."""
    return F.when(luma709(c) > 0.5, "#000000").otherwise("#FFFFFF")


def viewer_text_colour(c: Column) -> Column:
    """COL-07."""
    return F.when(luma601(c) / 255 > 0.62, "dark").otherwise("light")


def synth_text_is_white(c: Column, bar: int = 130) -> Column:
    """COL-08; 130 for synthetic cells, 128 for redrawn ones."""
    return luma601(c) < bar


def near_neutral_light(c: Column) -> Column:
    """PRD-17: light, with channel gaps under 25."""
    return (luma709(c) > 0.8) & (F.greatest(c["r"], c["g"], c["b"]) - F.least(c["r"], c["g"], c["b"]) < 25)
