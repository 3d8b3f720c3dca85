"""Crop rectangles, grids and viewports (OCR-02 to 05, 21, 22, RNG-01, PAL-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: Column | int, hi: Column | int) -> Column:
    """MTH-07."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(lo), F.least(as_col(hi), x))


def clip_box(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    """OCR-02: the part of a box inside the image; NULL if it is empty."""
    x0, y0, x1, y1 = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0)), F.least(x + w, img_w), F.least(y + h, img_h)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def _edges(start: Column, size: Column, n: Column, k: Column, snap) -> tuple[Column, Column]:
    return snap(start + size * k / n), snap(start + size * (k + 1) / n)


def inference_rect(x: Column, y: Column, w: Column, h: Column, rows: Column, cols: Column, row: Column, col: Column) -> Column:
    """OCR-03: rounded edges, inset of a tenth of the rounded size, one pixel at least."""
    snap = lambda v: F.round(v).cast("long")
    x0, x1 = _edges(x, w, cols, col, snap)
    y0, y1 = _edges(y, h, rows, row, snap)
    dx, dy = (F.greatest(F.lit(1), F.round((b - a) * 0.1)).cast("long") for a, b in ((x0, x1), (y0, y1)))
    return F.struct((x0 + dx).alias("x0"), (y0 + dy).alias("y0"), (x1 - dx).alias("x1"), (y1 - dy).alias("y1"))


def export_rect(x: Column, y: Column, w: Column, h: Column, rows: Column, cols: Column, row: Column, col: Column) -> Column:
    """OCR-04: edges and inset rounded down, one pixel at least."""
    snap = lambda v: F.floor(v).cast("long")
    x0, x1 = _edges(x, w, cols, col, snap)
    y0, y1 = _edges(y, h, rows, row, snap)
    dx, dy = (F.greatest(F.lit(1), F.floor((b - a) * 0.1)).cast("long") for a, b in ((x0, x1), (y0, y1)))
    return F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"), F.greatest(F.lit(1).cast("long"), x1 - x0 - 2 * dx).alias("w"), F.greatest(F.lit(1).cast("long"), y1 - y0 - 2 * dy).alias("h"))


def preview_rect(x: Column, y: Column, w: Column, h: Column, rows: Column, cols: Column, row: Column, col: Column) -> Column:
    """OCR-05: edges left as fractions, rounded inset."""
    cw, ch = w / cols, h / rows
    ix, iy = F.round(cw * 0.1), F.round(ch * 0.1)
    return F.struct((x + col * cw + ix).alias("x"), (y + row * ch + iy).alias("y"), F.greatest(F.lit(1.0), cw - 2 * ix).alias("w"), F.greatest(F.lit(1.0), ch - 2 * iy).alias("h"))


def hit_test(px: Column, py: Column, x0: Column, y0: Column, cell: Column, rows: Column, cols: Column) -> Column:
    """OCR-22: the cell under a point; NULL outside."""
    r, c = F.floor((py - y0) / cell), F.floor((px - x0) / cell)
    return F.when((r >= 0) & (r < rows) & (c >= 0) & (c < cols), F.struct(r.alias("row"), c.alias("col")))


def clamp_crop(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column, least: int = 8) -> Column:
    """OCR-21, PAL-16: a rounded crop inside the image, ``least`` pixels wide and high."""
    ww, hh = clamp(F.round(w), least, img_w).cast("long"), clamp(F.round(h), least, img_h).cast("long")
    return F.struct(clamp(F.round(x).cast("long"), 0, img_w - ww).alias("x"), clamp(F.round(y).cast("long"), 0, img_h - hh).alias("y"), ww.alias("w"), hh.alias("h"))


def visible(row: Column, col: Column, r0: int, r1: int, c0: int, c1: int) -> Column:
    """RNG-01: half-open ranges of rows and columns."""
    return row.between(r0, r1 - 1) & col.between(c0, c1 - 1)


def in_bounds(row: Column, col: Column, rows: Column, cols: Column) -> Column:
    """PRD-07."""
    return (row >= 0) & (row < rows) & (col >= 0) & (col < cols)


def grid_rows(cols: Column, img_h: Column, img_w: Column) -> Column:
    """PAL-04: rows that keep the aspect, half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(cols * img_h / img_w)).cast("int")
