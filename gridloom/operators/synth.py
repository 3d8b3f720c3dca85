"""Synthetic cells and board images in numpy, a batch at a time (PAL-13, PAL-18, PAL-20, SNK-13, OCR-19).

A cell is drawn from its id and a seed alone: every choice and every pixel's noise is an integer hash of them, and no sum runs over a batch. So the
cells of a seed are the same bytes in any batch, partition and run.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.colour import rgb
from gridloom.operators.datasets import QUALITY_LEVELS, draw, unit
from gridloom.operators.pixels import png_encode, png_file

#: Glyphs of five columns and seven rows, a number for each row, the left column the highest bit.
GLYPHS = {
    "A": "0E 11 11 1F 11 11 11", "B": "1E 11 11 1E 11 11 1E", "C": "0E 11 10 10 10 11 0E", "D": "1E 11 11 11 11 11 1E", "E": "1F 10 10 1E 10 10 1F", "F": "1F 10 10 1E 10 10 10",
    "G": "0E 11 10 17 11 11 0F", "H": "11 11 11 1F 11 11 11", "I": "0E 04 04 04 04 04 0E", "J": "07 02 02 02 02 12 0C", "K": "11 12 14 18 14 12 11", "L": "10 10 10 10 10 10 1F",
    "M": "11 1B 15 15 11 11 11", "N": "11 19 15 13 11 11 11", "O": "0E 11 11 11 11 11 0E", "P": "1E 11 11 1E 10 10 10", "Q": "0E 11 11 11 15 12 0D", "R": "1E 11 11 1E 14 12 11",
    "S": "0F 10 10 0E 01 01 1E", "T": "1F 04 04 04 04 04 04", "U": "11 11 11 11 11 11 0E", "V": "11 11 11 11 11 0A 04", "W": "11 11 11 15 15 1B 11", "X": "11 11 0A 04 0A 11 11",
    "Y": "11 11 0A 04 04 04 04", "Z": "1F 01 02 04 08 10 1F", "0": "0E 11 13 15 19 11 0E", "1": "04 0C 04 04 04 04 0E", "2": "0E 11 01 06 08 10 1F", "3": "1F 02 04 02 01 11 0E",
    "4": "02 06 0A 12 1F 02 02", "5": "1F 10 1E 01 01 11 0E", "6": "06 08 10 1E 11 11 0E", "7": "1F 01 02 04 08 08 08", "8": "0E 11 11 0E 11 11 0E", "9": "0E 11 11 0F 01 02 0C",
}
BITS = {c: (np.array([int(x, 16) for x in rows.split()])[:, None] >> np.arange(4, -1, -1) & 1).astype(bool) for c, rows in GLYPHS.items()}
#: strength of the noise by quality level
NOISE = {"clean": 0, "light": 6, "medium": 14, "heavy": 26}
WHITE, MISSED = (255, 255, 255), (204, 204, 204)


def mixed(k: np.ndarray, seed: int) -> np.ndarray:
    """``datasets.mixed`` for arrays below 2^31."""
    k = k.astype(np.uint64)
    for shift, factor in ((15, 2654435761), (13, 1103515245), (16, 69069)):
        k = (k * np.uint64(factor) + np.uint64(seed)) % np.uint64(1 << 31)
        k ^= k >> np.uint64(shift)
    return k


def text_mask(codes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(B, 7, W) raster of the texts with a column between glyphs, and the width of each; unknown characters are blank."""
    width = [max(1, 6 * len(c) - 1) for c in codes]
    out = np.zeros((len(codes), 7, max(width, default=1)), bool)
    for i, code in enumerate(codes):
        for k, ch in enumerate(code):
            if ch in BITS:
                out[i, :, 6 * k : 6 * k + 5] = BITS[ch]
    return out, np.array(width)


def homographies(ident: np.ndarray, seed: int) -> np.ndarray:
    """(B, 3, 3): where a place of the cell, from -1 to 1, comes from in the flat cell: turned by 8 degrees at most, 0.9 to 1.15 times the size, shifted and tilted a little."""
    u = [mixed((ident + 1_000_003 * k) % (1 << 31), seed) / float(1 << 31) - 0.5 for k in range(6)]
    angle = [math.radians(16 * float(a)) for a in u[0]]
    cos, sin, scale = np.array([math.cos(a) for a in angle]), np.array([math.sin(a) for a in angle]), 1.025 + 0.25 * u[1]
    h = np.zeros((len(ident), 3, 3))
    h[:, 0, 0], h[:, 0, 1], h[:, 0, 2] = cos * scale, sin * scale, 0.2 * u[2]
    h[:, 1, 0], h[:, 1, 1], h[:, 1, 2] = -sin * scale, cos * scale, 0.2 * u[3]
    h[:, 2, 0], h[:, 2, 1], h[:, 2, 2] = 0.16 * u[4], 0.16 * u[5], 1.0
    return h


def render(ident: np.ndarray, codes: list[str], colours: np.ndarray, noise: np.ndarray, seed: int, size: int = 48) -> np.ndarray:
    """(B, size, size, 3) bytes: the colour with a darker edge, the code in black or white on it warped by inverse sampling, and noise."""
    b, mask_and_width = len(ident), text_mask(codes)
    mask, width = mask_and_width
    centre = (np.arange(size) + 0.5) / size * 2 - 1
    y, x = np.meshgrid(centre, centre, indexing="ij")
    h = homographies(ident, seed)[:, :, :, None, None]
    below = h[:, 2, 0] * x + h[:, 2, 1] * y + h[:, 2, 2]
    from_x, from_y = (h[:, 0, 0] * x + h[:, 0, 1] * y + h[:, 0, 2]) / below, (h[:, 1, 0] * x + h[:, 1, 1] * y + h[:, 1, 2]) / below
    unit_ = 1.5 / np.maximum(width, 11)[:, None, None]  # of a raster column; two characters fill three quarters of a cell
    column, row = np.floor(from_x / unit_ + width[:, None, None] / 2).astype(int), np.floor(from_y / unit_ + 3.5).astype(int)
    inside = (column >= 0) & (column < width[:, None, None]) & (row >= 0) & (row < 7)
    ink = inside & mask[np.arange(b)[:, None, None], np.clip(row, 0, 6), np.clip(column, 0, mask.shape[2] - 1)]
    colours = colours.astype(np.float64)
    light = (colours @ np.array([0.2126, 0.7152, 0.0722])) / 255 > 0.5
    out = np.broadcast_to(colours[:, None, None, :], (b, size, size, 3)).copy()
    edge = np.zeros((size, size), bool)
    edge[[0, -1], :] = edge[:, [0, -1]] = True
    out[:, edge] *= 0.8
    out[ink] = np.where(light, 0.0, 255.0)[:, None, None, None].repeat(size, 1).repeat(size, 2)[ink]
    place = (ident[:, None] * (size * size * 3) + np.arange(size * size * 3)) % (1 << 31)
    grain = mixed(place, seed + 9).astype(np.float64).reshape(out.shape) / float(1 << 30) - 1
    return np.clip(np.rint(out + grain * noise[:, None, None, None]), 0, 255).astype(np.uint8)


def quality(ident: Column, seed: int) -> Column:
    return draw(unit(ident, seed), QUALITY_LEVELS)


def cells(samples: DataFrame, seed: int, size: int = 48, batch: int = 64) -> DataFrame:
    """PAL-18, PAL-20: samples (id, code, hex) to cells (id, code, level, content PNG). Ids are whole numbers, negative and NULL ones give no cell; a bad colour is white."""
    c = rgb(F.when(F.col("hex").rlike("^#[0-9A-Fa-f]{6}$"), F.col("hex")).otherwise("#FFFFFF"))
    rows = samples.filter("id >= 0").select(F.col("id").cast("long").alias("id"), F.coalesce("code", F.lit("")).alias("code"), quality(F.col("id"), seed).alias("level"), *(c[x].alias(x) for x in "rgb"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                ident, codes, levels = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_pylist()
                colours = np.stack([b.column(k).to_numpy() for k in (3, 4, 5)], 1)
                images = render(ident, codes, colours, np.array([NOISE[x] for x in levels], float), seed, size)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([png_encode(i) for i in images], pa.binary())], names=["id", "code", "level", "content"])

    return rows.mapInArrow(run, "id long, code string, level string, content binary")


def palette_cells(dictionary: DataFrame, per_colour: int, seed: int, size: int = 48) -> DataFrame:
    """PAL-13: ``per_colour`` cells of each colour of a dictionary (code, hex); ids follow from the code, so colours that are added change no other cell."""
    ids = F.crc32(F.col("code").cast("binary")) * per_colour
    return cells(dictionary.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(per_colour - 1)), lambda k: ids + k)).alias("id"), "code", "hex"), seed, size)


def _write(tile: np.ndarray, code: str, colour: np.ndarray) -> None:
    """The code in the middle of a tile, as large as it fits, in black or white."""
    mask = text_mask([code])[0][0]
    k = min(tile.shape[0] // 9, tile.shape[1] // (mask.shape[1] + 2))
    if k:
        big = mask.repeat(k, 0).repeat(k, 1)
        y, x = (tile.shape[0] - big.shape[0]) // 2, (tile.shape[1] - big.shape[1]) // 2
        tile[y : y + big.shape[0], x : x + big.shape[1]][big] = 0 if colour @ np.array([0.2126, 0.7152, 0.0722]) / 255 > 0.5 else 255


def joined_sum(parts: list[tuple[int, int]]) -> int:
    """The check sum (Adler-32) of data from those of its parts, (sum, length): both its halves add up, the second by the length times the first."""
    a, b = 1, 0
    for s, n in parts:
        b = (b + (s >> 16) + n * (a - 1)) % 65521
        a = (a + (s & 0xFFFF) - 1) % 65521
    return b << 16 | a


#: bytes of pixels that a task draws at once, but for a single row of cells that is larger
BAND = 1 << 20


def board_images(boards: DataFrame, cells_: DataFrame, tile: int = 8, labels: bool = False) -> DataFrame:
    """SNK-13, OCR-19: boards (job, rows, cols) and cells (job, row, col, r, g, b, code) to images (job, content PNG) of ``tile`` pixels a cell; places without a cell are white.

    The cells come board by board, in order, as plain columns, so that small boards of one shape are drawn together. A board is cut in bands of lines, which are
    deflated apart and strung together to one image: a task holds the cells of a board, 500 x 500 at most, and its bands as they are packed, but never the
    pixels of a large one. ``labels`` writes the codes on the tiles where they fit; a small tile makes a preview.
    """
    return _drawn(boards, cells_.withColumn("kind", F.lit(0)), tile, labels).select("job", "content")


def _drawn(boards: DataFrame | None, cells_: DataFrame, tile: int, labels: bool) -> DataFrame:
    """(job, content, recognised, missed); the cells' ``kind`` is 1 for a recognised one, 2 for a missed one. Without ``boards`` they carry rows and cols."""
    labels = labels and tile >= 9  # no letter fits on less
    code = F.coalesce("code", F.lit("")) if labels else F.lit("")
    size = [] if boards is not None else ["rows", "cols"]
    own = cells_.select("job", *(F.col(c).cast("long").alias(c) for c in ("row", "col")), *(F.col(c).cast("int").alias(c) for c in ("r", "g", "b")), code.alias("code"), "kind", *size)
    rows = boards.select("job", "rows", "cols").join(own, "job", "left") if boards is not None else own
    rows = rows.filter("rows > 0 AND cols > 0").withColumns({c: F.col(c).cast(t) for c, t in (("job", "long"), ("rows", "int"), ("cols", "int"))})
    # the window brings a board's cells together, and its first row tells where a board begins
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("job").orderBy("row", "col")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in it:
            begins = np.flatnonzero(b.column("at").to_numpy() == 1)
            if len(begins):
                yield from _images([*held, b.slice(0, begins[-1])], tile, labels)
                b, held = b.slice(begins[-1]), []
            held.append(b)
        yield from _images(held, tile, labels)

    return rows.mapInArrow(run, "job long, content binary, recognised long, missed long")


def _images(parts: list[pa.RecordBatch], tile: int, labels: bool) -> Iterator[pa.RecordBatch]:
    """The images of whole boards, a few megabytes of pixels at a time."""
    t = pa.Table.from_batches(parts) if parts else None
    if not t:
        return
    number = lambda c: t[c].combine_chunks().fill_null(-1).to_numpy()
    first = np.flatnonzero(number("at") == 1)
    board, kind = np.cumsum(number("at") == 1) - 1, number("kind")
    recognised, missed = (np.bincount(board[kind == k], minlength=len(first)) for k in (1, 2))
    height, width, row, col = number("rows")[first], number("cols")[first], number("row"), number("col")
    by_shape = np.lexsort((width, height))
    place = np.empty(len(first), np.int64)
    place[by_shape] = np.arange(len(first))
    inside = np.flatnonzero((row >= 0) & (row < height[board]) & (col >= 0) & (col < width[board]))
    colour = np.clip(np.stack([t[c].combine_chunks().fill_null(255).to_numpy() for c in "rgb"]), 0, 255).astype(np.uint8)
    inside = inside[np.lexsort((*colour[::-1, inside], col[inside], row[inside], place[board[inside]]))]  # of cells at one place the last lies on top
    place, row, col, colour = place[board[inside]], row[inside], col[inside], colour[:, inside].T
    codes = t["code"].combine_chunks().take(pa.array(inside)).to_pylist() if labels else []
    begin = 0
    while begin < len(first):
        h, w = int(height[by_shape[begin]]), int(width[by_shape[begin]])
        some = by_shape[begin : begin + max(1, 4 * BAND // (h * w * tile * tile * 3))]
        alike = (height[some] == h) & (width[some] == w)
        some = some if alike.all() else some[: alike.argmin()]
        lo, hi = np.searchsorted(place, (begin, begin + len(some)))
        streams = _streams(len(some), h, w, tile, place[lo:hi] - begin, row[lo:hi], col[lo:hi], colour[lo:hi], codes[lo:hi])
        files = [png_file(w * tile, h * tile, x) for x in streams]
        counts = [pa.array(x[some], pa.int64()) for x in (recognised, missed)]
        yield pa.RecordBatch.from_arrays([t["job"].combine_chunks().take(pa.array(first[some])), pa.array(files, pa.binary()), *counts], names=["job", "content", "recognised", "missed"])
        begin += len(some)


def _streams(n: int, h: int, w: int, tile: int, board: np.ndarray, row: np.ndarray, col: np.ndarray, colour: np.ndarray, codes: list[str]) -> list[bytes]:
    """The zlib streams of ``n`` boards of h x w cells, drawn and deflated band by band."""
    packed: list[list[tuple[bytes, int, int]]] = [[] for _ in range(n)]
    deep = max(1, BAND // (w * tile * tile * 3))
    for top in range(0, h, deep):
        lines = min(deep, h - top)
        here = np.arange(len(row)) if lines == h else np.flatnonzero((row >= top) & (row < top + lines))
        flat = np.full((n, lines, w, 3), 255, np.uint8)
        flat[board[here], row[here] - top, col[here]] = colour[here]
        image = flat.repeat(tile, 1).repeat(tile, 2)
        for k in here if codes else ():
            if codes[k]:
                y, x = (row[k] - top) * tile, col[k] * tile
                _write(image[board[k], y : y + tile, x : x + tile], codes[k], flat[board[k], row[k] - top, col[k]])
        raw = np.zeros((n, lines * tile, 1 + 3 * w * tile), np.uint8)
        raw[:, :, 1:] = image.reshape(n, lines * tile, -1)
        for own, data in zip(packed, raw):
            pack = zlib.compressobj(6, zlib.DEFLATED, -15)
            own.append((pack.compress(data) + pack.flush(zlib.Z_SYNC_FLUSH), zlib.adler32(data), data.size))
    return [b"\x78\x01" + b"".join(x[0] for x in own) + b"\x03\x00" + joined_sum([x[1:] for x in own]).to_bytes(4, "big") for own in packed]


def redraw(boards: DataFrame | None, cells_: DataFrame, tile: int = 8) -> DataFrame:
    """OCR-19: recognised cells (job, row, col, code, status, color_hex) drawn again: (job, content, recognised, missed). A mapped cell has its colour and code, a blank one
    is white, an unmapped one grey; only #RRGGBB colours count (PAL-22). Without ``boards`` the cells carry rows and cols of their board, which saves a join where each board has a cell."""
    known = (F.col("status") == "MAPPED") & F.coalesce(F.col("color_hex").rlike("^#[0-9A-Fa-f]{6}$"), F.lit(False))
    whole = F.when(known, F.conv(F.substring("color_hex", 2, 6), 16, 10).cast("int")).when(F.col("code") == "BLANK", 0xFFFFFF).otherwise(0xCCCCCC)
    kind = F.when(known, 1).when(~known & (F.col("code") != "BLANK"), 2).otherwise(0)
    size = [] if boards is not None else ["rows", "cols"]
    drawn = cells_.select("job", "row", "col", *size, whole.alias("rgb"), F.when(known, F.col("code")).otherwise("").alias("code"), kind.alias("kind"))
    channels = (F.shiftright("rgb", by).bitwiseAND(255).alias(c) for c, by in (("r", 16), ("g", 8), ("b", 0)))
    return _drawn(boards, drawn.select("job", "row", "col", *size, *channels, "code", "kind"), tile, labels=True)
