"""Palette matching, dominant colours and board generation (JON-14, AGG-26, 27, PAL-05 to 08, 12, 22, SRT-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.colour import distance2, rgb

PALETTE_MOST = 20_000  # colours; a palette is the dictionary of one brand


VOXEL = 4  # bits of a channel that name a voxel: 16 x 16 x 16


def nearest(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """JON-14: for each colour (id, r, g, b) the palette code of least squared distance, ties to the lower code.

    Each distinct colour is matched once, through an index: a voxel of the colour cube lists the palette entries whose least distance to it
    doesn't exceed the least of all entries' greatest distances, so the nearest entry of any colour inside is in the list. Only voxels in
    use are indexed. The palette is an array (its size is checked) for this only. A colour that isn't known in full has no match and no row.
    """
    if palette.limit(PALETTE_MOST + 1).count() > PALETTE_MOST:
        raise ValueError("palette too large: match it brand by brand")
    c = rgb(F.col("hex"))
    entries = palette.select(F.struct("code", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b")).alias("e"))
    one = entries.agg(F.collect_list("e").alias("_p"))
    side = 1 << (8 - VOXEL)
    distinct = colours.select("r", "g", "b").filter("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL").distinct()
    distinct = distinct.withColumns({f"_v{x}": F.shiftright(F.col(x), 8 - VOXEL) for x in "rgb"})
    voxel = ["_vr", "_vg", "_vb"]

    low = {x: F.col(f"_v{x}") * side for x in "rgb"}
    gap = lambda x: F.greatest(F.lit(0), low[x] - F.col(f"_e.{x}"), F.col(f"_e.{x}") - low[x] - (side - 1))  # noqa: E731  of an entry to the voxel
    reach = lambda x: F.greatest(F.abs(F.col(f"_e.{x}") - low[x]), F.abs(F.col(f"_e.{x}") - low[x] - (side - 1)))  # noqa: E731  to its farther side
    square = lambda f: f("r") * f("r") + f("g") * f("g") + f("b") * f("b")
    pairs = distinct.select(*voxel).distinct().crossJoin(F.broadcast(one)).select(*voxel, F.explode("_p").alias("_e"))
    index = pairs.groupBy(*voxel).agg(F.min(square(reach)).alias("_m"), F.collect_list(F.struct(square(gap).alias("least"), F.col("_e.code").alias("code"), *(F.col(f"_e.{x}").alias(f"e{x}") for x in "rgb"))).alias("_near"))
    index = index.select(*voxel, F.filter("_near", lambda e: e["least"] <= F.col("_m")).alias("_near"))
    met = distinct.join(index, voxel).select("r", "g", "b", F.explode("_near").alias("_e"))
    d2 = square(lambda x: F.col(x) - F.col(f"_e.e{x}"))
    matched = met.groupBy("r", "g", "b").agg(F.min(F.struct(d2.alias("d2"), F.col("_e.code").alias("code"))).alias("_b"))
    return colours.join(matched, ["r", "g", "b"]).select("id", F.col("_b.code").alias("code"), F.col("_b.d2").alias("d2"))


def dominant(pixels: DataFrame, shift: int = 4, rounded: bool = True) -> DataFrame:
    """AGG-27 (AGG-26: shift 3, truncated): mean of the most frequent colour bucket of each id, ties to the lowest bucket."""
    part = lambda c: F.shiftright(F.col(c), shift).alias(f"b{c}")
    mean = (lambda c: F.bround(F.avg(c)).cast("int")) if rounded else (lambda c: F.floor(F.avg(c)).cast("int"))
    buckets = pixels.groupBy("id", part("r"), part("g"), part("b")).agg(F.count("*").alias("n"), *(mean(c).alias(c) for c in "rgb"))
    top = buckets.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "br", "bg", "bb", "r", "g", "b")).alias("x"))
    return top.select("id", "x.r", "x.g", "x.b", (-F.col("x.n")).alias("n"))


def frequency_order(cells: DataFrame) -> DataFrame:
    """SRT-08: (job, code, n, first place), the histogram that the merge works on."""
    return cells.groupBy("job", "code").agg(F.count("*").alias("n"), F.min(F.struct("row", "col")).alias("_f")).select("job", "code", "n", F.col("_f.row").alias("first_row"), F.col("_f.col").alias("first_col"))


def _fold(colours: Column, threshold: float) -> Column:
    """Array of (code, merged): colours (code, r, g, b), most frequent first, each taken over by the first standing colour that is near."""
    kind = "struct<standing:array<struct<code:string,r:int,g:int,b:int>>,out:array<struct<code:string,merged:string>>>"
    start = F.from_json(F.lit('{"standing":[],"out":[]}'), kind)

    def step(acc: Column, x: Column) -> Column:
        near = F.filter(acc["standing"], lambda s: distance2(s, x) < threshold**2)
        # a list of one binds the search to a name, so it runs once for each colour
        grown = F.transform(F.array(F.get(near, 0)), lambda hit: F.struct(
            F.when(hit.isNull(), F.concat(acc["standing"], F.array(x))).otherwise(acc["standing"]).alias("standing"),
            F.concat(acc["out"], F.array(F.struct(x["code"].alias("code"), F.coalesce(hit["code"], x["code"]).alias("merged")))).alias("out"),
        ))
        return F.get(grown, 0).cast(kind)

    return F.aggregate(colours, start, step)["out"]


def merge_similar(cells: DataFrame, palette: DataFrame, threshold: float = 30.0) -> DataFrame:
    """PAL-06, JON-17: cells (job, row, col, code) with near colours merged into the more frequent ones of their board.

    A board's histogram (a row for each of its colours, at most a palette) is an array that is folded in order.
    """
    c = rgb(F.col("hex"))
    hist = frequency_order(cells).join(palette.select("code", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b")), "code")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first_row", "first_col", "code", "r", "g", "b")))
    changes = hist.groupBy("job").agg(ordered.alias("_o")).withColumn("_o", F.transform("_o", lambda x: F.struct(x["code"].alias("code"), x["r"].cast("int").alias("r"), x["g"].cast("int").alias("g"), x["b"].cast("int").alias("b"))))
    changes = changes.select("job", F.explode(_fold(F.col("_o"), threshold)).alias("_m")).select("job", "_m.code", "_m.merged").filter("code <> merged")
    return cells.join(changes, ["job", "code"], "left").withColumn("code", F.coalesce("merged", "code")).drop("merged")


def generate_board(pixels: DataFrame, palette: DataFrame, threshold: float = 30.0) -> DataFrame:
    """PAL-07: pixels (job, row, col, r, g, b), a row and column for the tile each lies in, to a board (job, row, col, code):

    the dominant colour of each tile, its nearest palette colour, near colours merged.
    """
    tile = F.struct("job", "row", "col")
    tiles = dominant(pixels.select(tile.alias("id"), "r", "g", "b"))
    codes = nearest(tiles, palette).select("id.job", "id.row", "id.col", "code")
    return merge_similar(codes, palette, threshold)


def board_crops(boards: DataFrame, seed: int, size: int = 48) -> DataFrame:
    """PAL-08: boards (job, row, col, code) to crop rectangles (x, y, w, h) of their cells.

    One offset for the whole grid of a board: within 2 pixels in three of four boards, within a quarter of a cell's half else.
    """
    h = lambda k: F.pmod(F.hash("job", F.lit(seed + k)), F.lit(1000))
    most = F.when(h(0) < 750, 2).otherwise(size // 8)
    off = lambda k: F.pmod(h(k), 2 * most + 1) - most
    return boards.select("job", "row", "col", "code", (F.col("col") * size + off(1)).alias("x"), (F.col("row") * size + off(2)).alias("y"), F.lit(size).alias("w"), F.lit(size).alias("h"))


def corpus_manifest(crops: DataFrame) -> DataFrame:
    """PAL-12: the manifest of a corpus of crops: code, file, row and column from 1."""
    name = F.format_string("b%d_r%03d_c%03d_%s.png", "job", F.col("row") + 1, F.col("col") + 1, "code")
    return crops.select("job", "code", name.alias("file"), (F.col("row") + 1).alias("row"), (F.col("col") + 1).alias("col"))


def redraw_colours(entries: DataFrame) -> DataFrame:
    """PAL-22: (code, r, g, b) of the entries whose colour is #RRGGBB; others can't be drawn with."""
    c = rgb(F.col("hex"))
    return entries.filter(F.col("hex").rlike("^#[0-9A-Fa-f]{6}$")).select("code", *(c[x].alias(x) for x in "rgb"))
