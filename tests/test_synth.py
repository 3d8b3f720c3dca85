"""Synthetic cells pixel by pixel, their independence of batch and layout, and board images strung together from bands."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import pixels as I
from gridloom.operators import synth as Y


def mixed(k, seed):
    for shift, factor in ((15, 2654435761), (13, 1103515245), (16, 69069)):
        k = (k * factor + seed) % 2147483648
        k ^= k >> shift
    return k


def brute(ident, code, colour, noise, seed, size):
    """One cell, one pixel after the other."""
    u = [mixed((ident + 1_000_003 * k) % 2**31, seed) / 2**31 - 0.5 for k in range(6)]
    a, s = math.radians(16 * u[0]), 1.025 + 0.25 * u[1]
    width = max(1, 6 * len(code) - 1)
    ink = 0.0 if (0.2126 * colour[0] + 0.7152 * colour[1] + 0.0722 * colour[2]) / 255 > 0.5 else 255.0
    out = np.zeros((size, size, 3), np.uint8)
    for py in range(size):
        for px in range(size):
            x, y = (px + 0.5) / size * 2 - 1, (py + 0.5) / size * 2 - 1
            z = 0.16 * u[4] * x + 0.16 * u[5] * y + 1.0
            fx, fy = (math.cos(a) * s * x + math.sin(a) * s * y + 0.2 * u[2]) / z, (-math.sin(a) * s * x + math.cos(a) * s * y + 0.2 * u[3]) / z
            col, row = math.floor(fx / (1.5 / max(width, 11)) + width / 2), math.floor(fy / (1.5 / max(width, 11)) + 3.5)
            set_ = 0 <= col < width and 0 <= row < 7 and col % 6 < 5 and col // 6 < len(code) and code[col // 6] in Y.GLYPHS and int(Y.GLYPHS[code[col // 6]].split()[row], 16) >> (4 - col % 6) & 1
            edge = py in (0, size - 1) or px in (0, size - 1)
            for c in range(3):
                v = ink if set_ else colour[c] * (0.8 if edge else 1)
                grain = mixed((ident * size * size * 3 + (py * size + px) * 3 + c) % 2**31, seed + 9) / 2**30 - 1
                out[py, px, c] = min(255, max(0, round(v + grain * noise)))
    return out


def test_render_equals_single_pixels():
    ids, codes = np.array([0, 7, 123456789, 2**40]), ["A1", "Z09", "", "M-7"]
    colours, noise = np.array([[250, 240, 230], [10, 20, 30], [128, 128, 128], [200, 0, 90]]), np.array([0.0, 6, 14, 26])
    got = Y.render(ids, codes, colours, noise, 5, 24)
    for k in range(4):
        assert np.array_equal(got[k], brute(int(ids[k]), codes[k], colours[k].tolist(), noise[k], 5, 24))
    assert (got[0] == 0).any() and not np.array_equal(got[0], Y.render(ids, codes, colours, noise, 6, 24)[0])


def test_cells_are_the_same_in_any_layout(spark):
    rows = [(i, f"A{i % 90}", f"#{i * 99991 % (1 << 24):06X}") for i in range(150)] + [(500, None, "none"), (501, "é", None), (-1, "A", "#000000"), (None, "A", "#000000")]
    df = spark.createDataFrame(rows, "id long, code string, hex string")
    one = {r.id: bytes(r.content) for r in Y.cells(df.coalesce(1), 3, 16).collect()}
    assert one == {r.id: bytes(r.content) for r in Y.cells(df.repartition(7), 3, 16, batch=5).collect()} and one.keys() == {r[0] for r in rows if r[0] is not None and r[0] >= 0}
    assert I.png_decode(one[500])[8, 8].min() > 200 and len(set(one.values())) >= 150
    few = {r.id: bytes(r.content) for r in Y.palette_cells(spark.createDataFrame([("A1", "#112233")], "code string, hex string"), 3, 3, 16).collect()}
    more = {r.id: bytes(r.content) for r in Y.palette_cells(spark.createDataFrame([("B2", "#FFFFFF"), ("A1", "#112233")], "code string, hex string"), 3, 3, 16).collect()}
    assert len(few) == 3 and len(more) == 6 and few.items() <= more.items()


def test_check_sums_add_up():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 70_000, 3, 250_000)]
    assert Y.joined_sum([(zlib.adler32(p), len(p)) for p in parts]) == zlib.adler32(b"".join(parts))


@pytest.mark.parametrize("tile, labels", [(1, False), (8, False), (20, True)])
def test_board_images(spark, tile, labels):
    cells = [(1, 0, 0, 255, 0, 0, "A1"), (1, 2, 1, 0, 0, 9, "B2"), (1, 2, 5, 1, 1, 1, "out"), (1, 7, 0, 1, 1, 1, "out"), (2, 0, 0, 9, 8, 7, None)]
    df = spark.createDataFrame(cells, "job long, row long, col long, r int, g int, b int, code string")
    boards = spark.createDataFrame([(1, 3, 2), (2, 1, 1), (3, 2, 2), (4, 0, 5)], "job long, rows int, cols int")
    got = {r.job: I.png_decode(bytes(r.content)) for r in Y.board_images(boards, df, tile, labels).collect()}
    assert {j: v.shape for j, v in got.items()} == {1: (3 * tile, 2 * tile, 3), 2: (tile, tile, 3), 3: (2 * tile, 2 * tile, 3)}
    want = np.full((3, 2, 3), 255, np.uint8)
    want[0, 0], want[2, 1] = (255, 0, 0), (0, 0, 9)
    flat = want.repeat(tile, 0).repeat(tile, 1)
    assert np.array_equal(got[1], flat) != labels and (got[3] == 255).all() and (got[2] == (9, 8, 7)).all()
    if labels:
        changed = (got[1] != flat).any(2)
        assert changed[:20, :20].sum() == Y.text_mask(["A1"])[0].sum() and not changed[20:40].any()


def test_redraw_counts(spark):
    cells = spark.createDataFrame([(1, 0, 0, "A1", "MAPPED", "#102030"), (1, 0, 1, "BLANK", "BLANK", None), (1, 1, 0, "Q9", "UNMAPPED", None), (1, 1, 1, "A2", "MAPPED", "102030")], "job long, row long, col long, code string, status string, color_hex string")
    r = Y.redraw(spark.createDataFrame([(1, 2, 2)], "job long, rows int, cols int"), cells, 4).first()
    img = I.png_decode(bytes(r.content))
    assert (r.recognised, r.missed) == (1, 2) and img[0, 0].tolist() == [16, 32, 48] and img[0, 7].tolist() == [255] * 3 and img[7, 0].tolist() == [204] * 3 == img[7, 7].tolist()


def test_boards_of_any_shape_in_one_stream(spark):
    """Boards that are cut in bands, that go over the end of a batch, that have no cell or no job, and cells on top of each other, against a plain loop."""
    rng = np.random.default_rng(8)
    sizes = {1: (400, 60), 2: (3, 2), 3: (1, 500), 4: (3, 2), 5: (2, 3)} | {k: (7, 8) for k in range(6, 60)}
    cells = [(j, int(rng.integers(-1, h + 1)), int(rng.integers(-1, w + 1)), *rng.integers(0, 256, 3).tolist(), "A1") for j, (h, w) in sizes.items() if j != 4 for _ in range(min(2 * h * w, 9000))]
    cells += [(None, 0, 0, 1, 2, 3, "A1"), (2, None, 0, 1, 2, 3, "A1"), (2, 0, None, 1, 2, 3, "A1")]
    df = spark.createDataFrame(cells, "job long, row long, col long, r int, g int, b int, code string").repartition(5)
    boards = spark.createDataFrame([(j, *x) for j, x in sizes.items()] + [(None, 1, 1)], "job long, rows int, cols int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        got = {r.job: bytes(r.content) for r in Y.board_images(boards, df, 5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got.keys() == sizes.keys() | {None} and 400 * 60 * 5 * 5 * 3 > Y.BAND and I.png_decode(got[None]).min() == 255
    for j, (h, w) in sizes.items():
        want = np.full((h, w, 3), 255, np.uint8)
        for c in sorted(c for c in cells if c[0] == j and None not in c):
            if 0 <= c[1] < h and 0 <= c[2] < w:
                want[c[1], c[2]] = c[3:6]
        assert np.array_equal(I.png_decode(got[j]), want.repeat(5, 0).repeat(5, 1))


def test_redraw_shuffles_once_and_measures_in_place(spark):
    """Many small boards: cells that are dealt out by job and carry their board's size are drawn without another shuffle; sums of decoded images."""
    ids = spark.range(4000).select((F.col("id") % 1000).alias("job"), F.floor(F.col("id") / 1000).alias("row"), (F.col("id") % 3).alias("col"))
    cells = ids.repartition("job").select("*", F.lit("A1").alias("code"), F.lit("MAPPED").alias("status"), F.lit("#010203").alias("color_hex"), F.lit(7).alias("rows"), F.lit(8).alias("cols"))
    drawn = Y.redraw(None, cells, 4)
    assert drawn._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.recognised, r.missed, r.n, r.total) for r in I.totals(drawn).collect()}
    assert got == {(4, 0, 28 * 32 * 3, 16.0 * (52 * 765 + 4 * 6))} and I.totals(drawn).count() == 1000


def test_saved_boards_are_read_back(spark, tmp_path):
    from gridloom.sources import readers, sinks

    cells = spark.createDataFrame([(j, r, c, "A1", 9 * j, 8, 7) for j in (1, 2) for r in range(2) for c in range(3)], "job long, row long, col long, code string, r int, g int, b int")
    grid = spark.createDataFrame([(1, 2, 3), (2, 2, 3)], "job long, rows int, cols int")
    listed = cells.groupBy("job").agg(F.collect_list(F.struct((F.col("row") + 1).alias("row"), (F.col("col") + 1).alias("col"), "code", F.lit("#000000").alias("color_hex"))).alias("cells"))
    docs = grid.join(listed, "job").select("job", F.lit(1).alias("format_version"), F.struct(F.lit("mard").alias("brand"), "rows", "cols", F.lit(10).alias("cell_size_px")).alias("board"), "cells")
    sinks.save_boards(docs, Y.board_images(grid, cells, 10), Y.board_images(grid, cells, 2), f"file://{tmp_path}/boards")
    found = readers.board_folder(spark, f"{tmp_path}/boards").collect()
    assert [(r.reason, r.board.rows, len(r.cells)) for r in found] == [(None, 2, 6)] * 2
    for j in (1, 2):
        whole, small = (I.png_decode((tmp_path / "boards" / str(j) / f"{n}.png").read_bytes()) for n in ("board", "preview"))
        assert whole.shape == (20, 30, 3) and small.shape == (4, 6, 3) and (whole == (9 * j, 8, 7)).all() and (small == (9 * j, 8, 7)).all()
