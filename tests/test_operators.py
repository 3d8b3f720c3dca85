"""Golden grids and scalar models."""

import datetime
import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import codes as C
from gridloom.functions import colour as K
from gridloom.operators import cells as O
from gridloom.operators import corrections as R
from gridloom.operators import datasets as D
from gridloom.operators import decode as X
from gridloom.operators import dictionary as L
from gridloom.operators import evaluation as E
from gridloom.operators import jobs as J
from gridloom.operators import palette as P
from gridloom.operators import pixels as I
from gridloom.sources import readers, sinks
from gridloom.streaming import lifecycle as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def colours(spark):
    return spark.createDataFrame([("H1", "a", "FDFBFF", "mard"), ("H2", "b", "A9A9A9", "mard"), ("H3", "c", "555555", "mard")], "code string, name string, hex string, brand string")


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(1, 0, 0, "H1", 0.87, None), (1, 0, 1, "h2", 0.99, None), (1, 1, 0, "Z99", 0.31, None), (1, 1, 1, "BLANK", None, None)]
    return spark.createDataFrame(rows, "job long, row long, col long, code string, confidence double, corrected_code string")


def test_status_of_a_grid(spark, grid, colours):
    got = {(r.row, r.col): (r.status, r.color_hex) for r in O.with_status(grid, colours).collect()}
    assert got == {(0, 0): ("MAPPED", "FDFBFF"), (0, 1): ("MAPPED", "A9A9A9"), (1, 0): ("UNMAPPED", None), (1, 1): ("BLANK", None)}


def test_review_ignores_unknown_confidence(spark, grid, colours):
    assert {(r.row, r.col) for r in O.review(O.with_status(grid, colours), 0.9).collect()} == {(0, 0), (1, 0)}


def test_gaps_and_redelivery(spark):
    raw = spark.createDataFrame([(1, 0, 0, "A1", 0.5, 1), (1, 0, 0, "A2", 0.6, 2), (1, 0, 1, "B1", 0.7, 3)], "job long, row long, col long, code string, confidence double, n int")
    last = O.latest(raw, O.KEY, F.desc("n"))
    full = O.fill_gaps(spark.createDataFrame([(1, 2, 2)], "job long, rows int, cols int"), last)
    assert sorted((r.row, r.col, r.code, r.confidence) for r in full.collect()) == [(0, 0, "A2", 0.6), (0, 1, "B1", 0.7), (1, 0, "UNMAPPED", 0.0), (1, 1, "UNMAPPED", 0.0)]


def test_gaps_are_found_without_a_shuffle_of_places(spark):
    """Against a plain loop: no places go through an exchange, cells beside a grid or without a job stay or fall away, two cells at a place stay."""
    grids = {1: (2, 3), 2: (1, 1), 3: (0, 4), 4: (30, 40), 5: (2, 2), None: (1, 2)}
    rnd = np.random.default_rng(5)
    cells = [(4, int(rnd.integers(-2, 32)), int(rnd.integers(-2, 42)), f"A{k}", k / 900) for k in range(900)]
    cells += [(1, 0, 1, None, None), (1, 1, 2, "UNMAPPED", 0.5), (1, 1, 2, "B", 0.5), (1, 2, 0, "out", 0.1), (1, 0, 3, "out", 0.1), (2, 0, 0, "C", 1.0), (2, None, 0, "out", 1.0), (9, 0, 0, "out", 1.0), (None, 0, 0, "out", 1.0), (3, 0, 0, "out", 1.0)]
    jobs = spark.createDataFrame([(j, *x) for j, x in grids.items()], "job long, rows int, cols int").repartition(3)
    df = spark.createDataFrame(cells, "job long, row long, col long, code string, confidence double").repartition(3)
    inside = [c for c in cells if c[0] is not None and c[1] is not None and 0 <= c[1] < grids.get(c[0], (0, 0))[0] and 0 <= c[2] < grids[c[0]][1]]
    gaps = [(j, r, c) for j, (h, w) in grids.items() for r in range(h) for c in range(w) if (j, r, c) not in {x[:3] for x in inside}]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, O.fill_gaps(jobs, df).collect()), key=key) == sorted(cells + [(*g, "UNMAPPED", 0.0) for g in gaps], key=key)
    full = O.fill_gaps(jobs, df, strays=False)
    assert full.dtypes == [("job", "bigint"), ("row", "bigint"), ("col", "bigint"), ("code", "string"), ("confidence", "double")]
    assert sorted(map(tuple, full.collect()), key=key) == sorted(inside + [(*g, "UNMAPPED", 0.0) for g in gaps], key=key)
    assert sorted(map(tuple, O.missing(jobs, df).collect()), key=key) == sorted(gaps, key=key)
    plan = full.groupBy("job").count()._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Generate" not in plan[plan.index("Exchange") :]  # the tree's lower nodes come later


def test_natural_order(spark):
    df = spark.createDataFrame([(c,) for c in ("Z", "A10", "A2", "BLANK", "", "A1X", "MARD-A10", "B1", "A1")], "code string")
    assert [r.code for r in df.orderBy(C.natural_key(F.col("code"))).collect()] == ["", "A1", "A1X", "A2", "A10", "B1", "BLANK", "MARD-A10", "Z"]
    assert [r.code for r in df.filter("code IN ('A10', 'A2', 'BLANK', 'Z')").orderBy(C.display_key(F.col("code"))).collect()] == ["A2", "A10", "Z", "BLANK"]


@pytest.mark.parametrize("name,label,code", [("H7_0000_marked.png", "H7", "H7"), ("r001_c002_A10.png", "A10", "A10"), ("sample_000_H15.png", "SAMPLE", "H15"), ("BLANK_r1_c2_h0_v230.png", "BLANK", "BLANK"), ("blank_3.png", "BLANK", "BLANK"), ("EMPTY_3.png", "BLANK", "BLANK"), ("H2_r1_c1_h0_v169.png", "H2", "H2"), ("123.png", None, None)])
def test_labels_of_file_names(spark, name, label, code):
    assert one(spark, C.label_of(F.lit(name))) == label
    assert one(spark, C.code_from_filename(F.lit(name))) == code


def test_correction_batch(spark, grid, colours):
    up = lambda rows: spark.createDataFrame(rows, "job long, row long, col long, ord int, new_code string")
    bounds = spark.createDataFrame([(1, 2, 2)], "job long, rows int, cols int")
    bad = R.violations(up([(1, 0, 0, 1, "X99"), (1, 9, 9, 2, "H1"), (1, 1, 1, 3, "blank")]), grid, colours, bounds)
    assert sorted((r.ord, r.error) for r in bad.collect()) == [(1, "INVALID_CODE"), (2, "CELL_OUT_OF_BOUNDS")]
    ok = R.normalized(up([(1, 0, 0, 1, " h2 "), (1, 0, 0, 2, ""), (1, 0, 1, 3, None), (1, 1, 0, 4, "H3")]))
    assert [(r.corrected, r.reverted) for r in R.counts(grid, ok).collect()] == [(2, 1)]
    assert {(r.row, r.col): (r.code, r.corrected_code) for r in R.apply(grid, ok).collect()}[(1, 0)] == ("Z99", "H3")
    assert R.accepted(up([(1, 0, 0, 1, "X99")]), bad).count() == 0


def test_dictionary_conflicts_equal_a_sequential_model(spark):
    rng = np.random.default_rng(3)
    rows = [(f"A{rng.integers(6)}", f"n{i}", f"#{rng.integers(4):06X}", f"b{rng.integers(3)}", int(rng.integers(3)), i) for i in range(80)]
    groups, order = {}, []
    for r in rows:
        groups.setdefault((r[0], r[2]), []).append(r)
    order = sorted(groups, key=lambda g: (not any(r[3] == "b1" for r in groups[g]), groups[g][0][5]))
    used, want = set(), set()
    for g in order:
        if g[0] not in used:
            used.add(g[0])
            r = min(groups[g], key=lambda r: (r[4], r[5]))
            want.add((r[0], r[1], r[2], r[3]))
        else:
            for r in groups[g]:
                want.add((f"{r[3].upper()}-{r[0]}", r[1], r[2], r[3]))
    got = L.build_final(spark.createDataFrame(rows, "code string, name string, hex string, brand string, brand_rank int, ord int"), "b1").collect()
    names = [r.code for r in got]
    assert len(names) == len(set(names))
    assert {tuple(r) for r in got} <= want and {n for n, *_ in want} == set(names)


def walk(lp, codes, chars):
    node, last, live, score, out = "", None, False, 0.0, ""
    for step in lp:
        kids = sorted({c[len(node)] for c in codes if c.startswith(node) and len(c) > len(node)}, key=chars.index)
        best = max(kids, key=lambda k: step[chars.index(k)], default=None)
        if best is not None and step[chars.index(best)] > step[0]:
            score += step[chars.index(best)]
            if not (live and best == last):
                node, last = node + best, best
            live = True
        else:
            live = False
    return node, score


def test_trie_decode_equals_a_scalar_walk():
    chars = ["<blank>", *"ABC"]
    codes = ["A", "AB", "ABC", "AA", "BCA", "C"]
    x = np.random.default_rng(5).normal(size=(300, 9, 4)).round(1)
    got, score = X.Trie(codes, chars).decode(x)
    for lp, g, s in zip(x, got, score, strict=True):
        assert (g, pytest.approx(s)) == walk(lp, codes, chars)


def test_greedy_collapse(spark):
    f = lambda k: [5.0 if i == k else 0.0 for i in range(3)]
    df = spark.createDataFrame([([f(1), f(1), f(0), f(1), f(2)],), ([f(0)] * 3,), ([[1.0, 1.0, 1.0]],)], "x array<array<double>>")
    g = [r.g for r in df.select(X.greedy(F.transform("x", X.log_softmax)).alias("g")).collect()]
    assert [x.indices for x in g] == [[1, 1, 2], [], []] and g[1].confidence == 0.0
    assert g[0].confidence == pytest.approx(np.exp(5) / (np.exp(5) + 2))


def test_resample_and_letterbox():
    x = np.random.default_rng(0).integers(0, 255, (16, 16, 3)).astype(float)
    assert np.allclose(I.resize_area(x, 16, 16), x)
    assert np.allclose(I.resize_area(x, 8, 8), x.reshape(8, 2, 8, 2, 3).mean((1, 3)))
    assert (I.letterbox(np.zeros((0, 4, 3)), 48) == 255).all()
    box = I.letterbox(np.zeros((10, 20, 3)), 48)
    assert (box[:12] == 255).all() and (box[12:36] == 0).all()
    assert I.to_chw(box).shape == (3, 48, 48)


def test_png_and_export(spark):
    img = np.random.default_rng(1).integers(0, 255, (5, 7, 3)).astype(np.uint8)
    assert (I.png_decode(I.png_encode(img)) == img).all()
    cells = spark.createDataFrame([(1, 0, 0, "H2", "H2_r1_c1_h0_v169.png", 0, 169, bytearray(I.png_encode(img)))], "job long, row long, col long, code string, file string, hue int, brightness int, png binary")
    z = zipfile.ZipFile(io.BytesIO(I.export_corrections(cells).first()["archive"]))
    assert z.read("manifest.csv").decode("utf-8").startswith("﻿") and "H2,H2_r1_c1_h0_v169.png,1,1," in z.read("manifest.csv").decode()
    t = I.cell_tensors(spark.createDataFrame([(1, 0, 0, bytearray(I.png_encode(img)), 0, 0, 7, 5)], "job long, row long, col long, content binary, x0 int, y0 int, x1 int, y1 int"), 8)
    assert len(t.first()["tensor"]) == 192


def test_frequency_merge_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    pal = [(f"C{i}", "#%02X%02X%02X" % tuple(rng.integers(0, 90, 3))) for i in range(9)]
    cells = [(1, r, c, f"C{rng.integers(9)}") for r in range(8) for c in range(8)]
    count = pd.Series([c[3] for c in cells]).value_counts()
    first = {}
    for c in cells:
        first.setdefault(c[3], len(first))
    order = sorted(count.index, key=lambda k: (-count[k], first[k]))
    rgb = {k: np.array([int(h[i : i + 2], 16) for i in (1, 3, 5)]) for k, h in pal}
    to = {}
    for i, hi in enumerate(order):
        if hi not in to:
            for lo in order[i + 1 :]:
                if lo not in to and np.sqrt(((rgb[hi] - rgb[lo]) ** 2).sum()) < 30:
                    to[lo] = hi
    got = P.merge_similar(spark.createDataFrame(cells, "job long, row long, col long, code string"), spark.createDataFrame(pal, "code string, hex string"))
    assert {(r.row, r.col): r.code for r in got.collect()} == {(r, c): to.get(k, k) for _, r, c, k in cells}


def test_hues(spark):
    for hex_, hue, raw in (("#FF0000", 0, 0.0), ("#00FF00", 120, 120.0), ("#0000FF", 240, 240.0), ("#777777", 0, -1.0), ("#FF0080", 330, -30.117647)):
        c = K.rgb(F.lit(hex_))
        assert one(spark, K.hue(c)) == hue and one(spark, K.sort_hue(c)) == pytest.approx(raw)


def test_gate_tolerance(spark):
    s = "set_name string, blank_acc double, code_acc double, overall double"
    rows = E.gate(spark.createDataFrame([("a", 0.9949, 0.995, 0.9951), ("b", 1.0, 1.0, 1.0)], s), spark.createDataFrame([("a", 1.0, 1.0, 1.0), ("b", 0.9, 0.9, 0.9)], s))
    assert {(r.set_name, r.metric) for r in rows.filter("fails").collect()} == {("a", "blank_acc")}
    assert E.verdict(rows).first()["passes"] is False


def test_split_sizes(spark):
    rows = [(i, f"c{n}") for n in (1, 2, 3, 5, 10) for i in range(100 * n, 100 * n + n)]
    df = D.stratified_split(spark.createDataFrame(rows, "id long, code string"), 0.5, 7)
    got = {r.code: r.n for r in df.groupBy("code").agg(F.count_if(F.col("split") == "val").alias("n")).collect()}
    assert got == {"c1": 0, "c2": 1, "c3": 2, "c5": 2, "c10": 5}


def test_job_list_errors(spark):
    jobs = spark.createDataFrame([(1, "PENDING", "2026-01-01")], "id long, status string, created_at string")
    assert J.list_jobs(jobs, "FAILED").count() == 0 and J.list_jobs(jobs).count() == 1
    with pytest.raises(J.ApiError, match="INVALID_JOB_STATUS"):
        J.list_jobs(jobs, "NOPE")


EVENTS = [(1, 0, 1, "progress", 3), (1, 0, 2, "completed", 9), (2, 0, 1, "failed", None), (2, 1, 1, "failed", None), (2, 2, 1, "completed", 4), (3, 0, 1, "failed", None), (3, 1, 1, "progress", 5), (3, 1, 2, "failed", None), (3, 2, 1, "failed", None), (3, 2, 2, "completed", 9), (4, 0, 1, "created", None), (1, 0, 1, "progress", 3), (5, 0, 2, "progress", 1), (5, 0, 1, "progress", 7)]


def test_stream_equals_replay(spark, tmp_path):
    df = spark.createDataFrame([(*e, datetime.datetime(2026, 1, 1)) for e in EVENTS], "job long, attempt int, seq long, kind string, processed long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for k, v in (S.STATE_STORE | S.BOUNDED).items():
        spark.conf.set(k, v)
    stream = S.track(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("lifecycle").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    for k in S.STATE_STORE | S.BOUNDED:
        spark.conf.unset(k)
    got = {r.job: tuple(r)[1:] for r in spark.table("lifecycle").collect()}
    want = {r.job: tuple(r)[1:] for r in S.replay(df).collect()}
    assert got == want
    assert want[1] == ("SUCCEEDED", 0, 0, 9) and want[2] == ("SUCCEEDED", 2, 2, 4) and want[3] == ("FAILED", 2, 2, 5) and want[4][0] == "PENDING" and want[5] == ("PROCESSING", 0, 0, 7)


def test_sources(spark, tmp_path):
    (tmp_path / "seed.json").write_text(json.dumps([{"brand": "mard", "code": "H1", "color_name": "w", "color_hex": "#FDFBFF"}, {"code": "H2", "name": "g", "hex": "A9A9A9"}, {"code": "H3"}]))
    assert sorted(tuple(r)[:4] for r in readers.color_seed(spark, str(tmp_path / "seed.json")).collect()) == [("H1", "w", "FDFBFF", "mard"), ("H2", "g", "A9A9A9", "mard")]
    (tmp_path / "map.json").write_text(json.dumps({"#FFFFFF": {"a": "A1", "b": "B1"}}))
    assert sorted(map(tuple, readers.colour_mapping(spark, str(tmp_path / "map.json")).collect())) == [("#FFFFFF", "a", "A1"), ("#FFFFFF", "b", "B1")]
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "mard.csv").write_text("H1,w,1,2,3,fdfbff,x\n\nH2,bad\n")
    assert [(r.code, r.hex, r.brand_rank) for r in readers.brand_csvs(spark, str(tmp_path / "csv"), ["mard"]).collect()] == [("H1", "#FDFBFF", 0)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.png", b"1")
        z.writestr("manifest.csv", "﻿编码,文件名\r\nH1,a.png\r\n")
    assert [(r.label, bytes(r.content)) for r in readers.zip_cells(spark, str(tmp_path / "z.zip")).collect()] == [("H1", b"1")]
    m = tmp_path / "models" / "m1"
    m.mkdir(parents=True)
    (m / "model.onnx").write_bytes(b"x")
    (m / "manifest.json").write_text("{}")
    assert [(r.id, r.name, r.input_name) for r in readers.model_registry(spark, str(tmp_path / "models")).collect()] == [("m1", "m1", "images")]
    (tmp_path / "b.json").write_text(json.dumps({"format_version": 1, "board": {"brand": "x", "rows": 1, "cols": 2}, "cells": [{"row": 1, "col": 1, "code": "A1", "color_hex": "#000000"}]}))
    assert [(r.reason, r.blur_level) for r in readers.boards(spark, str(tmp_path / "b.json")).collect()] == [("size mismatch", "unknown")]


def test_sinks(spark, tmp_path):
    bad = spark.createDataFrame([("A1", "n", "#00", "b", 1)], "code string, name string, hex string, brand string, sort_order int")
    assert sinks.write_library(bad, str(tmp_path / "lib")) and not (tmp_path / "lib").exists()
    about = {"name": "m", "version": "v1"}
    sinks.publish(spark, b"w", about, str(tmp_path / "art"), str(tmp_path / "ptr"))
    with pytest.raises(Exception, match="already exists"):
        sinks.publish(spark, b"w", about, str(tmp_path / "art"), str(tmp_path / "ptr"))
    sinks.write_manifest(spark.createDataFrame([("H1", "a.png", 1, 1, "0", 9)], "code string, file string, row int, col int, hue string, brightness int").coalesce(1), str(tmp_path / "man"))
    assert readers.manifest(spark, str(tmp_path / "man")).first()["file"] == "a.png"


def test_image_variants():
    img = np.random.default_rng(2).integers(0, 256, (9, 12, 3)).astype(np.uint8)
    out = I.augment(img)
    assert list(out) == ["orig", "rot_m10", "rot_p10", "scale_08", "scale_12", "flip", "blur"]
    assert all(v.shape == img.shape and v.dtype == np.uint8 for v in out.values())
    assert (out["flip"][:, ::-1] == img).all() and (out["scale_08"] <= img).all() and (out["scale_12"] >= img).all()
    flat = np.full((5, 7, 3), 90, np.uint8)
    assert all((I.augment(flat)[k] == 90).all() for k in ("rot_m10", "rot_p10", "blur", "flip"))
    k = np.exp([-2.0, 0, -2]) / np.exp([-2.0, 0, -2]).sum()  # kernel of three at a deviation of a half
    want = sum(k[i] * k[j] * img[3 + i - 1, 4 + j - 1].astype(float) for i in range(3) for j in range(3))
    assert np.abs(out["blur"][3, 4] - want).max() <= 0.5
    dot = np.zeros((21, 21, 3), np.uint8)
    dot[10, 18] = 255  # eight pixels right of the middle; a turn by 10 degrees moves it up or down by one or two
    up, down = (np.argwhere(I.augment(dot)[k][..., 0] > 60)[:, 0] for k in ("rot_p10", "rot_m10"))
    assert {x < 10 for x in up} == {True} and {x > 10 for x in down} == {True}


def test_ranks_by_slices_equal_one_sort(spark):
    rows = [(i, None if i % 7 == 0 else f"g{i % 3}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = {r.id: (r._rank, r._n) for r in D.ranked(df, 5, "id", "g").collect()}
    for g in {x for _, x in rows}:
        ids = sorted((i for i, x in rows if x == g), key=lambda i: ((i * 2654435761 + 5) % 2147483648, i))
        assert [got[i] for i in ids] == [(k + 1, len(ids)) for k in range(len(ids))]
    assert D.cut(df, 0.1, 5).filter("split = 'train'").count() == 450
