"""Archives read in pieces, PNG kinds and tensors of boards, against Python's own zip module and plain loops."""

import io
import os
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from gridloom.operators import pixels as I
from gridloom.sources import archive, readers


def filled(path, members, **kw):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, **kw) as z:
        for name, data in members.items():
            z.writestr(name, data, zipfile.ZIP_STORED if len(name) % 2 else zipfile.ZIP_DEFLATED)
    return members


def test_an_archive_is_read_in_pieces(spark, tmp_path):
    rnd = random.Random(6)
    one = filled(tmp_path / "a.zip", {f"d/é{k}.png": rnd.randbytes(rnd.randrange(3000)) for k in range(300)} | {"empty.png": b"", "d/": b"", "other.txt": b"x"})
    two = filled(tmp_path / "b.zip", {"x.png": b"xx"})
    filled(tmp_path / "none.zip", {})
    pieces = archive.ZipReader(str(tmp_path), "", 20_000).partitions()
    assert len([p for p in pieces if p.archive.endswith("a.zip")]) > 10 and sum(p.count for p in pieces) == 304
    got = {(os.path.basename(r.archive), r.name): bytes(r.content) for r in archive.members(spark, f"file://{tmp_path}", ".png", 20_000).collect()}
    assert got == {("a.zip", k): v for k, v in one.items() if k.endswith(".png")} | {("b.zip", "x.png"): b"xx"}
    df = archive.members(spark, str(tmp_path / "a.zip"), split=20_000)
    assert df.rdd.getNumPartitions() > 10 and df.count() == 302
    assert archive.members(spark, str(tmp_path / "none.zip")).count() == 0


def test_wide_archives_and_comments(tmp_path):
    path = tmp_path / "wide.zip"
    with zipfile.ZipFile(path, "w") as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"abc" * 1000)
        z.writestr("after", "z")
        z.comment = b"PK\x05\x06 in a comment" * 3
    names = [m.name for p in archive.ZipReader(str(path), "", 10).partitions() for _, m in archive.entries(archive.opened(str(path)), p.begin, p.count)]
    assert names == ["big", "after"]
    with archive.opened(str(path)) as f:
        assert [archive.content(f, m) for _, m in archive.entries(f, *archive.directory(f))] == [b"abc" * 1000, b"z"]
    many = tmp_path / "many.zip"
    with zipfile.ZipFile(many, "w") as z:  # more members than 16 bits count
        for k in range(65_600):
            z.writestr(f"{k}", "")
    with archive.opened(str(many)) as f:
        assert archive.directory(f)[1] == 65_600 and sum(1 for _ in archive.entries(f, *archive.directory(f))) == 65_600


def test_broken_archives(spark, tmp_path):
    (tmp_path / "no.zip").write_bytes(b"not one")
    with pytest.raises(Exception, match="not a ZIP archive"):
        archive.members(spark, str(tmp_path / "no.zip")).collect()
    filled(tmp_path / "bad.zip", {"a": b"hello world" * 50})
    data = bytearray((tmp_path / "bad.zip").read_bytes())
    data[35] ^= 255
    (tmp_path / "bad.zip").write_bytes(bytes(data))
    with pytest.raises(Exception, match="doesn't match|invalid|Error"):
        archive.members(spark, str(tmp_path / "bad.zip")).collect()


def test_manifests_with_quotes(spark, tmp_path):
    lines = '﻿编码,文件名,行,列,色相,亮度\r\nA1,"one, two.png",1,2,0,9\r\n"B ""2""",b.png,,,,\r\nshort\r\nC3,"line\r\nend.png",7,8,0,9\r\nD4,missing.png,1,1,0,9\r\n'
    filled(tmp_path / "m.zip", {"manifest.csv": lines.encode(), "one, two.png": b"1", "b.png": b"2", "line\r\nend.png": b"3", "unlisted.png": b"4"})
    got = {r.label: (r.name, r.row, r.col, bytes(r.content)) for r in readers.zip_cells(spark, str(tmp_path / "m.zip")).collect()}
    assert got == {"A1": ("one, two.png", 1, 2, b"1"), 'B "2"': ("b.png", None, None, b"2"), "C3": ("line\r\nend.png", 7, 8, b"3")}
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "mard.csv").write_text('H1,"white, warm",1,2,3,fdfbff,x\nH2,short\n\nH3,"a ""b""",1,2,3,#aaBBcc\n')
    assert sorted((r.code, r.name, r.hex) for r in readers.brand_csvs(spark, str(tmp_path / "csv"), ["mard"]).collect()) == [("H1", "white, warm", "#FDFBFF"), ("H3", 'a "b"', "#AABBCC")]


def png(lines, w, h, depth, colour, palette=b""):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    plte = chunk(b"PLTE", palette) if palette else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + plte + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def filtered(raw, bpp, kinds):
    """The lines of ``raw`` under the given filters, as an encoder writes them."""
    out, up = [], [0] * len(raw[0])
    for line, kind in zip(raw, kinds):
        row = bytearray([kind])
        for x, v in enumerate(line):
            a, b, c = (line[x - bpp] if x >= bpp else 0), up[x], (up[x - bpp] if x >= bpp else 0)
            p = a + b - c
            nearest = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            row.append((v - [0, a, b, (a + b) // 2, nearest][kind]) & 255)
        out.append(bytes(row))
        up = line
    return out


@pytest.mark.parametrize("colour, samples", [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("depth", [8, 16])
def test_png_kinds_under_every_filter(colour, samples, depth):
    rng = np.random.default_rng(colour * 20 + depth)
    h, w, by = 11, 7, depth // 8
    raw = rng.integers(0, 256, (h, w * samples * by)).tolist()
    got = I.png_decode(png(filtered(raw, samples * by, [k % 5 for k in range(h)]), w, h, depth, colour))
    want = np.array(raw, np.uint8)[:, ::by].reshape(h, w, samples)
    assert (got == (want[:, :, :3] if samples > 2 else np.repeat(want[:, :, :1], 3, 2))).all() and got.shape == (h, w, 3)


def test_sums_of_values_equal_decoded_images():
    rng = np.random.default_rng(3)
    images = [I.png_encode(rng.integers(0, 256, (h, w, 3))) for h, w in [(4, 5), (1, 1), (4, 5), (9, 2)] * 6]
    raw = rng.integers(0, 256, (5, 12)).tolist()
    images[3::5] = [png(filtered(raw, 3, [k % 5] * 5), 4, 5, 8, 2) for k in range(len(images[3::5]))]  # the filters that need the line above, and none
    images[4::7] = [png([b"\0" + bytes(x) for x in raw], 12, 5, 8, 0)] * len(images[4::7])
    want = [(v.size, float(v.sum())) for v in map(I.png_decode, images)]
    assert list(I.value_sums(images)) == want == list(I.value_sums(images, 100)) and list(I.value_sums([])) == []


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_png_palettes_and_small_depths(depth):
    rng = np.random.default_rng(depth)
    h, w, colours = 5, 13, rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
    index = rng.integers(0, 1 << depth, (h, w))
    bits = np.unpackbits(index.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - depth :].reshape(h, -1)
    lines = [b"\0" + np.packbits(b).tobytes() for b in bits]
    assert (I.png_decode(png(lines, w, h, depth, 3, colours.tobytes())) == colours[index]).all()
    if depth < 8:
        assert (I.png_decode(png(lines, w, h, depth, 0))[:, :, 1] == index * 255 // ((1 << depth) - 1)).all()


def test_board_tensors_equal_cells_one_by_one(spark):
    rng = np.random.default_rng(4)
    images = {j: rng.integers(0, 256, (20 + j, 30, 3)).astype(np.uint8) for j in range(3)}
    rects = [(j, r, c, c * 10 - 2, r * 7, c * 10 + 9, r * 7 + 8) for j in (0, 1, 3, 4) for r in range(3) for c in range(3)]
    df = spark.createDataFrame([(j, bytearray(I.png_encode(x))) for j, x in images.items()] + [(4, bytearray(b"broken"))], "job long, content binary")
    cells = spark.createDataFrame(rects, "job long, row int, col int, x0 int, y0 int, x1 int, y1 int")
    got = {(r.job, r.row, r.col): r.tensor for r in I.board_tensors(df, cells, 12, batch=4).collect()}
    assert got.keys() == {r[:3] for r in rects if r[0] != 3} and all(got[k] is None for k in got if k[0] == 4)
    for j, r, c, *box in rects:
        if j < 3:
            assert np.array_equal(np.array(got[j, r, c], np.float32), I.to_chw(I.letterbox(I.crop(images[j], *box), 12)).reshape(-1))
    one = I.cell_tensors(df.join(cells, "job").filter("job < 2"), 12)
    assert {(r.job, r.row, r.col): r.tensor for r in one.collect()} == {k: v for k, v in got.items() if k[0] < 2}
    assert I.board_tensors(df.limit(0), cells).count() == 0


def test_archives_are_written_whole(spark, tmp_path):
    from gridloom.sources import sinks

    data = io.BytesIO()
    filled(data, {"a.png": b"1"})
    sinks.write_archives(spark.createDataFrame([(k, bytearray(data.getvalue())) for k in range(3)], "job long, archive binary"), f"file://{tmp_path}/z")
    assert sorted(os.listdir(tmp_path / "z")) == ["0.zip", "1.zip", "2.zip"]
    assert archive.members(spark, f"file://{tmp_path}/z").count() == 3


def test_many_small_archives_are_one_stream(spark):
    """Archives that go over the end of a batch, with codes that look like missing values, against cells one by one; no call for each group and one shuffle."""
    cells = [(k % 700 if k % 5 else None, k // 7 % 9, k % 7, ("NA", "null", "A1")[k % 3], f"f{k}.png", k % 4, "9", bytearray(b"p" * (k % 50))) for k in range(4000)]
    df = spark.createDataFrame(cells, "job long, row long, col long, code string, file string, hue int, brightness string, png binary").repartition(4)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 90)
    try:
        archives = I.export_corrections(df)
        plan = archives._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and plan.count("Exchange hashpartitioning") == 1
        files = {r.job: bytes(r.archive) for r in archives.collect()}
        got = {(r.job, r.code, r.file, r.row, r.col, r.size) for r in I.archive_lines(archives).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {(c[0], c[3], c[4], c[1] + 1, c[2] + 1, len(c[7])) for c in cells} and files.keys() == {c[0] for c in cells}
    for job in (None, 1, 699):
        own = sorted((c for c in cells if c[0] == job), key=lambda c: (c[1:5]))
        with zipfile.ZipFile(io.BytesIO(files[job])) as z:
            assert z.testzip() is None and z.namelist() == [*(c[4] for c in own), "manifest.csv"] and all(z.read(c[4]) == bytes(c[7]) for c in own)
            assert z.read("manifest.csv").decode("utf-8-sig").split("\r\n")[1] == f"{own[0][3]},{own[0][4]},{own[0][1] + 1},{own[0][2] + 1},{own[0][5]},9"


def test_artifacts_are_immutable(spark, tmp_path):
    from gridloom.sources import sinks

    schema = "id string, manifest string, charset array<string>, model binary"
    one = spark.createDataFrame([("m1", '{"version": "v1"}', ["<blank>", "é"], bytearray(b"w")), ("m2", "{}", [], bytearray())], schema)
    for _ in range(2):  # the same again, as by a task that ran twice
        sinks.publish_artifacts(one, f"file://{tmp_path}/r")
    assert sorted(os.listdir(tmp_path / "r")) == ["m1", "m2"] and sorted(os.listdir(tmp_path / "r" / "m1")) == ["charset.json", "manifest.json", "model.onnx"]
    with pytest.raises(Exception, match="already exists"):
        sinks.publish_artifacts(spark.createDataFrame([("m1", '{"version": "v2"}', [], bytearray(b"w"))], schema), f"file://{tmp_path}/r")
    assert (tmp_path / "r" / "m1" / "manifest.json").read_text() == '{"version": "v1"}'
    assert [(r.id, r.version, r.length) for r in readers.model_registry(spark, f"{tmp_path}/r").collect()] == [("m1", "v1", 1), ("m2", None, 0)]


def test_manifest_crops_keep_their_skip_reasons(spark, tmp_path):
    import json

    (tmp_path / "a.png").write_bytes(I.png_encode(np.zeros((6, 8, 3), np.uint8)))
    (tmp_path / "b.png").write_bytes(b"no image")
    box = {"x": 1, "y": 1, "width": 3, "height": 3}
    crops = [("a.png", {}), ("a.png", {"x": 8}), ("a.png", {"x": -3}), ("a.png", {"y": -2}), ("b.png", {}), ("c.png", {}), ("a.png", {"width": 0})]
    (tmp_path / "manifest.json").write_text(json.dumps({"crops": [{"file": f, "code": f"A{k}"} | box | at for k, (f, at) in enumerate(crops)]}))
    got = {r.code: (r.reason, r.content is None) for r in readers.manifest_crops(spark, f"{tmp_path}/manifest.json").collect()}
    out = ("outside image", True)
    assert got == {"A0": (None, False), "A1": out, "A2": out, "A3": (None, False), "A4": ("unreadable image", True), "A5": ("missing file", True), "A6": out}
