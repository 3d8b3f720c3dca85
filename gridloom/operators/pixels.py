"""Pixels of cells in numpy: crop, area resample, letterbox, tensors, PNG (OCR-01, 06 to 09, 20, ARR-05, COL-09, SRC-19, SNK-09)."""

from __future__ import annotations

import csv
import io
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType
from pyspark.sql.window import Window


def area_weights(src: int, dst: int) -> np.ndarray:
    """(dst, src): share of each source line in each target line, by overlap."""
    edges = np.arange(dst + 1) * (src / dst)
    lo, hi = edges[:-1, None], edges[1:, None]
    at = np.arange(src)[None, :]
    w = np.clip(np.minimum(at + 1, hi) - np.maximum(at, lo), 0, None)
    return w / w.sum(1, keepdims=True)


def resize_area(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """OCR-07: the area-weighted mean, as two matrix products."""
    return np.einsum("ya,abc,xb->yxc", area_weights(img.shape[0], height), img.astype(np.float64), area_weights(img.shape[1], width), optimize=True)


def crop(img: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """OCR-06: pixels of a rectangle, clamped to the image."""
    h, w = img.shape[:2]
    x0, x1 = sorted((min(max(x0, 0), w), min(max(x1, 0), w)))
    y0, y1 = sorted((min(max(y0, 0), h), min(max(y1, 0), h)))
    return img[y0:y1, x0:x1]


def letterbox(img: np.ndarray, size: int = 48) -> np.ndarray:
    """OCR-08: aspect kept, centred on white; an empty crop is all white."""
    out = np.full((size, size, 3), 255.0)
    h, w = img.shape[:2]
    if h and w:
        scale = min(size / h, size / w)
        nh, nw = (min(size, max(1, int(np.floor(v * scale + 0.5)))) for v in (h, w))
        y, x = (size - nh) // 2, (size - nw) // 2
        out[y : y + nh, x : x + nw] = resize_area(img, nh, nw)
    return out


def to_chw(img: np.ndarray) -> np.ndarray:
    """ARR-05: quantised to bytes, channels first, in 0 to 1."""
    return np.clip(np.floor(img + 0.5), 0, 255).transpose(2, 0, 1).astype(np.float32) / 255


def to_gray(img: np.ndarray) -> np.ndarray:
    """COL-09: truncated luma."""
    r, g, b = (img[..., k].astype(np.float64) for k in range(3))
    return (r * 0.299 + g * 0.587 + b * 0.114).astype(np.uint8)


def png_file(width: int, height: int, stream: bytes) -> bytes:
    """An 8-bit RGB PNG around a zlib stream of its lines."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", stream) + chunk(b"IEND", b"")


def png_encode(img: np.ndarray) -> bytes:
    """8-bit RGB PNG."""
    h, w = img.shape[:2]
    raw = np.zeros((h, 1 + 3 * w), np.uint8)
    raw[:, 1:] = img.astype(np.uint8).reshape(h, -1)
    return png_file(w, h, zlib.compress(raw.tobytes()))


def _unpacked(data: bytes) -> tuple[int, int, int, int, bytes | None, bytes]:
    """(width, height, depth, colour kind, palette, inflated lines) of a PNG."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts, palette = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
            if colour not in CHANNELS or lace:
                raise ValueError("interlaced or of an unknown kind")
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    return w, h, depth, colour, palette, zlib.decompress(b"".join(parts))


def png_decode(data: bytes) -> np.ndarray:
    """SRC-19: PNG of any colour kind and depth, without interlace, to (h, w, 3) bytes; alpha is left out, 16-bit samples keep their high byte."""
    w, h, depth, colour, palette, stream = _unpacked(data)
    samples = CHANNELS[colour]
    bpp, width = max(1, samples * depth // 8), -(-w * samples * depth // 8)
    lines = np.frombuffer(stream, np.uint8).reshape(h, 1 + width)
    plain = not lines[:, 0].any()
    out = lines[:, 1:].copy() if plain else np.zeros((h, width), np.uint8)
    for y in () if plain else range(h):
        line, kind, up = lines[y, 1:], lines[y, 0], out[y - 1] if y else np.zeros(width, np.uint8)
        if kind == 1:  # sums along the line, channel by channel
            whole = np.zeros(-(-width // bpp) * bpp, np.uint8)
            whole[:width] = line
            out[y] = np.cumsum(whole.reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)[:width]
        elif kind in (0, 2):
            out[y] = line + up * np.uint8(kind == 2)
        else:
            out[y] = np.frombuffer(_unfiltered(line.tolist(), up.tolist(), bpp, kind == 4), np.uint8)
    if depth < 8:
        values = np.unpackbits(out, axis=1).reshape(h, -1, depth) @ (1 << np.arange(depth)[::-1]).astype(np.uint8)
        out = values[:, : w * samples] if colour == 3 else (values[:, : w * samples].astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    elif depth == 16:
        out = out[:, ::2]
    out = out.reshape(h, w, samples)
    if colour == 3:
        return np.frombuffer(palette, np.uint8).reshape(-1, 3)[out[:, :, 0]]
    return np.repeat(out[:, :, :1], 3, axis=2) if samples < 3 else np.ascontiguousarray(out[:, :, :3])


def _unfiltered(line: list[int], up: list[int], bpp: int, paeth: bool) -> bytes:
    """A line whose bytes depend on those left of them, by the mean or by the nearest of left, up and up left."""
    out = bytearray(len(line))
    for x, v in enumerate(line):
        a, b = out[x - bpp] if x >= bpp else 0, up[x]
        if paeth:
            c = up[x - bpp] if x >= bpp else 0
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        else:
            guess = (a + b) >> 1
        out[x] = (v + guess) & 255
    return bytes(out)


#: Samples of a pixel by the colour kind of a PNG.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def board_tensors(images: DataFrame, cells: DataFrame, size: int = 48, batch: int = 128) -> DataFrame:
    """OCR-01, OCR-20: images (job, content PNG) and cells (job, row, col, x0, y0, x1, y1) to letterboxed tensors (job, row, col, tensor).

    The cells of a board, 500 x 500 at most, travel beside its image as one row, so an image is sent and decoded once and its cells are cut inside; batches of
    ``batch`` tensors run on across boards and leave as they are made. Boards without cells and cells without an image give no rows; an image that can't
    be decoded gives its cells with a NULL tensor.
    """
    by_board = cells.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("row", "col", "x0", "y0", "x1", "y1"))).alias("cells"))
    boards = images.select("job", "content").join(by_board, "job")

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in it:
            for job, content, own in zip(*(c.to_pylist() if k != 2 else c for k, c in enumerate(b.columns)), strict=True):
                try:
                    img = png_decode(content)
                except (ValueError, TypeError, struct.error, zlib.error):
                    img = None
                for c in own.values if hasattr(own, "values") else own:
                    c = c.as_py() if hasattr(c, "as_py") else c
                    yield job, c["row"], c["col"], None if img is None else to_chw(letterbox(crop(img, c["x0"], c["y0"], c["x1"], c["y1"]), size)).reshape(-1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = made(it)
        while some := list(islice(rows, batch)):
            job, row, col, tensor = zip(*some)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (job, row, col)), pa.array(tensor, pa.list_(pa.float32()))], names=["job", "row", "col", "tensor"])

    return boards.select("job", "content", "cells").mapInArrow(run, "job long, row long, col long, tensor array<float>")


def cell_tensors(cells: DataFrame, size: int = 48, batch: int = 128) -> DataFrame:
    """OCR-01, OCR-20 for cells with images of their own (job, row, col, content PNG, x0, y0, x1, y1); cells of boards: ``board_tensors``."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                decoded = {c: png_decode(c) for c in set(part["content"].map(bytes))}
                out = [to_chw(letterbox(crop(decoded[bytes(r.content)], r.x0, r.y0, r.x1, r.y1), size)).reshape(-1) for r in part.itertuples()]
                yield pd.DataFrame({"job": part["job"], "row": part["row"], "col": part["col"], "tensor": out})

    return cells.mapInPandas(run, "job long, row long, col long, tensor array<float>")


def infer(tensors: DataFrame, model: bytes, size: int = 48) -> DataFrame:
    """OCR-09: logits of the tensors by an ONNX model, loaded once for each task."""
    shared = tensors.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        session = onnxruntime.InferenceSession(shared.value)
        name = session.get_inputs()[0].name
        for pdf in it:
            x = np.stack(pdf["tensor"].to_list()).astype(np.float32).reshape(len(pdf), 3, size, size)
            y = np.asarray(session.run(None, {name: x})[0]).transpose(1, 0, 2)
            yield pd.DataFrame({"job": pdf["job"], "row": pdf["row"], "col": pdf["col"], "logits": list(y.reshape(len(pdf), -1).astype(np.float64))})

    return tensors.mapInPandas(run, "job long, row long, col long, logits array<double>")


#: Header of a manifest.
MANIFEST = ["编码", "文件名", "行", "列", "色相", "亮度"]


class CorrectionsZip:
    """SNK-09: the archive of a blueprint's corrected cells, filled one after the other, with their manifest."""

    def __init__(self):
        self.out, self.lines = io.BytesIO(), [",".join(MANIFEST)]
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)

    def add(self, code: str, file: str, row: int | None, col: int | None, hue: object, brightness: object, png: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(file), png)
        place = ",".join("" if x is None else str(x + 1) for x in (row, col))
        self.lines.append(f"{code},{file},{place},{hue},{brightness}")

    def closed(self) -> bytes:
        with self.zip:
            self.zip.writestr(zipfile.ZipInfo("manifest.csv"), "\ufeff" + "\r\n".join(self.lines) + "\r\n")
        return self.out.getvalue()


def export_corrections(cells: DataFrame) -> DataFrame:
    """SNK-09 over a relation (job, row, col, code, file, hue, brightness, png): (job, archive), one archive for each blueprint, its cells in order.

    The cells come as a stream in the order of the archives, so a task holds the archive that it fills and those of a batch, and no call is made for each blueprint.
    """
    # the window brings a blueprint's cells together, and its first row tells where an archive begins
    at = F.row_number().over(Window.partitionBy("job").orderBy("row", "col", "code", "file"))
    rows = cells.select(F.col("job").cast("long").alias("job"), "row", "col", "code", "file", "hue", "brightness", "png").withColumn("at", at)

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        archive = owner = None
        for b in it:
            for job, row, col, code, file, hue, brightness, png, n in zip(*(c if k == 7 else c.to_pylist() for k, c in enumerate(b.columns)), strict=True):
                if n == 1:
                    if archive:
                        yield owner, archive.closed()
                    archive, owner = CorrectionsZip(), job
                archive.add(code, file, row, col, hue, brightness, png.as_py())
        if archive:
            yield owner, archive.closed()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        for x in made(it):
            some, held = [*some, x], held + len(x[1])
            if held > 4 << 20 or len(some) == 1000:
                yield _archives(some)
                some, held = [], 0
        yield _archives(some)

    return rows.mapInArrow(run, "job long, archive binary")


def _archives(rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["job", "archive"])


def augment(img: np.ndarray) -> dict[str, np.ndarray]:
    """PAL-17: the seven variants of an image (h, w, 3) of bytes: as it is, turned by 10 degrees either way (edges go on), 0.8 and 1.2 times as bright, mirrored, blurred."""
    h, w = img.shape[:2]
    x = img.astype(np.float64)
    out = {"orig": img}
    yy, xx = np.mgrid[0:h, 0:w] - np.array([h / 2, w / 2])[:, None, None]
    for name, angle in (("rot_m10", -10), ("rot_p10", 10)):
        c, s = np.cos(np.deg2rad(angle)), np.sin(np.deg2rad(angle))
        out[name] = _bilinear(x, s * xx + c * yy + h / 2, c * xx - s * yy + w / 2)
    for name, by in (("scale_08", 0.8), ("scale_12", 1.2)):
        out[name] = np.clip(np.rint(x * by), 0, 255).astype(np.uint8)
    out["flip"] = img[:, ::-1]
    k = np.exp(-np.array([1.0, 0.0, 1.0]) / (2 * 0.5**2))
    k /= k.sum()
    for axis in (0, 1):
        pad = np.pad(x, [(1, 1) if a == axis else (0, 0) for a in range(3)], mode="reflect" if min(h, w) > 1 else "edge")
        x = sum(k[i] * np.take(pad, np.arange(i, i + img.shape[axis]), axis=axis) for i in range(3))
    out["blur"] = np.clip(np.rint(x), 0, 255).astype(np.uint8)
    return out


def _bilinear(x: np.ndarray, at_y: np.ndarray, at_x: np.ndarray) -> np.ndarray:
    """Values between pixels; places outside take the nearest edge."""
    h, w = x.shape[:2]
    y, z = np.clip(at_y, 0, h - 1), np.clip(at_x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(z).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[..., None], (z - x0)[..., None]
    v = (1 - fy) * ((1 - fx) * x[y0, x0] + fx * x[y0, x1]) + fy * ((1 - fx) * x[y1, x0] + fx * x[y1, x1])
    return np.clip(np.rint(v), 0, 255).astype(np.uint8)


def variants(images: DataFrame) -> DataFrame:
    """PAL-17 over a relation (id, content PNG): (id, variant, content)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(i, name, png_encode(v)) for i, c in zip(pdf["id"], pdf["content"], strict=True) for name, v in augment(png_decode(c)).items()]
            yield pd.DataFrame(rows, columns=["id", "variant", "content"])

    return images.select("id", "content").mapInPandas(run, "id long, variant string, content binary")


def as_png(rows: DataFrame, height: int, width: int) -> DataFrame:
    """SNK-13: (id, pixels array of height * width * 3 bytes) to (id, content PNG)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"id": pdf["id"], "content": [png_encode(np.array(p, np.uint8).reshape(height, width, 3)) for p in pdf["pixels"]]})

    return rows.mapInPandas(run, "id long, content binary")


def measured(images: DataFrame, what: str) -> DataFrame:
    """(id, variant, values) of the decoded images (id, variant, content): the pixels of a "crop" (OCR-06), of an "area" resample to half size (OCR-07),
    the "gray" values (COL-09), the "tensor" of the image letterboxed to twice its longer side (OCR-08, ARR-05, OCR-20), or "pixels"."""

    def of(img: np.ndarray) -> np.ndarray:
        h, w = img.shape[:2]
        if what == "crop":
            return crop(img, 1, 1, w + 5, h - 1)
        if what == "area":
            return resize_area(img, h // 2, w // 2)
        if what == "gray":
            return to_gray(img)
        return to_chw(letterbox(img, 2 * max(h, w))) if what == "tensor" else img

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"id": pdf["id"], "variant": pdf["variant"], "values": [of(png_decode(c)).astype(np.float64).reshape(-1) for c in pdf["content"]]})

    return images.select("id", "variant", "content").mapInPandas(run, "id long, variant string, values array<double>")


def value_sums(contents: Iterable[bytes], block: int = 4 << 20) -> Iterator[tuple[int, float]]:
    """(values, their sum) of each decoded PNG; lines of 8-bit RGB without filters are summed for all images of a size in a block at once."""
    contents = iter(contents)
    while True:
        some, alike, held = [], {}, 0
        for data in contents:
            w, h, depth, colour, _, stream = _unpacked(data)
            if depth == 8 and colour == 2 and len(stream) == h * (1 + 3 * w):
                alike.setdefault((h, w), []).append((len(some), stream))
            some.append(data)
            held += len(stream)
            if held > block:
                break
        if not some:
            return
        found = {}
        for (h, w), streams in alike.items():
            lines = np.frombuffer(b"".join(x for _, x in streams), np.uint8).reshape(len(streams), h, 1 + 3 * w)
            sums = lines.reshape(len(streams), -1).sum(1, dtype=np.int64)
            found |= {streams[i][0]: (3 * h * w, float(sums[i])) for i in np.flatnonzero(~lines[:, :, 0].any(1))}
        for k, data in enumerate(some):
            yield found[k] if k in found else (lambda v: (v.size, float(v.sum())))(png_decode(data))


def totals(images: DataFrame) -> DataFrame:
    """The images' other columns with n, the number of values of the decoded ``content`` (PNG), and total, their sum; the values stay in the task."""
    others = [c for c in images.columns if c != "content"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            decoded = list(value_sums(c.as_py() for c in b.column("content")))
            made = [pa.array([x[k] for x in decoded], t) for k, t in enumerate((pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), *made], names=[*others, "n", "total"])

    return images.mapInArrow(run, images.select(*others).schema.add("n", IntegerType()).add("total", DoubleType()))


def archive_lines(archives: DataFrame) -> DataFrame:
    """SRC-11, JON-09 for archives held in a column (job, archive): (job, code, file, row, col, size) of the manifest's lines whose file is inside."""
    names = ["job", "code", "file", "row", "col", "size"]

    def lines(job: int | None, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            sizes = {i.filename: i.file_size for i in z.infolist()}
            manifest = z.read("manifest.csv").decode("utf-8-sig")
        for r in islice(csv.reader(io.StringIO(manifest, newline="")), 1, None):
            if r and r[1] in sizes:
                yield job, r[0], r[1], *(int(v) if v.isdigit() else None for v in r[2:4]), sizes[r[1]]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = (x for job, content in zip(b.column("job").to_pylist(), b.column("archive")) for x in lines(job, content.as_py()))
            while some := list(islice(rows, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (1, 2) else pa.int64()) for k, c in enumerate(zip(*some))], names=names)

    return archives.mapInArrow(run, "job long, code string, file string, row long, col long, size long")
