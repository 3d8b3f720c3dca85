"""Sinks (SNK operators). Writers leave existing data alone unless they are told otherwise."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.dictionary import problems
from gridloom.operators.pixels import MANIFEST, png_encode


def write_manifest(rows: DataFrame, path: str) -> None:
    """SNK-10: manifest (code, file, row, col, hue, brightness) with a byte order mark before each file's header."""
    named = rows.select(*(F.col(c).alias(("﻿" if i == 0 else "") + n) for i, (c, n) in enumerate(zip(["code", "file", "row", "col", "hue", "brightness"], MANIFEST, strict=True))))
    named.write.option("header", True).csv(path)


def write_library(entries: DataFrame, path: str, dry_run: bool = False) -> list[str]:
    """SNK-11: validate, then write as JSON lines; returns the problems (then nothing is written)."""
    found = [f"{r['kind']}: {r['n']} ({r['first_codes']})" for r in problems(entries).collect()]  # four rows at most
    if not found and not dry_run:
        entries.orderBy("sort_order").write.json(path)
    return found


def append(entries: DataFrame, path: str) -> None:
    """SNK-12: existing rows are never touched."""
    entries.write.mode("append").parquet(path)


def publish(spark: SparkSession, model: bytes, about: dict, folder: str, pointer: str) -> str:
    """SNK-14, SNK-15, SNK-18: an immutable versioned folder and a pointer to it; fails if the version exists."""
    path = f"{folder}/{about['name']}-{about['version']}"
    spark.createDataFrame([(json.dumps(about, sort_keys=True), bytearray(model))], "manifest string, model binary").write.mode("errorifexists").parquet(path)
    spark.createDataFrame([(path,)], "active string").write.mode("overwrite").parquet(pointer)
    return path


def merge_manifest(old: dict, new: dict) -> dict:
    """SNK-15: keys of the old one stay, those of the export lie over them."""
    return old | new


def write_samples(samples: DataFrame, path: str) -> None:
    """SNK-16: a folder for each code."""
    samples.repartition("code").write.partitionBy("code").parquet(path)


def compact(spark: SparkSession, path: str, to: str, files: int) -> None:
    """SNK-08: the same rows in fewer files."""
    spark.read.parquet(path).coalesce(files).write.parquet(to)


def write_boards(boards: DataFrame, path: str) -> None:
    """SNK-13: a JSON document for each board."""
    boards.select(F.to_json(F.struct(*boards.columns)).alias("value")).write.text(path)


def shared(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, a plain path being local, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_archives(archives: DataFrame, path: str) -> None:
    """SNK-09: archives (job, archive) as files <job>.zip of a folder that the executors share.

    A file is written under another name first and renamed, so a task that is lost or run again leaves whole files only.
    """

    def run(rows: Iterator[Row]) -> None:
        where, at = shared(path)
        where.create_dir(at, recursive=True)
        for r in rows:
            part = f"{at}/_{r['job']}-{uuid.uuid4().hex}"
            with where.open_output_stream(part) as out:
                out.write(bytes(r["archive"]))
            where.move(part, f"{at}/{r['job']}.zip")

    archives.select("job", "archive").foreachPartition(run)


def publish_artifacts(models: DataFrame, path: str) -> None:
    """SNK-14: models (id, manifest JSON, charset, model) as folders <id> with model.onnx, manifest.json and charset.json.

    A folder is filled under another name and renamed, so it is there whole or not at all. One that exists is never touched: it may be the same
    publication, written by a task that ran again, or else the publication fails.
    """

    def run(rows: Iterator[Row]) -> None:
        where, at = shared(path)
        where.create_dir(at, recursive=True)
        for r in rows:
            files = {"model.onnx": bytes(r["model"]), "manifest.json": r["manifest"].encode(), "charset.json": json.dumps(r["charset"], ensure_ascii=False).encode()}
            final, part = f"{at}/{r['id']}", f"{at}/_{r['id']}-{uuid.uuid4().hex}"
            if where.get_file_info(final).type == pafs.FileType.Directory:
                if any(_content(where, f"{final}/{name}") != data for name, data in files.items()):
                    raise FileExistsError(f"{r['id']} already exists")
                continue
            where.create_dir(part)
            for name, data in files.items():
                with where.open_output_stream(f"{part}/{name}") as out:
                    out.write(data)
            where.move(part, final)

    models.select("id", "manifest", "charset", "model").foreachPartition(run)


def _content(where: pafs.FileSystem, path: str) -> bytes | None:
    if where.get_file_info(path).type != pafs.FileType.File:
        return None
    with where.open_input_stream(path) as f:
        return f.read()


def write_files(files: DataFrame, path: str) -> None:
    """Rows (name, content) as files under a folder that the executors share; a name may hold folders. Each is written aside and renamed."""

    def run(rows: Iterator[Row]) -> None:
        where, at = shared(path)
        made = set()
        for r in rows:
            parent = f"{at}/{r['name']}".rsplit("/", 1)[0]
            if parent not in made:
                where.create_dir(parent, recursive=True)
                made.add(parent)
            part = f"{at}/_{uuid.uuid4().hex}"
            with where.open_output_stream(part) as out:
                out.write(bytes(r["content"]))
            where.move(part, f"{at}/{r['name']}")

    files.select("name", "content").foreachPartition(run)


def save_boards(boards: DataFrame, images: DataFrame, previews: DataFrame, path: str) -> None:
    """SNK-13: boards (job, and the columns of their document) as folders <job> with board.json, board.png and preview.png, images and previews being (job, content)."""
    text = boards.select(F.concat(F.col("job").cast("string"), F.lit("/board.json")).alias("name"), F.to_json(F.struct(*(c for c in boards.columns if c != "job"))).cast("binary").alias("content"))
    named = lambda df, name: df.select(F.concat(F.col("job").cast("string"), F.lit(f"/{name}.png")).alias("name"), "content")
    write_files(text.unionByName(named(images, "board")).unionByName(named(previews, "preview")), path)


def write_boards_with_images(boards: DataFrame, path: str) -> None:
    """SNK-13: boards (name, text JSON, height, width) as folders <name> with board.json and a white board.png; height 0: a file that is no image, below: none."""

    def drawn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            files = [(f"{r.name}/board.json", r.text.encode()) for r in pdf.itertuples(index=False)]
            files += [(f"{r.name}/board.png", png_encode(np.full((r.height, r.width, 3), 255, np.uint8)) if r.height else b"no image") for r in pdf.itertuples(index=False) if r.height >= 0]
            yield pd.DataFrame(files, columns=["name", "content"])

    write_files(boards.select("name", "text", "height", "width").mapInPandas(drawn, "name string, content binary"), path)
