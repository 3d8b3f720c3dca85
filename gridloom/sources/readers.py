"""Sources (SRC operators): seeds, libraries, manifests, archives, labelled folders, boards, model registries."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import codes as C
from gridloom.sources import archive
from gridloom.sources import schemas as S


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC-01, SRC-02: a stored relation; filters and columns reach the scan."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def color_seed(spark: SparkSession, path: str, version: str = "seed") -> DataFrame:
    """SRC-05: a JSON array of entries under either set of names; rows without code, name or colour are skipped, a malformed file gives none."""
    raw = spark.read.schema(S.LIBRARY).option("mode", "DROPMALFORMED").json(path, multiLine=True)
    out = raw.select(
        "code", F.coalesce("color_name", "name").alias("name"), F.regexp_replace(F.coalesce("color_hex", "hex"), "^#", "").alias("hex"), F.coalesce("brand", F.lit("mard")).alias("brand"), F.lit(version).alias("version")
    )
    return out.filter("code IS NOT NULL AND name IS NOT NULL AND hex IS NOT NULL")


def brand_codes(spark: SparkSession, path: str, brand: str = "mard") -> DataFrame:
    """SRC-06, SRC-08."""
    return color_seed(spark, path).filter(F.col("brand") == brand).select("code").distinct().orderBy("code")


def library_path(explicit: str | None, variable: str, default: str) -> str:
    """SRC-07: argument, environment, default."""
    return explicit or os.environ.get(variable) or default


def brand_csvs(spark: SparkSession, folder: str, brands: list[str]) -> DataFrame:
    """SRC-09: headerless <brand>.csv files (code, name, r, g, b, hex, contributor); short and empty rows are skipped."""
    fields = "code string, name string, r string, g string, b string, hex string, contributor string"
    raw = spark.read.schema(fields).option("escape", '"').csv(folder).withColumn("brand", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    rank = F.create_map(*[x for i, b in enumerate(brands) for x in (F.lit(b), F.lit(i))])
    out = raw.select(F.trim("code").alias("code"), F.trim("name").alias("name"), C.normalize_hex(F.col("hex")).alias("hex"), "brand", F.try_element_at(rank, "brand").alias("brand_rank"))
    return out.filter("code <> '' AND hex IS NOT NULL AND brand_rank IS NOT NULL")


def colour_mapping(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: {hex: {brand: code}} as rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    return raw.select(F.explode("m").alias("hex", "b")).select("hex", F.explode("b").alias("brand", "code"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: a manifest with a byte order mark, by position."""
    return spark.read.schema(S.MANIFEST).option("header", True).option("enforceSchema", True).csv(path)


def manifest_lines(manifests: DataFrame) -> DataFrame:
    """(archive, label, name, row, col) of manifests (archive, content): quoted fields, line ends in them and a byte order mark are read; short lines are skipped, rows and columns count from 1 or are NULL."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p, content in zip(pdf["archive"], pdf["content"], strict=True):
                lines = [x for x in csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")) if len(x) >= 2][1:]
                number = [[int(v) if v.isdigit() else None for v in (*x[2:4], "", "")[:2]] for x in lines]
                table = {"archive": p, "label": [x[0] for x in lines], "name": [x[1] for x in lines], "row": pd.array([n[0] for n in number], "Int64"), "col": pd.array([n[1] for n in number], "Int64")}
                yield pd.DataFrame(table)

    return manifests.select("archive", "content").mapInPandas(run, "archive string, label string, name string, row long, col long")


def zip_cells(spark: SparkSession, path: str, split: int = archive.SPLIT) -> DataFrame:
    """SRC-11, JON-09: PNG members (archive, name, label, row, col, size, content) that the archive's manifest lists; an archive is read by as many tasks as it has pieces."""
    rows = manifest_lines(archive.members(spark, path, "manifest.csv", split))
    return archive.members(spark, path, ".png", split).join(rows, ["archive", "name"])


def labelled_folder(spark: SparkSession, folder: str, pattern: str = r"\.png$") -> DataFrame:
    """SRC-12, SRC-13, SRT-13: files whose name matches, with the label their name holds."""
    files = spark.read.format("binaryFile").load(folder).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    return files.filter(F.col("name").rlike(pattern)).select("path", "name", "content", C.label_of(F.col("name")).alias("label"))


def labels(files: DataFrame, listed: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """SRC-14, SRC-15: label of the manifest, else of the name; codes with characters out of the vocabulary fall away."""
    out = files.join(listed.select(F.col("file").alias("name"), F.upper("code").alias("_l")), "name", "left").withColumn("label", F.coalesce("_l", C.code_from_filename(F.col("name")))).drop("_l")
    if vocabulary is not None:
        known = F.array(*map(F.lit, vocabulary))
        spelled = F.forall(F.filter(F.split("label", ""), lambda c: c != ""), lambda c: F.array_contains(known, c))
        out = out.filter((F.col("label") == C.BLANK) | spelled)
    return out.filter("label IS NOT NULL")


def boards(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16, ARR-09: boards with the reason why one is skipped (NULL: it is used)."""
    raw = spark.read.schema(S.BOARD).json(path, multiLine=True).withColumn("path", F.input_file_name())
    n, want = F.size("cells"), F.col("board.rows") * F.col("board.cols")
    reason = F.when(F.col("cells").isNull() | (n == 0), "no cells").when(F.coalesce(n != want, F.lit(True)), "size mismatch")
    return raw.withColumns({"reason": reason, "blur_level": F.coalesce("board.blur_level", F.lit("unknown"))})


def image_size(content: Column) -> Column:
    """(width, height) from the head of a PNG; NULL of what isn't one. No pixel is decoded."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def board_folder(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-16: boards (<folder>/*/board.json) beside their images (board.png), with the first reason why one is skipped: no cells, size mismatch (cells),
    missing image (or an empty file), unreadable image, image size mismatch (grid times cell size, where the board states it)."""
    here = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), r"/[^/]+$", "")
    found = boards(spark, f"{folder}/*/board.json").withColumn("_dir", here(F.col("path")))
    images = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "board.png").load(folder)
    images = images.select(here(F.col("path")).alias("_at"), image_size(F.col("content")).alias("image"))
    want = F.struct((F.col("board.cols") * F.col("board.cell_size_px")).alias("width"), (F.col("board.rows") * F.col("board.cell_size_px")).alias("height"))
    late = F.when(F.col("_at").isNull(), "missing image").when(F.col("image").isNull(), "unreadable image").when(F.col("board.cell_size_px").isNotNull() & (F.col("image") != want), "image size mismatch")
    joined = found.join(images, F.col("_dir") == F.col("_at"), "left")
    return joined.withColumn("reason", F.coalesce("reason", late)).drop("_dir", "_at")


def manifest_crops(spark: SparkSession, path: str) -> DataFrame:
    """SRC-22: crops of a manifest ({"crops": [{"file", "code", "x", "y", "width", "height"}]}) with the content of their image (a PNG beside the manifest)
    and the reason why one can't be cut: missing file, unreadable image, outside image (no pixel of it inside)."""
    raw = spark.read.schema("crops array<struct<file:string,code:string,x:int,y:int,width:int,height:int>>").json(path, multiLine=True)
    name = lambda c: F.regexp_replace(c, "^file:/+", "/")
    crops = raw.select(F.regexp_replace(name(F.input_file_name()), r"/[^/]+$", "").alias("_dir"), F.explode("crops").alias("c")).select("_dir", "c.*")
    images = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path.rsplit("/", 1)[0])
    images = images.select(name(F.col("path")).alias("_path"), "content").withColumn("_image", image_size(F.col("content")))
    out = crops.join(images, F.concat("_dir", F.lit("/"), "file") == F.col("_path"), "left")
    inside = (F.col("x") < F.col("_image.width")) & (F.col("y") < F.col("_image.height")) & (F.col("x") + F.col("width") > 0) & (F.col("y") + F.col("height") > 0) & (F.col("width") > 0) & (F.col("height") > 0)
    reason = F.when(F.col("_path").isNull(), "missing file").when(F.col("_image").isNull(), "unreadable image").when(~F.coalesce(inside, F.lit(False)), "outside image")
    return out.select("file", "code", "x", "y", "width", "height", reason.alias("reason"), F.when(reason.isNull(), F.col("content")).alias("content"))


def board_cells(found: DataFrame) -> DataFrame:
    """SRC-22: cells of usable boards, rows and columns from 0."""
    return found.filter("reason IS NULL").select("path", F.explode("cells").alias("c")).select("path", (F.col("c.row") - 1).alias("row"), (F.col("c.col") - 1).alias("col"), "c.code", "c.color_hex")


def model_registry(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-17, SRC-18: models (a folder with model.onnx and manifest.json), name and tensor names with their defaults, by id."""
    here = lambda c: F.regexp_extract(c, r"([^/]+)/[^/]+$", 1)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/model.onnx")  # a listing, as Spark's scans pass over empty files
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    models = spark.createDataFrame([(f.getPath().getParent().getName(), f.getLen()) for f in found], "id string, length long")
    about = spark.read.schema(S.MODEL).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(folder, multiLine=True)
    about = about.select(here(F.input_file_name()).alias("id"), "name", "version", "input_name", "output_name")
    return models.join(about, "id", "left").select("id", F.coalesce("name", "id").alias("name"), "version", F.coalesce("input_name", F.lit("images")).alias("input_name"), F.coalesce("output_name", F.lit("logits")).alias("output_name"), "length").orderBy("id")


def checkpoint_problems(registry: DataFrame, chars: list[str]) -> DataFrame:
    """OCR-16: what speaks against loading a model with this character set."""
    tests = {"no version": F.col("version").isNull(), "no weights": F.coalesce(F.col("length") == 0, F.lit(True)), "no blank": F.lit(not chars or chars[0] != "<blank>"), "characters repeat": F.lit(len(set(chars)) != len(chars))}
    return registry.select("id", F.explode(F.filter(F.array(*(F.when(bad, name) for name, bad in tests.items())), lambda x: x.isNotNull())).alias("problem"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Input order as ``ord``, for dictionaries."""
    return df.withColumn("ord", F.row_number().over(Window.orderBy(*order)))
