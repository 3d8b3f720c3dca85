"""Jobs and blueprints: create, list, detail, rename, delete, prune, materialise (SNK, PRJ, PRD, JON, API operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import codes as C
from gridloom.operators.cells import page

#: States of a job, and the columns a list may be sorted by.
STATUSES = ["PENDING", "PROCESSING", "SUCCEEDED", "SUCCEEDED_WITH_WARNINGS", "FAILED"]
SORTABLE = ["created_at", "updated_at", "status", "rows", "cols", "name"]


class ApiError(ValueError):
    """An error of the query interface; its text is the error's code."""


def create(requests: DataFrame, version: Column, model: Column) -> DataFrame:
    """SNK-02, PRD-04: (id, rows, cols, crop_box, codes, name, image, at) to job rows with their defaults; bad ones carry an error."""
    ok = F.col("rows").between(1, 500) & F.col("cols").between(1, 500) & (F.col("crop_box.width") >= 1) & (F.col("crop_box.height") >= 1)
    return requests.select(
        "id", F.lit("PENDING").alias("status"), F.lit("QUEUED").alias("stage"), "rows", "cols", F.nullif(F.trim("name"), F.lit("")).alias("name"), "crop_box",
        F.array_sort("codes").alias("valid_codes"), F.col("image").alias("input_image_path"), version.alias("color_library_version"), model.alias("model_snapshot"),
        F.lit(0).alias("attempt"), F.lit(0).alias("retry_count"), F.lit(2).alias("max_retries"), F.lit(0).cast("long").alias("processed_cells"),
        (F.col("rows") * F.col("cols")).alias("total_cells"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"), F.when(~ok, "INVALID_PARAMETER").alias("error"),
    )


def list_jobs(jobs: DataFrame, status: str | None = None, number: int = 1, size: int = 20, sort_by: str = "created_at", direction: str = "desc") -> DataFrame:
    """SRT-01, SRT-06, PRD-01, PRD-02: a page of jobs; an unknown column sorts by created_at, any direction but asc descends, ties by id."""
    if status is not None:
        if status not in STATUSES:
            raise ApiError("INVALID_JOB_STATUS")
        jobs = jobs.filter(F.col("status") == status)
    column = F.col(sort_by if sort_by in SORTABLE and sort_by in jobs.columns else "created_at")
    return page(jobs, number, size, column.asc() if direction == "asc" else column.desc(), F.col("id"))


def detail(jobs: DataFrame) -> DataFrame:
    """PRJ-03: nested snapshot; the error only of failed jobs with an error code."""
    error = F.when((F.col("status") == "FAILED") & F.col("error_code").isNotNull(), F.struct(F.col("error_code").alias("code"), F.substring("error_message", 1, 500).alias("message")))
    return jobs.select("id", "status", F.struct("rows", "cols").alias("grid"), F.struct("color_library_version", "model_snapshot").alias("snapshot"), error.alias("error"), F.array().cast("array<string>").alias("warnings"))


def summary(jobs: DataFrame) -> DataFrame:
    """PRJ-04, SNK-17: the summary as JSON."""
    camel = F.struct("id", "status", F.col("processed_cells").alias("processedCells"), F.col("total_cells").alias("totalCells"))
    return jobs.select("id", F.to_json(camel).alias("body"))


def rename(jobs: DataFrame, job_id: Column, name: Column) -> DataFrame:
    """SNK-06."""
    return jobs.withColumn("name", F.when(F.col("id") == job_id, F.nullif(F.trim(name), F.lit(""))).otherwise(F.col("name")))


def delete(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """SNK-05: every table without the rows of the ids; each by its own key column."""
    gone = ids.select("id").distinct()
    return {k: df.join(gone.withColumnRenamed("id", key), key, "left_anti") for k, (df, key) in tables.items()}


def prune(staged: DataFrame, jobs: DataFrame) -> DataFrame:
    """SNK-07: staging without that of succeeded jobs."""
    return staged.join(jobs.filter("status = 'SUCCEEDED'").select(F.col("id").alias("job")), "job", "left_anti")


def complete(jobs: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-04, AGG-02: (blueprints, their cells) of jobs whose staging is whole."""
    whole = jobs.join(staged.groupBy(F.col("job").alias("id")).agg(F.count("*").alias("n")), "id").filter("n >= total_cells").drop("n")
    blueprints = whole.select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("blueprint_id"), F.col("id").alias("job"), "rows", "cols")
    return blueprints, staged.join(blueprints.select("blueprint_id", "job"), "job").drop("job")


def blueprint_detail(blueprints: DataFrame, cells: DataFrame) -> DataFrame:
    """JON-02, SRT-05: a row for each blueprint with its cells in row order; bounded by the grid (500 x 500)."""
    c = cells.groupBy("blueprint_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "code"))).alias("cells"))
    return blueprints.join(c, "blueprint_id", "left")


def corrected_cells(blueprints: DataFrame, cells: DataFrame) -> DataFrame:
    """JON-04."""
    return blueprints.join(cells.filter("corrected_code IS NOT NULL"), "blueprint_id")


def image_path(blueprints: DataFrame, jobs: DataFrame) -> DataFrame:
    """JON-03."""
    return blueprints.join(jobs.select(F.col("id").alias("job"), "input_image_path"), "job").select("blueprint_id", "input_image_path")


def get_by_key(df: DataFrame, **key: object) -> DataFrame:
    """SRC-03, SRC-04: point lookup; the filter reaches the scan."""
    for k, v in key.items():
        df = df.filter(F.col(k) == F.lit(v))
    return df.limit(1)


def decode(rows: DataFrame) -> DataFrame:
    """PRJ-01: stored text rows to jobs: JSON columns parsed, stamps read; what is absent or can't be read is NULL."""
    box = "struct<x:bigint,y:bigint,width:bigint,height:bigint>"
    stamps = {c: C.parse_stamp(F.col(c)) for c in ("heartbeat_at", "created_at", "updated_at") if c in rows.columns}
    whole = {c: F.col(c).try_cast("bigint") for c in ("rows", "cols", "processed_cells", "total_cells") if c in rows.columns}
    return rows.withColumns({"crop_box": F.from_json("crop_box", box), "valid_codes": F.from_json("valid_codes", "array<string>"), **stamps, **whole})
