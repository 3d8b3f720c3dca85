"""Correction batches (COR-01) over cells (job, row, col, code, corrected_code)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["job", "row", "col"]


def normalized(updates: DataFrame) -> DataFrame:
    """Updates (job, row, col, ord, new_code) with codes trimmed and upper-cased; empty means revert (NULL)."""
    return updates.withColumn("new_code", F.nullif(F.upper(F.trim("new_code")), F.lit("")))


def violations(updates: DataFrame, cells: DataFrame, valid: DataFrame, bounds: DataFrame) -> DataFrame:
    """(job, row, col, ord, error): every update that must stop its batch. PRD-07, PRD-08, JON-05."""
    u = normalized(updates).join(bounds, "job", "left").join(cells.select(*KEY, F.lit(True).alias("_there")), KEY, "left")
    u = u.join(valid.select(F.col("code").alias("new_code"), F.lit(True).alias("_valid")).distinct(), "new_code", "left")
    error = (
        F.when(~((F.col("row") >= 0) & (F.col("row") < F.col("rows")) & (F.col("col") >= 0) & (F.col("col") < F.col("cols"))), "CELL_OUT_OF_BOUNDS")
        .when(F.col("_there").isNull(), "CELL_NOT_FOUND")
        .when(F.col("new_code").isNotNull() & ((F.octet_length("new_code") > 8) | ((F.col("new_code") != "BLANK") & F.col("_valid").isNull())), "INVALID_CODE")
    )
    return u.withColumn("error", error).filter("error IS NOT NULL").select(*KEY, "ord", "error")


def accepted(updates: DataFrame, bad: DataFrame) -> DataFrame:
    """A batch (job) with one violation is not applied at all."""
    return normalized(updates).join(bad.select("job").distinct(), "job", "left_anti")


def counts(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """(job, corrected, reverted): every set counts; a revert counts if the cell was corrected at that moment."""
    before = cells.select(*KEY, F.col("corrected_code").isNotNull().alias("_had"))
    w = Window.partitionBy(*KEY).orderBy("ord")
    now = F.coalesce(F.lag(F.col("new_code").isNotNull()).over(w), F.col("_had"))
    return updates.join(before, KEY).withColumn("_now", now).groupBy("job").agg(F.count_if(F.col("new_code").isNotNull()).alias("corrected"), F.count_if(F.col("new_code").isNull() & F.col("_now")).alias("reverted"))


def apply(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """Cells after the updates, the last of each cell holding; ``code`` never changes. Status is derived again by cells.with_status."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("ord"))
    final = updates.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*KEY, "new_code", F.lit(True).alias("_hit"))
    out = cells.join(final, KEY, "left").withColumn("corrected_code", F.when(F.col("_hit"), F.col("new_code")).otherwise(F.col("corrected_code")))
    return out.drop("new_code", "_hit")
