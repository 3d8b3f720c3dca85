"""Cells of coded grids: upsert, status, gap fill, review, selection, counts, paging.

A cell relation has the columns (job, row, col, code, confidence), more are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import codes as C

KEY = ["job", "row", "col"]


def latest(cells: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """SNK-03, STM-05, WIN-10: one row for each key, the first in ``order`` (total): an idempotent last-write-wins upsert."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return cells.withColumn("_n", n).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-01: rows of ``new`` replace those of ``old`` with the same key; anti join and union, no rewrite of order."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def one_per_code(dictionary: DataFrame) -> DataFrame:
    """JON-01: of entries whose codes differ by case only the least code stays."""
    return latest(dictionary.withColumn("_u", F.upper("code")), ["_u"], F.col("code"), F.col("name"), F.col("hex")).drop("_u")


def with_status(cells: DataFrame, dictionary: DataFrame, code: str = "code") -> DataFrame:
    """JON-01 and the status rule: BLANK, MAPPED with its colour, or UNMAPPED without one.

    Catalyst broadcasts the dictionary when its size allows and shuffles it otherwise.
    """
    d = one_per_code(dictionary).select(F.upper("code").alias("_key"), F.col("code").alias("color_code"), F.col("name").alias("color_name"), F.col("hex").alias("color_hex"))
    key = F.when(F.col(code) != C.BLANK, F.upper(F.col(code)))
    joined = cells.withColumn("_k", key).join(d, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")
    return joined.withColumn("status", F.when(F.col(code) == C.BLANK, C.BLANK).when(F.col("color_code").isNotNull(), "MAPPED").otherwise("UNMAPPED"))


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """ARR-04: the positions of a grid."""
    r = spark.range(rows).select(F.col("id").alias("row"))
    return r.select("row", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).cast("long").alias("col"))


def positions(jobs: DataFrame) -> DataFrame:
    """ARR-04 for a relation (job, rows, cols): every position of every grid."""
    seq = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    return jobs.filter("rows > 0 AND cols > 0").select("job", F.explode(seq(F.col("rows"))).alias("row"), "cols").select("job", "row", F.explode(seq(F.col("cols"))).alias("col"))


def _by_job(jobs: DataFrame, cells: DataFrame, how: str, *more: str) -> DataFrame:
    """(job, _all, _own, _gaps): each job's cells, those inside its grid and the places without one. A grid, 500 x 500 at most, stays in one row: its places are made
    after the join of the jobs and never shuffled."""
    all_ = cells.groupBy("job").agg(F.collect_list(F.struct("row", "col", *more)).alias("_all"))
    rows, cols = F.col("rows").cast("long"), F.col("cols").cast("long")
    inside = F.filter("_all", lambda c: (c["row"] >= 0) & (c["row"] < rows) & (c["col"] >= 0) & (c["col"] < cols))
    grids = jobs.filter("rows > 0 AND cols > 0").select("job", "rows", "cols").join(all_, "job", how)
    grids = grids.withColumns({"_all": F.coalesce("_all", F.array()), "_own": F.coalesce(inside, F.array())})
    gaps = F.array_except(F.sequence(F.lit(0).cast("long"), rows * cols - 1), F.transform("_own", lambda c: c["row"] * cols + c["col"]))
    places = F.transform(gaps, lambda p: F.struct(F.floor(p / cols).alias("row"), (p % cols).alias("col")))
    return grids.select("job", "_all", "_own", F.coalesce(places, F.array()).alias("_gaps"))  # no grid: no gaps


def missing(jobs: DataFrame, cells: DataFrame) -> DataFrame:
    """SET-07: positions without a cell."""
    return _by_job(jobs, cells, "left").select("job", F.inline("_gaps"))


def fill_gaps(jobs: DataFrame, cells: DataFrame, strays: bool = True) -> DataFrame:
    """JON-06: the cells, and missing positions as code UNMAPPED with confidence 0; ``strays``: cells beside their grid, or of no job listed, stay too."""
    rest = [c for c in ("code", "confidence") if c in cells.columns]
    filler = {"code": F.lit("UNMAPPED"), "confidence": F.lit(0.0)}
    made = F.transform("_gaps", lambda p: F.struct(p["row"].alias("row"), p["col"].alias("col"), *(filler[c].alias(c) for c in rest)))
    return _by_job(jobs, cells, "full" if strays else "left", *rest).select("job", F.inline(F.concat("_all" if strays else "_own", made)))


def review(cells: DataFrame, threshold: float) -> DataFrame:
    """PRD-09: unmapped, or confidence under the threshold; an unknown confidence alone doesn't select."""
    return cells.filter((F.col("status") == "UNMAPPED") | (F.col("confidence") < threshold))


def visible(cells: DataFrame, mode: str, search: str = "", fix: str = "all", threshold: float = 0.9) -> DataFrame:
    """PRD-10: review or all cells, searched (in mode ``all``) by 1-based r:c, code or correction, by fixed state."""
    out = review(cells, threshold) if mode == "review" else cells
    if mode == "all" and search.strip():
        s = search.strip().upper()
        place = F.concat_ws(":", F.col("row") + 1, F.col("col") + 1)
        has = lambda c: F.instr(F.upper(c), s) > 0
        out = out.filter(F.coalesce(has(place), F.lit(False)) | F.coalesce(has(F.col("code")), F.lit(False)) | F.coalesce(has(F.col("corrected_code")), F.lit(False)))
    if fix != "all":
        out = out.filter(F.col("corrected_code").isNotNull() if fix == "fixed" else F.col("corrected_code").isNull())
    return out


def unmapped(cells: DataFrame) -> DataFrame:
    """PRD-11."""
    return cells.filter("status = 'UNMAPPED' AND code <> 'BLANK'")


def candidates(dictionary: DataFrame, text: str) -> DataFrame:
    """PRD-12: code holds the upper-cased text, or the name its lower case."""
    return dictionary.filter(F.col("code").contains(text.upper()) | F.lower("name").contains(text.lower()))


def bead_list(cells: DataFrame, code: str = "code", *by: str) -> DataFrame:
    """AGG-05: cells by effective code."""
    return cells.groupBy(*by, F.col(code).alias("code")).agg(F.count("*").alias("count"))


def with_rank(codes: DataFrame, key: Column, name: str, *by: str) -> DataFrame:
    """SRT-02, SRT-03, SRT-04: rank by a sort key; for small relations (dictionaries, lists of codes) or inside ``by``."""
    return codes.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(key)))


def breakdown(cells: DataFrame, selection: DataFrame) -> DataFrame:
    """AGG-06: counts by code over selected keys, and the first place of each for ties."""
    picked = cells.join(selection, KEY, "left_semi")
    return picked.groupBy("code").agg(F.count("*").alias("count"), F.min(F.struct(*KEY)).alias("_first")).select("code", "count", *(F.col(f"_first.{k}").alias(f"first_{k}") for k in KEY))


def range_between(cells: DataFrame, anchor: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """WIN-02: cells of each job from anchor to target in row order, whichever comes first; none if either is missing."""
    at = lambda p: F.max(F.when((F.col("row") == p[0]) & (F.col("col") == p[1]), F.struct("row", "col")))
    ends = cells.groupBy("job").agg(at(anchor).alias("_a"), at(target).alias("_b")).filter("_a IS NOT NULL AND _b IS NOT NULL")
    return cells.join(ends, "job").filter(F.struct("row", "col").between(F.least("_a", "_b"), F.greatest("_a", "_b"))).drop("_a", "_b")


def toggle(selected: Column, keys: Column) -> Column:
    """SET-05: all keys selected: take them out, else add all."""
    return F.array_sort(F.when(F.forall(keys, lambda k: F.array_contains(selected, k)), F.array_except(selected, keys)).otherwise(F.array_union(selected, keys)))


def legend(cells: DataFrame) -> DataFrame:
    """AGG-07: counts by code, else colour, without the default; the least colour."""
    key = F.coalesce("code", "color_hex", F.lit("default"))
    return cells.groupBy(key.alias("key")).agg(F.count("*").alias("count"), F.min("color_hex").alias("color")).filter("key <> 'default'")


def figures(cells: DataFrame, threshold: float = 0.9, locked: str = "E1") -> DataFrame:
    """AGG-08, AGG-09, AGG-10: conditional counts of each job."""
    return cells.groupBy("job").agg(
        F.count_if(F.col("status") == "UNMAPPED").alias("unmapped"),
        F.count_if(F.col("corrected_code").isNotNull()).alias("corrected"),
        F.count_if((F.col("status") == "UNMAPPED") | (F.col("confidence") < threshold)).alias("review"),
        F.count_if(F.coalesce("corrected_code", "code") == locked).alias("locked"),
    )


def longest_code(cells: DataFrame) -> DataFrame:
    """AGG-11, STR-19: the first longest code of each job, BLANK and UNMAPPED apart."""
    real = cells.filter("code NOT IN ('BLANK', 'UNMAPPED', '')")
    return real.groupBy("job").agg(F.min(F.struct((-F.length("code")).alias("l"), "row", "col", "code")).alias("x")).select("job", F.col("x.code").alias("code"))


def page(df: DataFrame, number: int, size: int, *order: Column, most: int = 100) -> DataFrame:
    """SRT-06, SRT-07, SRT-11: one page of a total order; number from 1, size clamped."""
    size = min(max(size, 1), most)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def total_pages(df: DataFrame, size: int) -> DataFrame:
    """AGG-01 with the page count."""
    return df.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).alias("total_pages"))


def to_dto(cells: DataFrame) -> DataFrame:
    """PRJ-05: colour struct only where there is a colour, absent name and hex empty."""
    colour = F.when(F.col("color_code").isNotNull(), F.struct(F.col("color_code").alias("code"), F.coalesce("color_name", F.lit("")).alias("name"), F.coalesce("color_hex", F.lit("")).alias("hex")))
    return cells.withColumn("color", colour).drop("color_code", "color_name", "color_hex")


def chunks(cells: DataFrame, block: int, total: Column) -> DataFrame:
    """WIN-11: block number and capped running total of each job's ordered cells."""
    n = F.row_number().over(Window.partitionBy("job").orderBy("row", "col"))
    out = cells.withColumn("_n", n).withColumn("block", F.floor((F.col("_n") - 1) / block).cast("int"))
    return out.groupBy("job", "block").agg(F.count("*").alias("cells"), F.least(F.max("_n"), F.max(total)).cast("long").alias("done"))


def merge_regions(cells: DataFrame) -> DataFrame:
    """JON-16: regions' local coordinates to global ones; of one place the last region wins."""
    out = cells.withColumns({"row": F.col("row") + F.col("r0"), "col": F.col("col") + F.col("c0")})
    return latest(out, KEY, F.desc("region"))


CELL_STATES = ["MAPPED", "UNMAPPED", "BLANK"]


def decode(rows: DataFrame) -> DataFrame:
    """PRJ-02: stored text rows to cells; an unknown state, a bad number or stamp is NULL."""
    state = F.when(F.col("status").isin(CELL_STATES), F.col("status"))
    return rows.withColumns({"row": F.col("row").try_cast("bigint"), "col": F.col("col").try_cast("bigint"), "status": state, "confidence": F.col("confidence").try_cast("double"), "corrected_at": C.parse_stamp(F.col("corrected_at"))})


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """SET-06: the distinct values of a column, without NULL, in order."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def pages(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """SRT-10: every row with the page it stands on, from 1; for small relations such as dictionaries."""
    return df.withColumn("page", (F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size) + 1).cast("int"))
