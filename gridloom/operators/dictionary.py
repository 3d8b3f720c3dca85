"""Dictionary ETL: conflicts, import, validation (PAL-01 to 03, WIN-03 to 06, AGG-18, 23 to 25, JON-12, 13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import codes as C


def conflicts(entries: DataFrame) -> DataFrame:
    """AGG-24: codes with more than one colour."""
    return entries.groupBy("code").agg(F.countDistinct("hex").alias("colours"), F.count("*").alias("entries")).filter("colours > 1")


def variants(entries: DataFrame) -> DataFrame:
    """AGG-25: (code, hex) with its names and brands in input order."""
    return entries.groupBy("code", "hex").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "brand"))), lambda x: F.struct(x["name"].alias("name"), x["brand"].alias("brand"))).alias("sources"))


def build_final(entries: DataFrame, prefer: str) -> DataFrame:
    """PAL-01, WIN-06: one bare entry for each code and prefixed ones for the other colours.

    entries: (code, name, hex, brand, brand_rank, ord). The group (code, hex) that holds the preferred brand wins the bare code, else the one seen first;
    its name and brand come from its best-ranked row. Rows of losing groups become BRAND-code, the first of each.
    """
    group = Window.partitionBy("code", "hex")
    e = entries.withColumns({"_pref": F.max((F.col("brand") == prefer).cast("int")).over(group), "_first": F.min("ord").over(group)})
    e = e.withColumn("_place", F.dense_rank().over(Window.partitionBy("code").orderBy(F.desc("_pref"), "_first")))
    e = e.withColumn("_in", F.row_number().over(group.orderBy("brand_rank", "ord")))
    bare = e.filter("_place = 1 AND _in = 1").select("code", "name", "hex", "brand")
    other = e.filter("_place > 1").withColumn("_n", F.row_number().over(Window.partitionBy("brand", "code").orderBy("_first", "ord"))).filter("_n = 1")
    return bare.unionByName(other.select(F.concat(F.upper("brand"), F.lit("-"), F.col("code")).alias("code"), "name", "hex", "brand"))


def with_sort_order(entries: DataFrame) -> DataFrame:
    """WIN-05: 1..N by brand and code; for dictionaries."""
    return entries.withColumn("sort_order", F.row_number().over(Window.orderBy("brand", "code", "hex")))


def import_entries(new: DataFrame, library: DataFrame, normalized: bool = True) -> DataFrame:
    """PAL-02: rows (hex, brand, code) in hex order: first of each (brand, code) that the library lacks, numbered in its brand,
    prefixed where another brand uses the code with another colour, named after the library's colour of that hex.

    normalized: compare colours with the '#' taken off both sides; else as written, by which any code in use conflicts and no name is found.
    """
    bare = (lambda c: F.upper(F.regexp_replace(c, "^#", ""))) if normalized else (lambda c: c)
    n = F.row_number().over(Window.partitionBy("brand", "code").orderBy("hex"))
    first = new.withColumn("_n", n).filter("_n = 1").drop("_n").join(library.select("brand", "code"), ["brand", "code"], "left_anti")
    lib = library.select(F.col("brand").alias("_b"), F.col("code").alias("_c"), bare(F.col("hex")).alias("_h"))
    clash = first.join(lib, (F.col("code") == F.col("_c")) & (F.col("brand") != F.col("_b")) & (bare(F.col("hex")) != F.col("_h")), "left_semi").select("brand", "code", F.lit(True).alias("_clash"))
    names = library.groupBy(bare(F.col("hex")).alias("_h")).agg(F.min("name").alias("_name"))
    out = first.join(clash, ["brand", "code"], "left").join(names, bare(F.col("hex")) == F.col("_h"), "left")
    order = F.row_number().over(Window.partitionBy("brand").orderBy("hex", "code"))
    return out.select(
        "brand", F.when(F.col("_clash"), F.concat(F.upper("brand"), F.lit("-"), F.col("code"))).otherwise(F.col("code")).alias("final_code"), F.coalesce("_name", "code").alias("name"), "hex", order.alias("sort_order")
    )


def problems(entries: DataFrame) -> DataFrame:
    """AGG-23, PAL-03: duplicates, long codes, bad colours and missing brands; at most ten codes of each are listed."""
    kinds = {
        "duplicate": entries.groupBy("code").count().filter("count > 1").select("code"),
        "too_long": entries.filter(F.length("code") > 8).select("code"),
        "bad_hex": entries.filter(~F.coalesce(F.col("hex").rlike("^#[0-9A-F]{6}$"), F.lit(False))).select("code"),
        "no_brand": entries.filter(F.coalesce("brand", F.lit("")) == "").select("code"),
    }
    out = None
    for kind, codes in kinds.items():
        one = codes.select(F.lit(kind).alias("kind"), "code")
        out = one if out is None else out.unionByName(one)
    ranked = out.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("code")))
    return ranked.groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= 10, F.struct("_n", "code")))), lambda x: x["code"]), ",").alias("first_codes"))


def version(entries: DataFrame) -> DataFrame:
    """STR-11, SRC-08: hash over the sorted codes; NULL for an empty dictionary."""
    codes = F.array_sort(F.collect_set("code"))
    return entries.agg(F.when(F.count("*") > 0, F.concat(F.lit("sha256:"), C.joined_hash(codes))).alias("version"), F.countDistinct("code").alias("codes"))


def brand_counts(entries: DataFrame) -> DataFrame:
    """AGG-18, PAL-21."""
    return entries.groupBy("brand").agg(F.count("*").alias("n"), F.countDistinct("code").alias("codes"))


def vocabulary(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """JON-07, SET-03: known codes among the wanted ones, by upper case; never wider."""
    return known.join(wanted.select(F.upper("code").alias("_w")).distinct(), F.upper("code") == F.col("_w"), "left_semi")


def in_list_order(listed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """JON-08: a job's list of valid codes with their colours, in list order, unknown ones dropped."""
    return listed.select("job", F.posexplode("codes").alias("pos", "code")).join(dictionary, "code")
