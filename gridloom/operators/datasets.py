"""Data-set assembly: splits, caps, weights, audits, pools (SET, WIN-07 to 09, SMP, AGG-19 to 22, 28, 30, PAL-09 to 19)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spread(ident: Column, seed: int) -> Column:
    """A portable pseudo-random order of integers, in integer arithmetic only; the inner remainder keeps large ones from an overflow."""
    return ((ident % 2147483648) * 2654435761 + seed) % 2147483648


def unit(ident: Column, seed: int) -> Column:
    """The same as a fraction in [0, 1)."""
    return spread(ident, seed) / 2147483648.0


SLICES = 256  # of the spread order: tasks that share the ranking of one group


def by_bounds(column: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are not above the value, by a tree of comparisons; NULL counts as below all."""
    if not bounds:
        return F.lit(0)
    k = len(bounds) // 2
    return F.when(column >= F.lit(bounds[k]), k + 1 + by_bounds(column, bounds[k + 1 :])).otherwise(by_bounds(column, bounds[:k]))


def slices_of(df: DataFrame, column: str, slices: int = SLICES) -> Column:
    """The slice of each row in the order of ``column``: ranges that hold about as many rows each, from approximate quantiles (``slices`` numbers)."""
    cuts = df.agg(F.percentile_approx(column, [k / slices for k in range(1, slices)], 20 * slices)).first()[0]
    return by_bounds(F.col(column), sorted(set(cuts or [])))


def rank_by_slices(df: DataFrame, slice_: Column, order: list[Column], *by: str) -> DataFrame:
    """``df`` with _rank, from 1 in the given order inside each group, and the group's size _n.

    ``slice_`` cuts the order into ranges; rows are ranked inside a range, and ranges start where the counts of
    those before end. So no task holds a whole group, however hot.
    """
    cut_ = df.withColumn("_s", slice_)
    counts = cut_.groupBy(*by, "_s").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*by)
    starts = counts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_s").alias("_t"), (F.sum("_c").over(whole.orderBy("_s")) - F.col("_c")).alias("_start"), F.sum("_c").over(whole).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*order))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_s") == F.col("_t")]
    joined = cut_.withColumn("_inside", inside).join(starts, reduce(lambda x, y: x & y, same))
    return joined.withColumn("_rank", F.col("_inside") + F.col("_start")).drop("_s", "_t", "_start", "_inside", *(f"_by_{c}" for c in by))


def ranked(samples: DataFrame, seed: int, ident: str, *by: str) -> DataFrame:
    """``rank_by_slices`` in spread order, cut into SLICES equal ranges."""
    place = spread(F.col(ident), seed)
    return rank_by_slices(samples, F.floor(place / (2147483648 / SLICES)).cast("int"), [place, F.col(ident)], *by)


def stratified_split(samples: DataFrame, fraction: float, seed: int, code: str = "code", ident: str = "id") -> DataFrame:
    """WIN-07: per code max(1, half-even(n * fraction)) rows for validation where n is two at least, none else."""
    want = F.when(F.col("_n") >= 2, F.greatest(F.lit(1), F.bround(F.col("_n") * fraction).cast("int"))).otherwise(0)
    return ranked(samples, seed, ident, code).withColumn("split", F.when(F.col("_rank") <= want, "val").otherwise("train")).drop("_rank", "_n")


def cut(samples: DataFrame, fraction: float, seed: int, ident: str = "id", *by: str) -> DataFrame:
    """SMP-02: the first int(n * (1 - fraction)) rows in spread order of each group train, the rest validate."""
    train = F.col("_rank") <= F.floor(F.col("_n") * (1 - fraction))
    return ranked(samples, seed, ident, *by).withColumn("split", F.when(train, "train").otherwise("val")).drop("_rank", "_n")


def cap(samples: DataFrame, label: str, source: str, most: int, seed: int, ident: str = "id") -> DataFrame:
    """WIN-08: at most ``most`` rows of one label from one source, a feature of the assembly; a top-k, no window."""
    hit = (F.col("code") == label) & (F.col("source") == source)
    picked = samples.filter(hit).orderBy(spread(F.col(ident), seed), ident).limit(most)
    return samples.filter(~F.coalesce(hit, F.lit(False))).unionByName(picked)


def assemble(real: DataFrame, synth: DataFrame, excluded: DataFrame) -> DataFrame:
    """SET-01, SET-04, PAL-14: union of both without excluded sources."""
    return real.withColumn("kind", F.lit("real")).unionByName(synth.withColumn("kind", F.lit("synth"))).join(excluded, "source", "left_anti")


def audit(samples: DataFrame) -> DataFrame:
    """AGG-19, AGG-20: counts of a data set and the ratio of synthetic to real rows (half-even at three places)."""
    synth, real = F.count_if(F.col("kind") == "synth"), F.count_if(F.col("kind") == "real")
    return samples.agg(F.count("*").alias("n"), real.alias("real"), synth.alias("synth"), F.countDistinct("code").alias("codes"), F.count_if(F.col("code") == "BLANK").alias("blank"), F.bround(synth / F.greatest(F.lit(1), real), 3).alias("ratio"))


def per_source(samples: DataFrame) -> DataFrame:
    """AGG-19: rows by source as one map."""
    return samples.groupBy("source").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"))


def level_counts(df: DataFrame, level: Column, levels: list[str]) -> DataFrame:
    """AGG-21: a count for each fixed level and for 'unknown'."""
    known = level.isin(levels)
    return df.groupBy(F.when(known, level).otherwise("unknown").alias("level")).agg(F.count("*").alias("n"))


def sampling_weights(samples: DataFrame, real: float = 1.0, synth: float = 1.0) -> DataFrame:
    """SMP-01, AGG-28: inverse frequency times source weight, tripled for synthetic codes without a real row, mean one.

    Counts by code and kind are a grouped table; samples are joined with it, so a hot code is split like any skewed join.
    """
    is_real = F.coalesce(F.col("kind") == "real", F.lit(False))
    kinds = samples.groupBy("code", is_real.alias("_real")).agg(F.count("*").alias("_k"))
    codes = kinds.groupBy(F.col("code").alias("_code")).agg(F.sum("_k").alias("_n"), F.coalesce(F.sum(F.when(F.col("_real"), F.col("_k"))), F.lit(0)).alias("_reals"))
    source = lambda real_: F.when(real_, real).when(F.col("_reals") == 0, 3 * synth).otherwise(synth)
    total = codes.agg(F.sum((F.col("_reals") * real + (F.col("_n") - F.col("_reals")) * source(F.lit(False))) / F.col("_n")).alias("_t"), F.sum("_n").alias("_c"))  # one row
    raw = samples.join(codes, F.col("code").eqNullSafe(F.col("_code"))).withColumn("_w", source(is_real) / F.col("_n"))
    return raw.crossJoin(F.broadcast(total)).withColumn("weight", F.col("_w") * F.col("_c") / F.col("_t")).drop("_w", "_t", "_c", "_code", "_n", "_reals")


UNITS = 1_000_000  # of a weight of one; draws work on whole units


def mixed(k: Column, seed: int) -> Column:
    """A portable pseudo-random number below 2^31 from an integer below it: steps of ``spread`` with the high bits folded in."""
    for shift, factor in ((15, 2654435761), (13, 1103515245), (16, 69069)):
        k = (k * factor + seed) % 2147483648
        k = k.bitwiseXOR(F.shiftright(k, shift))
    return k


def draw_with_replacement(weighted: DataFrame, n: int, seed: int, ident: str = "id", weight: str = "weight") -> DataFrame:
    """SMP-01: ``n`` draws (draw from 0, and the drawn row's columns), each row with a chance in proportion to its weight.

    Weights in whole units are summed exactly: within slices of the spread order, then over the slices, so a row owns the range [lo, hi) of
    all units and no window holds all rows. A draw is a seeded place in that range. To find its row, the range is cut into as many
    cells as there are rows: a row is sent to the cells it overlaps (twice the rows in all) and a draw to its cell, an equi-join in which a heavy
    row is many cells. NULL, zero and negative weights are never drawn; without any other there are no draws.
    """
    place = spread(F.col(ident), seed)
    units = F.greatest(F.lit(0), F.coalesce(F.round(F.col(weight) * UNITS), F.lit(0))).cast("long")
    rows = weighted.withColumns({"_u": units, "_s": F.floor(place / (2147483648 / SLICES)).cast("int")}).filter("_u > 0")
    sums = rows.groupBy(F.col("_s").alias("_t")).agg(F.sum("_u").alias("_c"), F.count("*").alias("_m"))
    every = Window.orderBy("_t")  # SLICES rows
    starts = sums.withColumn("_start", F.sum("_c").over(every) - F.col("_c")).drop("_c", "_m")
    total, count = sums.agg(F.sum("_c"), F.sum("_m")).first()
    if not total:
        return weighted.limit(0).select(F.lit(0).cast("long").alias("draw"), "*")
    cell = -(-total // count)
    up_to = F.sum("_u").over(Window.partitionBy("_s").orderBy(place, ident).rowsBetween(Window.unboundedPreceding, 0))
    owned = rows.withColumn("_hi", up_to).join(starts, F.col("_s") == F.col("_t")).withColumn("_hi", F.col("_hi") + F.col("_start"))
    owned = owned.withColumn("_lo", F.col("_hi") - F.col("_u")).drop("_s", "_t", "_start", "_u")
    spread_out = owned.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / cell).cast("long"), F.floor((F.col("_hi") - 1) / cell).cast("long"))))
    high, low = mixed(F.col("draw") % 2147483648, seed), mixed((F.col("draw") + 97) % 2147483648, seed + 1)
    q, r = F.lit(total >> 31).cast("long"), F.lit(total & 0x7FFFFFFF).cast("long")
    at = high * q + F.shiftright(high * r, 31) + F.shiftright(low * q, 31)
    draws = weighted.sparkSession.range(n).select(F.col("id").alias("draw"), at.alias("_at")).withColumn("_in", F.floor(F.col("_at") / cell).cast("long"))
    hit = draws.join(spread_out, (F.col("_in") == F.col("_cell")) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")))
    return hit.select("draw", *(F.col(c) for c in weighted.columns))


def vocabulary(codes: DataFrame) -> DataFrame:
    """AGG-30, SET-02: blank, then the letters, then the digits in use, numbered."""
    chars = codes.select(F.explode(F.split("code", "")).alias("ch")).filter("ch <> ''").distinct().filter(F.col("ch").rlike("^[A-Za-z0-9]$"))
    rank = F.row_number().over(Window.orderBy(F.col("ch").rlike("[0-9]"), "ch"))
    return chars.withColumn("idx", rank).unionByName(codes.sparkSession.createDataFrame([("<blank>", 0)], "ch string, idx int"))


def pool(codes: DataFrame, positions: DataFrame) -> DataFrame:
    """PAL-09: codes (n, code) repeated over positions (pos): each occurs floor(count / codes) times at least."""
    total = codes.agg(F.count("*").alias("_m"))
    return positions.crossJoin(F.broadcast(total)).withColumn("n", F.col("pos") % F.col("_m")).join(codes, "n").drop("n", "_m")


def blank_out(cells: DataFrame, fraction: float, seed: int) -> DataFrame:
    """PAL-10: int(n * fraction) positions of each board become BLANK."""
    w = Window.partitionBy("job").orderBy(spread(F.col("row") * 1000 + F.col("col"), seed), "row", "col")
    hit = F.row_number().over(w) <= F.floor(F.count("*").over(Window.partitionBy("job")) * fraction)
    return cells.withColumn("code", F.when(hit, "BLANK").otherwise(F.col("code")))


def draw(u: Column, shares: list[tuple[str, float]]) -> Column:
    """PAL-11, PAL-19: a level by cumulative shares; the last takes the rest."""
    out, edge = None, 0.0
    for name, share in shares[:-1]:
        edge += share
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return out.otherwise(shares[-1][0])


#: Shares of the quality and of the luminance levels.
QUALITY_LEVELS = [("clean", 0.55), ("light", 0.30), ("medium", 0.13), ("heavy", 0.02)]
LUMINANCE_LEVELS = [("dark", 0.37), ("mid", 0.39), ("bright", 0.24)]


def random_code(ident: Column, seed: int) -> Column:
    """STR-17, PAL-18: a letter and one or two digits from an integer."""
    h = spread(ident, seed)
    return F.concat(F.char((65 + h % 26).cast("int")), (1 + F.floor(h / 26) % 99).cast("string"))


def choose(ident: Column, seed: int, codes: Column) -> Column:
    """SMP-03: a uniform choice from an array."""
    return F.get(codes, (spread(ident, seed) % F.size(codes)).cast("int"))


def per_code_index(samples: DataFrame) -> DataFrame:
    """WIN-09, SNK-16: a code's rows by ascending id from 0; the order of ids is cut by quantiles, so a hot code is many tasks."""
    return rank_by_slices(samples, slices_of(samples, "id"), [F.col("id")], "code").withColumn("index", (F.col("_rank") - 1).cast("int")).drop("_rank", "_n")


def shuffled_head(samples: DataFrame, n: int, seed: int, ident: str = "id") -> DataFrame:
    """SRT-12: a seeded shuffle cut to n rows, a feature of the assembly."""
    return samples.orderBy(spread(F.col(ident), seed), ident).limit(n)
