"""Accuracy metrics and regression gates (AGG-12 to 17, 29, 32, WIN-12, GAT-01 to 03, PRD-16)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.datasets import slices_of


def accuracy(pred: DataFrame, *by: str) -> DataFrame:
    """AGG-12 over (label, code, confidence): accuracies of blanks and codes with denominators of one at least."""
    blank = F.col("label") == "BLANK"
    hit = F.col("label") == F.col("code")
    share = lambda of: F.count_if(of & hit) / F.greatest(F.lit(1), F.count_if(of))
    return pred.groupBy(*by).agg(
        F.count("*").alias("n"), share(blank).alias("blank_acc"), share(~blank).alias("code_acc"), (F.count_if(hit) / F.greatest(F.lit(1), F.count("*"))).alias("overall"),
        F.coalesce(F.avg(F.when(blank, F.col("confidence"))), F.lit(0.0)).alias("blank_conf"), F.coalesce(F.avg(F.when(~blank, F.col("confidence"))), F.lit(0.0)).alias("code_conf"),
    )


def percentiles(df: DataFrame, value: str, shares: list[float], *by: str) -> DataFrame:
    """AGG-13: (by, p0, p1, ...) the exact percentiles of each group, linear between ranks, without NULL and NaN; a group of these only has NULL.

    Distributed selection: equal values are counted first, the values are cut into ranges by approximate quantiles and the counts by range
    tell which ranges hold the wanted ranks. Only the values of these ranges are ordered, range by range, so no task holds a group's values and a value
    that a third of the rows share is one row.
    """
    v = F.col(value)
    known = df.filter(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*by, v.cast("double").alias("_v"))
    slice_ = slices_of(known, "_v")
    known = known.groupBy(*by, "_v").agg(F.count("*").alias("_c")).withColumn("_s", slice_)
    ranges = known.groupBy(*by, "_s").agg(F.sum("_c").alias("_k"))
    whole = Window.partitionBy(*by)
    ranges = ranges.withColumns({"_end": F.sum("_k").over(whole.orderBy("_s")), "_n": F.sum("_k").over(whole)}).withColumn("_begin", F.col("_end") - F.col("_k"))
    place = lambda p: (F.col("_n") - 1) * F.lit(p)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")) for p in shares))))
    wanted = ranges.withColumn("_ranks", F.filter(ranks, lambda k: (k >= F.col("_begin")) & (k < F.col("_end")))).filter(F.size("_ranks") > 0)
    wanted = wanted.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_s").alias("_t"), "_begin", "_n", "_ranks")
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_s") == F.col("_t")]
    inside = known.join(wanted, reduce(lambda x, y: x & y, same))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_s").orderBy("_v")) + F.col("_begin")
    inside = inside.withColumn("_upto", upto).withColumn("_rank", F.explode(F.filter("_ranks", lambda k: (k >= F.col("_upto") - F.col("_c")) & (k < F.col("_upto")))))
    found = inside.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"), F.max("_n").alias("_n"))  # two values a share

    def between(p: float) -> Column:
        low, high = (F.element_at("_m", f(place(p)).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place(p) - F.floor(place(p)))

    got = found.select(*(F.col(c).alias(f"_by_{c}") for c in by), *(between(p).alias(f"p{k}") for k, p in enumerate(shares)))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    if not by:
        return groups.join(got, how="left")
    return groups.join(got, reduce(lambda x, y: x & y, same[:-1]), "left").select(*by, *(f"p{k}" for k in range(len(shares))))


def baseline(pred: DataFrame, least: float, *by: str) -> DataFrame:
    """AGG-13, AGG-29: exact match, acceptance, unknown rate and exact percentiles (linear between ranks)."""
    hit, ok = F.col("label") == F.col("code"), F.col("confidence") >= least
    figures = pred.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(hit.cast("double")).alias("exact"), F.count_if(ok).alias("accepted"), F.try_divide(F.count_if(ok & hit), F.count_if(ok)).alias("accepted_acc"),
        F.avg((~ok).cast("double")).alias("unknown_rate"), F.avg("confidence").alias("mean"),
    )
    q = percentiles(pred, "confidence", [0.1, 0.5, 0.9], *by).select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("p0").alias("p10"), F.col("p1").alias("median"), F.col("p2").alias("p90"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return (figures.join(q, reduce(lambda x, y: x & y, same)) if by else figures.join(q)).drop(*(f"_by_{c}" for c in by))


def per_code(pred: DataFrame) -> DataFrame:
    """AGG-14."""
    return pred.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("code")).cast("double")).alias("acc"))


def best_and_worst(per: DataFrame, k: int) -> DataFrame:
    """WIN-12: the k labels of least and of greatest accuracy, then size; over one row a label."""
    low = per.orderBy("acc", F.desc("n"), "label").limit(k).withColumn("side", F.lit("worst"))
    return low.unionByName(per.orderBy(F.desc("acc"), F.desc("n"), "label").limit(k).withColumn("side", F.lit("best")))


def grid_scores(truth: DataFrame, pred: DataFrame, valid: DataFrame, *by: str) -> DataFrame:
    """AGG-15, JON-10: correct, wrong, invalid and missed cells of those with a known truth."""
    t = truth.filter("truth IS NOT NULL").join(pred, [*by, "row", "col"], "left").join(valid.select("code", F.lit(True).alias("_v")).distinct(), "code", "left")
    hit = F.col("code") == F.col("truth")
    return t.groupBy(*by).agg(
        F.count("*").alias("cells"), F.count_if(hit).alias("correct"), F.count_if(F.col("code").isNotNull() & F.col("_v").isNull()).alias("invalid"), F.count_if(F.col("code").isNull()).alias("missed"),
        (F.count_if(hit) / F.greatest(F.lit(1), F.count("*"))).alias("exact_rate"), (F.count_if(F.col("code").isNotNull()) / F.greatest(F.lit(1), F.count("*"))).alias("coverage"),
    )


def micro_average(scores: DataFrame) -> DataFrame:
    """AGG-16."""
    return scores.agg(F.sum("cells").alias("cells"), F.sum("correct").alias("correct"), (F.sum("correct") / F.greatest(F.lit(1), F.sum("cells"))).alias("exact_rate"))


def gate(candidate: DataFrame, production: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """JON-11, GAT-01, GAT-02: a row for each set in both and metric; fails when the candidate is worse by more than the tolerance."""
    names = ("blank_acc", "code_acc", "overall")
    both = candidate.select("set_name", *(F.col(c).alias(f"c_{c}") for c in names)).join(production.select("set_name", *(F.col(c).alias(f"p_{c}") for c in names)), "set_name")
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.round(F.col(f"c_{c}") - F.col(f"p_{c}"), 9).alias("delta")) for c in names)))
    return both.select("set_name", rows.alias("x")).select("set_name", "x.metric", "x.delta", (F.col("x.delta") < -tolerance).alias("fails"))


def verdict(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("checks"), F.count_if(F.col("fails")).alias("failures"), F.coalesce(F.bool_and(~F.col("fails")), F.lit(True)).alias("passes"))


def parity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """AGG-32: largest and mean absolute difference of two arrays."""
    d = F.transform(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda x: F.abs(x["a"] - x["b"]))
    return pairs.withColumn("_d", d).agg(F.count("*").alias("n"), F.max(F.array_max("_d")).alias("max_diff"), F.avg(F.aggregate("_d", F.lit(0.0).cast("double"), lambda s, x: s + x) / F.size("_d")).alias("mean_diff"))


def within(pairs: DataFrame, a: str, b: str, relative: float = 1e-4, absolute: float = 1e-5) -> DataFrame:
    """OCR-25: ``pairs`` with ``close``: all of ``a`` within absolute + relative * |b| of ``b``; arrays of other lengths, NULL and NaN aren't close."""
    near = F.forall(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda x: F.coalesce(F.abs(x["a"] - x["b"]) <= absolute + relative * F.abs(x["b"]), F.lit(False)) & ~F.isnan(F.coalesce(x["a"] - x["b"], F.lit(0.0))))
    return pairs.withColumn("close", F.coalesce((F.size(a) == F.size(b)) & near, F.lit(False)))


def parity_gate(n: int, prep: float, logits: float, conf: float, mismatches: int) -> bool:
    """GAT-03."""
    return n >= 64 and prep < 1.0 and logits < 0.05 and conf < 0.01 and mismatches == 0


def truth_from_predictions(positions: DataFrame, pred: DataFrame, bar: float = 0.9) -> DataFrame:
    """PRD-16: confident cells as truth, the rest for hand labelling."""
    ok = F.coalesce(F.col("confidence") >= bar, F.lit(False))
    return positions.join(pred, ["job", "row", "col"], "left").select("job", "row", "col", F.when(ok, F.col("code")).alias("code"), F.when(ok, "auto").otherwise("needs_manual").alias("source"))


def mismatches(pred: DataFrame, k: int = 20) -> DataFrame:
    """AGG-29: the first k mismatches, by id."""
    return pred.filter("label <> code").orderBy("id").limit(k)


def rank_checkpoints(results: DataFrame, metric: str) -> DataFrame:
    """SRT-09."""
    return results.orderBy(F.desc(metric), "name").withColumn("place", F.row_number().over(Window.orderBy(F.desc(metric), "name")))
