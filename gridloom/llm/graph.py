"""Connected components by alternating large-star and small-star steps, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize


EDGES = 200_000


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _write(edges: DataFrame, about: int) -> DataFrame:
    """Written with a file for every EDGES edges; ``about``: how many there were before the step."""
    return materialize(edges.coalesce(1 + about // EDGES), "edges")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of ``edges`` (a, b): label is the smallest vertex reachable.

    A hot vertex costs rows in proportion to its edges only; the rounds grow with the logarithm
    of the longest path. No edges give no rows; loops and repeated edges change nothing.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = _write(edges.distinct(), edges.count())
    state = _state(e)
    while state[0]:
        e = _write(_small(_large(e)), 2 * state[0])
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("v"), F.col("v").alias("label")).union(e.select("v", F.col("v").alias("label")).distinct())
