"""Embedding whitening by upper-triangle column aggregates.

Every component c of a vector, as a double, becomes the whole number x = floor(1024 * c) + 100000. One pass
adds up each dimension exactly. From these sums one Spark SQL expression is generated for each dimension pair
i <= j, the sum of the products of both centred values, and all of them are computed in one aggregation, whose
partial rows (17 KB for 64 dimensions, whatever the table's size) are all that is shuffled. The covariance is
assembled from this row, and LAPACK (``eigh``) gives its unit eigenvectors. A last pass projects each row. Products are
centred before they are multiplied, so the large common offset costs no digits.

Vectors that are null or hold null or non-finite entries take no part, nor do empty ones, those of
another length than the most frequent (the longer at a tie) and those with an entry of 2^40 or more in
size, whose x would have no exact place in the sums. Components whose eigenvalue is not above 1e-12 of the largest
have no whitened values and are left out: a table of equal vectors gives no rows, as does an empty one.
Repeated ids and vectors count as often as they occur; null ids stay. Columns besides the id and the vector are ignored.
A component's sign is set so that its largest entry is positive. A deviation beyond the range of a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import drop, materialize, table

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 40)
PAIRS = 4096  # expressions of one aggregation; 90 dimensions need one, more dimensions one a block of pairs
FLOOR = 1e-12


@dataclass(frozen=True)
class Fit:
    """n vectors, exact sums of each dimension, eigenvalues (falling) and eigenvectors (columns), trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)


def scaled(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<long>) of the rows that take part, whatever their length."""
    v = F.col(vector_col)
    good = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST)), F.lit(False))
    x = F.transform(v, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT).cast("long"))
    return df.filter(good & (F.size(v) > 0)).select(F.col(id_col).alias("id"), x.alias("x"))


def pair_sums(df: DataFrame, columns: list[Column], means: list[float]) -> np.ndarray:
    """The full matrix of sums of centred products, from an upper triangle of generated expressions.

    The centred columns are projected first, so each is computed once a row and not once a pair.
    """
    d = len(columns)
    centred = df.select(*((F.coalesce(c.cast("double"), F.lit(0.0)) - F.lit(m)).alias(f"c{i}") for i, (c, m) in enumerate(zip(columns, means))))  # never null, which makes the sums shorter
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for at in range(0, len(pairs), PAIRS):
        block = pairs[at : at + PAIRS]
        row = centred.selectExpr(*(f"sum(c{i} * c{j}) AS s{i}_{j}" for i, j in block)).first()
        for (i, j), s in zip(block, row):
            out[i, j] = out[j, i] = s or 0.0
    return out


def fit(rows: DataFrame) -> Fit | None:
    """The fit over the rows of ``scaled``; None without any."""
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = lengths["d"], lengths["n"]
    own = rows.filter(F.size("x") == d)
    x = [F.col("x")[i] for i in range(d)]
    sums = [int(s) for s in own.agg(*(F.sum(c.cast("decimal(20,0)")).alias(f"s{i}") for i, c in enumerate(x))).first()]
    cov = pair_sums(own, x, [s / n for s in sums]) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    return Fit(n, sums, values, vectors, float(np.trace(cov)))


def components(f: Fit, k: int) -> int:
    """How many of the first ``k`` components can be whitened."""
    return int((f.values[:k] > FLOOR * max(f.values[0], 0.0)).sum()) if f.values[0] > 0 else 0


def project(rows: DataFrame, f: Fit, k: int) -> DataFrame:
    """(id, deviation long, whitened array<double> of ``k``) of the rows that the fit covers."""
    n, d = f.n, f.dims
    basis = f.vectors[:, :k] / np.sqrt(f.values[:k])
    sums = np.array(f.sums, dtype=object)
    largest = max(map(abs, f.sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, d)
            x = x if n * int(np.abs(x).max(initial=0)) < 2**62 > largest else x.astype(object)
            off = x * n - (sums if x.dtype == object else sums.astype(np.int64))
            if int(np.abs(off).max(initial=0)) ** 2 * d < 2**63:
                square = (off * off).sum(1).astype(np.int64)
            else:  # Python's whole numbers
                square = [s if s < 2**63 else None for s in (off.astype(object) ** 2).sum(1)]
            white = (off / n).astype(np.float64) @ basis
            flat = pa.array(white.reshape(-1), pa.float64())
            starts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(square, pa.int64()), pa.ListArray.from_arrays(starts, flat)], names=["id", "deviation", "white"])

    own = rows.filter(F.size("x") == d)
    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, deviation long, white array<double>")


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8) -> DataFrame:
    """One row for each vector that takes part and component up to ``k``: id_col, component, n, deviation, whitened, explained, identity_error.

    The scaled vectors and the whitened values are written once; the error of their covariance against the identity comes from the same pair sums.
    """
    spark = df.sparkSession
    rows = materialize(scaled(df, id_col, vector_col), "scaled")
    f = fit(rows)
    k = components(f, k) if f is not None else 0
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return spark.createDataFrame([], schema)
    done = materialize(project(rows, f, k), "whitened")
    drop(rows)
    w = [F.col("white")[i] for i in range(k)]
    means = list(done.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(w))).first())
    error = float(np.abs(pair_sums(done, w, means) / f.n - np.eye(k)).max())
    share = F.array(*(F.lit(float(e / f.trace)) for e in f.values[:k]))
    return done.select(F.col("id").alias(id_col), "deviation", F.posexplode("white").alias("at", "whitened")).select(
        id_col, (F.col("at") + 1).alias("component"), F.lit(f.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every vector of ``embeddings``."""
    return whiten(table(spark, sf_dir, "embeddings"))
