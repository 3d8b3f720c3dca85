"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each vector o is centred, normalised and rotated by a seeded random orthogonal matrix; its code is
the sign of each coordinate. With x the code's unit vector (+-1/sqrt(d)), <x, q>/<x, o> estimates
<o, q> for a rotated unit query q, and its error stays within
eps * sqrt((1 - <x,o>^2) / (<x,o>^2 * (d-1))) with high probability. Packed bits, the norm, <x, o> and the
error factor are stored for every row; the index covers every row. A query's coordinates are rounded to PLANES
bits, so <x, q> comes from counting the bits that the code shares with each plane; what the rounding may
change at most, the norm of its error over <x, o>, widens the bound.

A search goes through blocks of rows. Estimated distances less their error bounds are lower bounds;
a query computes exact distances for the rows whose lower bound does not exceed its tenth best exact distance so far,
the most promising first. Local results are merged by exact distance, ties to the smaller id.

Rows whose vector is null, zero, or holds null or non-finite components take no part; nor do rows of
another length than the most frequent (the smaller at a tie). Rows that repeat an id are candidates of their own, for each other
too: a query leaves out only its own row.
Queries are read in blocks of QUERY_BLOCK and broadcast block by block, so the broadcast is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import materialize

EPS = 2.6
QUERY_BLOCK = 4096
ROWS = 4096
PLANES = 6  # bits of a query's coordinate


def rotation(d: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(vec_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(ok & F.col(id_col).isNotNull())


def build(vectors: DataFrame, d: int, centre: np.ndarray, seed: int = 5) -> DataFrame:
    """The index: (row, vec_id, v, code, norm, dot, error) of each row; the code's bits fill 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = rotation(d, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), d) - centre
            norm = np.linalg.norm(x, axis=1)
            o = (x / np.maximum(norm, 1e-300)[:, None]) @ p
            bits = o >= 0
            dot = np.abs(o).sum(1) / np.sqrt(d)
            dot = np.where(norm > 0, dot, 1.0)
            error = EPS * np.sqrt(np.maximum(0, 1 - dot * dot) / (dot * dot * max(1, d - 1)))
            packed = np.packbits(np.pad(bits, ((0, 0), (0, -d % 64))), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), batch.column("v"), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(norm), pa.array(dot), pa.array(error)],
                ["row", "vec_id", "v", "code", "norm", "dot", "error"],
            )

    return vectors.mapInArrow(run, "row long, vec_id long, v array<double>, code binary, norm double, dot double, error double")


def planes(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bit planes, least coordinate, step, norm of the rounding's error) of rotated unit queries, rounded to PLANES bits."""
    low = rotated.min(axis=1)
    step = np.maximum(rotated.max(axis=1) - low, 1e-300) / ((1 << PLANES) - 1)
    level = np.rint((rotated - low[:, None]) / step[:, None]).astype(np.int64)
    error = np.linalg.norm(rotated - (low[:, None] + step[:, None] * level), axis=1)
    bits = (level[:, None, :] >> np.arange(PLANES)[None, :, None] & 1).astype(bool)
    packed = np.packbits(np.pad(bits, ((0, 0), (0, 0), (0, -rotated.shape[1] % 64))), axis=2)
    return packed.view(np.uint64), low, step, error


def inner(code: np.ndarray, plane: np.ndarray, low: np.ndarray, step: np.ndarray, d: int) -> np.ndarray:
    """<x, q> of each query (a row) and code (a column), from the bits they share."""
    shared = np.zeros((len(plane), len(code)), np.int32)
    for j in range(PLANES):
        for w in range(code.shape[1]):
            shared += np.left_shift(np.bitwise_count(plane[:, j, w][:, None] & code[None, :, w]), j, dtype=np.int32)
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    levels = (np.bitwise_count(plane).sum(axis=2, dtype=np.int64) << np.arange(PLANES)).sum(axis=1)
    positive = low[:, None] * ones + step[:, None] * shared  # sum of q where the code has a one
    return (2 * positive - (low * d + step * levels)[:, None]) / np.sqrt(d)


def search_block(index: DataFrame, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, k: int, seed: int = 5) -> DataFrame:
    """Local results (query_row, query_id, vec_id, score) of a block of queries."""
    d = queries.shape[1]
    shared = index.sparkSession.sparkContext.broadcast((rows, ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_row, qid, q = shared.value
        p, n = rotation(d, seed), len(qid)
        c = q - centre
        q_norm = np.linalg.norm(c, axis=1)
        rotated = (c / np.maximum(q_norm, 1e-300)[:, None]) @ p
        plane, least, step, rounding = planes(rotated)
        best_d, best_i = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                v, vid, at_row = matrix(part.column("v"), d), part.column("vec_id").to_numpy(), part.column("row").to_numpy()
                norm, dot, error = (part.column(x).to_numpy() for x in ("norm", "dot", "error"))
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint64).reshape(len(vid), -1)
                for a in range(0, n, 256):
                    b = min(a + 256, n)
                    est = inner(code, plane[a:b], least[a:b], step[a:b], d) / dot
                    low = q_norm[a:b, None] ** 2 + norm**2 - 2 * q_norm[a:b, None] * norm * (est + error + rounding[a:b, None] / dot)
                    order = np.argpartition(low, min(4 * k, low.shape[1] - 1), axis=1)[:, : 4 * k]
                    for r in range(b - a):
                        row = a + r
                        for first in (True, False):  # the promising ones set the bar for the rest
                            cand = order[r] if first else np.setdiff1d(np.flatnonzero(low[r] <= best_d[row, -1] ** 2 * (1 + 1e-9)), order[r])
                            if not len(cand):
                                continue
                            dist = np.sqrt(((v[cand] - q[row]) ** 2).sum(1))
                            dist[at_row[cand] == q_row[row]] = np.inf
                            keep = dist <= best_d[row, -1]
                            all_d = np.concatenate([best_d[row], dist[keep]])
                            all_i = np.concatenate([best_i[row], vid[cand[keep]]])
                            top = np.lexsort((all_i, all_d))[:k]
                            best_d[row], best_i[row] = all_d[top], all_i[top]
        got = np.isfinite(best_d)
        if got.any():
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(x, got.sum(1))) for x in (q_row, qid)), pa.array(best_i[got]), pa.array(best_d[got])], ["query_row", "query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_row long, query_id long, vec_id long, score double")


def search(df: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each row that meets ``is_query`` (SQL on vec_id)."""
    vectors = valid(df, id_col, vec_col)
    dims = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = dims["d"]
    vectors = vectors.filter(F.size("v") == d)
    centre = np.array(vectors.select(*(F.avg(F.col("v")[i]).alias(f"c{i}") for i in range(d))).first(), np.float64)
    index = materialize(build(vectors.withColumn("row", F.monotonically_increasing_id()), d, centre), "index")
    queries = index.filter(is_query).select("row", "vec_id", "v")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = []
    for b in range(blocks):
        table = queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()
        if table.num_rows:
            found.append(search_block(index, table.column("row").to_numpy(), table.column("vec_id").to_numpy(), matrix(table.column("v").combine_chunks(), d), centre, k))
    if not found:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    local = found[0]
    for x in found[1:]:
        local = local.union(x)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found of every vector whose vec_id is divisible by 100."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0")
