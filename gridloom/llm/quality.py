"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are quality + (1 - toxic), whole numbers; their levels are those of the fitted rows. One weight vector over hashed text features is
shared by all grades; ordered thresholds cut its scale: P(grade >= k) = sigmoid(x.w - theta_k).
The expected grade is the lowest level and each tail probability times its level's distance to the one below; a document is selected when the tail
probability of the top grade is at least ``min_tail``.

Features: presence of each lower-cased word; share of the words that have a given shape
(letters, capitals, digits collapsed; signs kept); share of words equal to the word before.

The model is fitted on at most ``sample`` labelled rows, chosen by the order of a seeded hash of
doc_id (a documented bound of the fit); every document is scored over its whole text.
Null or empty text has no features and gets the scale's origin. Ties in the sample order go to
the smaller doc_id; labels that repeat for a doc_id count once each; null labels are left out. Of rows that repeat a labelled doc_id
the least text is fitted on, so the fit's rows are no more than its labels.
With no labelled row, or labels of one grade only, all weights are zero and nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import textvec as tv
from gridloom.llm.common import doc_texts, fresh

SAMPLE = 8_000
SLOT_BITS = 20
SHAPE_SCALE = 4.0
_SHAPE_SALT, _REPEAT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


@dataclass
class OrdinalModel:
    """fingerprint and weight by slot; thresholds in ascending order, one less than the levels of the grade."""

    fingerprint: np.ndarray
    weight: np.ndarray
    theta: np.ndarray
    levels: np.ndarray

    def tails(self, eta: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., a column each."""
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.theta[None, :], -60, 60)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.levels[0] + tails @ np.diff(self.levels).astype(np.float64)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint32)


def _streams(words: tv.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, words they belong to) of the share features: shapes and repeats."""
    repeat = np.flatnonzero(words.h[1:] == words.h[:-1]) + 1
    repeat = repeat[~np.isin(repeat, words.ptr)]
    return [(words.shapes() ^ _SHAPE_SALT, np.arange(len(words.h))), (np.full(len(repeat), _REPEAT), repeat)]


def _features(words: tv.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, values) of each row, for the fit."""
    streams, share = _streams(words), SHAPE_SCALE / np.maximum(1, words.counts)
    where = [np.searchsorted(at, words.ptr) for _, at in streams]
    for r in range(len(words.ptr) - 1):
        u = np.unique(words.h[words.ptr[r] : words.ptr[r + 1]])
        hs, vs = [u], [np.ones(len(u))]
        for (h, _), ptr in zip(streams, where, strict=True):
            s, c = np.unique(h[ptr[r] : ptr[r + 1]], return_counts=True)
            hs.append(s)
            vs.append(c * share[r])
        yield np.concatenate(hs), np.concatenate(vs)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = tv.buffers(batch.column("text"))
        for i, j in tv.slices(off):
            rows = list(_features(tv.Words(data, off[i : j + 1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade").slice(i, j - i), pa.array([h.tobytes() for h, _ in rows], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())],
                ["grade", "h", "v"],
            )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7, min_df: int = 4) -> OrdinalModel:
    """The model from at most ``sample`` labelled rows; the sample's size bounds the broadcast and what the driver gathers."""
    graded = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality").cast("int") + 1 - F.col("toxic").cast("int")).alias("grade")
    ).filter("doc_id IS NOT NULL AND grade IS NOT NULL")
    chosen = graded.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "grade").limit(sample)
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, grade int")
    texts = doc_texts(docs).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "grade").mapInArrow(_sample_features, "grade int, h binary, v binary").toArrow()
    grades = rows.column("grade").to_numpy() if rows.num_rows else np.zeros(0, int)
    empty = OrdinalModel(np.zeros(1 << SLOT_BITS, np.uint32), np.zeros(1 << SLOT_BITS, np.float32), np.array([-4.0, -2.0]), np.arange(3))
    levels, grades = np.unique(grades, return_inverse=True)
    if len(levels) < 2:
        return empty
    hs = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("h")]
    vs = [np.frombuffer(x.as_py(), np.float32) for x in rows.column("v")]
    ptr = np.concatenate([[0], np.cumsum([len(h) for h in hs])])
    h, v = np.concatenate(hs), np.concatenate(vs)
    names, col, df = np.unique(h, return_inverse=True, return_counts=True)
    keep = df >= min_df
    order = np.lexsort((names, -df))  # of features that share a slot, the most frequent keeps it
    _, first = np.unique(_slots(names[order]), return_index=True)
    owner = np.zeros(len(names), bool)
    owner[order[first]] = True
    keep &= owner
    new = np.cumsum(keep) - 1
    used = keep[col]
    row = np.repeat(np.arange(len(grades)), np.diff(ptr))[used]
    w, theta = train(new[col[used]], v[used], row, grades, int(keep.sum()), len(levels) - 1)
    live = w != 0
    model = empty
    slot = _slots(names[keep][live])
    model.fingerprint[slot], model.weight[slot] = _prints(names[keep][live]), w[live]
    model.theta, model.levels = theta, levels
    return model


def train(col: np.ndarray, val: np.ndarray, row: np.ndarray, grades: np.ndarray, n_features: int, levels: int = 2, l1: float = 1e-4, steps: int = 300, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Grades count from 0 to ``levels``. Full-batch proximal Adagrad on the cumulative-link log loss with an L1 penalty; thresholds stay ordered."""
    n = len(grades)
    w, g2 = np.zeros(n_features), np.full(n_features, 1e-8)
    share = np.array([np.mean(grades >= k) for k in range(1, levels + 1)]).clip(1e-3, 1 - 1e-3)
    theta, t2 = -np.log(share / (1 - share)), np.full(levels, 1e-8)
    low = np.where(grades > 0, np.maximum(grades - 1, 0), -1)
    for _ in range(steps):
        eta = np.bincount(row, val * w[col], n)
        p = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta[None, :], -40, 40)))  # tails
        a = np.where(low >= 0, p[np.arange(n), np.maximum(low, 0)], 1.0)  # P(y >= grade)
        b = np.where(grades < levels, p[np.arange(n), np.minimum(grades, levels - 1)], 0.0)  # P(y >= grade + 1)
        q = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) * (low >= 0), b * (1 - b) * (grades < levels)
        g_eta = -(da - db) / q / n
        g = np.bincount(col, val * g_eta[row], n_features)
        g_theta = np.array([np.sum((da / q)[low == k]) - np.sum((db / q)[grades == k]) for k in range(levels)]) / n
        g2 += g * g
        step = rate / np.sqrt(g2)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        t2 += g_theta * g_theta
        theta = np.sort(theta - rate / np.sqrt(t2) * g_theta)
    return w, theta


def eta_of(words: tv.Words, model: OrdinalModel) -> np.ndarray:
    """x.w of each row."""
    n, row = len(words.ptr) - 1, words.row_of()
    slot = _slots(words.h)
    hit = np.flatnonzero((model.weight[slot] != 0) & (model.fingerprint[slot] == _prints(words.h)))
    pair = np.unique(row[hit].astype(np.int64) << SLOT_BITS | slot[hit])
    eta = np.bincount(pair >> SLOT_BITS, model.weight[pair & ((1 << SLOT_BITS) - 1)], n)[:n] if len(pair) else np.zeros(n)
    for h, at in _streams(words):
        slot = _slots(h)
        hit = np.flatnonzero((model.weight[slot] != 0) & (model.fingerprint[slot] == _prints(h)))
        if len(hit):
            eta = eta + np.bincount(row[at[hit]], model.weight[slot[hit]], n) * SHAPE_SCALE / np.maximum(1, words.counts)
    return eta


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", min_tail: float = 0.6) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, selected) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            for i, j in tv.slices(off):
                tails = m.tails(eta_of(tv.Words(data, off[i : j + 1]), m))
                top = tails[:, -1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(m.expected(tails)), pa.array(top), pa.array(top >= min_tail)],
                    ["doc_id", "expected_grade", "tail_probability", "selected"],
                )

    return doc_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, selected boolean")


def select(docs: DataFrame, labels: DataFrame, fit_on: DataFrame | None = None, min_tail: float = 0.6) -> DataFrame:
    """The rows of ``docs`` that the classifier selects, all columns kept; text is scored where it stands, without a join. It is fitted on the labelled rows of ``fit_on``, or else of ``docs``."""
    model = fit(docs if fit_on is None else fit_on, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = fresh(docs, "text_to_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off = tv.buffers(batch.column(text))
            rows = batch.drop_columns([text])
            for i, j in tv.slices(off):
                top = m.tails(eta_of(tv.Words(data, off[i : j + 1]), m))[:, -1]
                yield rows.slice(i, j - i).filter(pa.array(top >= min_tail))

    return docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade, tail probability and selection."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
