"""Sequence decoding of frame scores (MTH-01 to 05, WIN-01, OCR-10 to 14). Class 0 is blank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frames(flat: Column, classes: int) -> Column:
    """ARR-07: a flat array as frames of ``classes`` scores."""
    n = F.floor(F.size(flat) / classes).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.slice(flat, t * classes + 1, classes))


def log_softmax(frame: Column) -> Column:
    """MTH-01 of one frame, shifted by its maximum."""
    top = F.array_max(frame)
    total = F.aggregate(frame, F.lit(0.0).cast("double"), lambda a, x: a + F.exp(x - top))
    # a list of one binds the total to a name: it is worked out once, not for each class
    return F.get(F.transform(F.array(top + F.ln(total)), lambda t: F.transform(frame, lambda x: x - t)), 0)


def arg_max(frame: Column) -> Column:
    """MTH-02: first index of the largest score."""
    return F.array_position(frame, F.array_max(frame)).cast("int") - 1


def greedy(log_probs: Column) -> Column:
    """WIN-01, MTH-03, OCR-12: struct (indices, confidence) of the collapsed free path."""
    best = F.transform(log_probs, arg_max)
    steps = F.transform(best, lambda x, t: F.struct(x.alias("k"), F.when(t > 0, F.get(best, t - 1)).otherwise(-1).alias("before"), F.array_max(F.get(log_probs, t)).alias("lp")))
    out = F.filter(steps, lambda s: (s["k"] != 0) & (s["k"] != s["before"]))
    total = F.aggregate(out, F.lit(0.0).cast("double"), lambda a, s: a + s["lp"])
    return F.struct(F.transform(out, lambda s: s["k"]).alias("indices"), F.when(F.size(out) == 0, 0.0).otherwise(F.exp(total / F.size(out))).alias("confidence"))


def spell(indices: Column, chars: list[str]) -> Column:
    """Indices to text; '?' for an unknown one."""
    table = F.array(*map(F.lit, chars))
    return F.array_join(F.transform(indices, lambda k: F.coalesce(F.get(table, k), F.lit("?"))), "")


class Trie:
    """ARR-10: prefixes of the allowed codes as a transition table; node 0 is the root."""

    def __init__(self, codes: list[str], chars: list[str]):
        at = {c: i for i, c in enumerate(chars)}
        self.text, nodes, steps = [""], {"": 0}, []
        for code in sorted(set(codes)):
            if all(c in at for c in code):
                for n in range(1, len(code) + 1):
                    if code[:n] not in nodes:
                        nodes[code[:n]] = len(self.text)
                        steps.append((nodes[code[: n - 1]], at[code[n - 1]], len(self.text)))
                        self.text.append(code[:n])
        self.next = np.full((len(self.text), len(chars)), -1, np.int32)
        for a, c, b in steps:
            self.next[a, c] = b

    def decode(self, log_probs: np.ndarray, penalty: float = 0.0, collapse: bool = True) -> tuple[list[str], np.ndarray]:
        """OCR-10 (OCR-11: penalty 2, collapse off) for a block of (rows, frames, classes), all rows at once.

        In each frame the best child of the row's node (lowest class at a tie) is held against blank less the penalty.
        A child that repeats the character of the frame before is emitted once: its score counts, the node stays.
        """
        n, frames_, _ = log_probs.shape
        node, last, live, score, row = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, bool), np.zeros(n), np.arange(n)
        for t in range(frames_):
            step = log_probs[:, t, :]
            open_ = np.where(self.next[node] >= 0, step, -np.inf)
            best = open_.argmax(1)
            emit = open_[row, best] > step[:, 0] - penalty
            stay = emit & live & (best == last) if collapse else np.zeros(n, bool)
            score += np.where(emit, step[row, best], 0)
            move = emit & ~stay
            node = np.where(move, self.next[node, best], node)
            last = np.where(move, best, last)
            live = emit
        return [self.text[k] for k in node], score


def _log_softmax(s: pd.Series, classes: int) -> np.ndarray:
    x = np.array(s.tolist(), np.float64).reshape(len(s), -1, classes)
    x = x - x.max(2, keepdims=True)
    return x - np.log(np.exp(x).sum(2, keepdims=True))


def free_paths(log_probs: np.ndarray, chars: list[str]) -> tuple[list[str], np.ndarray]:
    """WIN-01, MTH-03 for a block of (rows, frames, classes): text and confidence of the collapsed free paths."""
    best = log_probs.argmax(2)
    before = np.concatenate([np.full((len(best), 1), -1), best[:, :-1]], axis=1)
    emit = (best != 0) & (best != before)
    n = emit.sum(1)
    total = np.where(emit, log_probs.max(2), 0).sum(1)
    return ["".join(chars[k] if k < len(chars) else "?" for k in row[keep]) for row, keep in zip(best, emit, strict=True)], np.where(n > 0, np.exp(total / np.maximum(n, 1)), 0.0)


def constrained(df: DataFrame, scores: str, classes: int, trie: Trie, penalty: float = 0.0, chars: list[str] | None = None, collapse: bool = True) -> DataFrame:
    """OCR-10 (OCR-11: penalty 2, collapse off) over a relation: adds code and path_score. The trie is that of one dictionary (a few thousand codes), sent once.

    With ``chars`` the free path is decoded in the same pass: adds greedy_code and greedy_confidence.
    """
    shared = df.sparkSession.sparkContext.broadcast(trie)

    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            x = _log_softmax(s, classes)
            code, score = shared.value.decode(x, penalty, collapse)
            out = {"code": code, "path_score": score}
            if chars is not None:
                out["greedy_code"], out["greedy_confidence"] = free_paths(x, chars)
            yield pd.DataFrame(out)

    kind = "code string, path_score double" + (", greedy_code string, greedy_confidence double" if chars is not None else "")
    return df.withColumn("_d", F.pandas_udf(run, kind)(F.col(scores))).select("*", "_d.*").drop("_d")


def path_confidence(score: Column, frames_: Column) -> Column:
    """MTH-04."""
    return F.exp(score / F.greatest(frames_, F.lit(1)))


def legacy_confidence(score: Column, code: Column) -> Column:
    """MTH-05."""
    return F.exp(score / F.greatest(F.length(code), F.lit(1)))


def merge_paths(df: DataFrame, codes: list[str], frames_: int) -> DataFrame:
    """OCR-13: (code, path_score, greedy_code, greedy_confidence) to the final code and confidence; codes out of the dictionary fall away."""
    known = lambda c: c.isin(codes)
    final = F.when(~known(F.col("code")) & known(F.col("greedy_code")), F.col("greedy_code")).otherwise(F.col("code"))
    out = df.withColumn("final_code", final).filter(known(F.col("final_code")))
    return out.withColumn("final_confidence", F.when(F.col("greedy_code") == F.col("final_code"), F.col("greedy_confidence")).otherwise(path_confidence(F.col("path_score"), F.lit(frames_))))


def keep_confident(df: DataFrame, least: float, include_all: bool = False) -> DataFrame:
    """OCR-14."""
    return df if include_all else df.filter(F.col("final_confidence") >= least)
