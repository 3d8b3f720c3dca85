"""Benchmark decontamination by latent semantic retrieval.

The benchmark is cut into passages of at most PASSAGE words; their TF-IDF matrix (document
frequencies over all documents) is factored by a distributed randomised SVD: a seeded sketch and two
power steps, each a pass that sums partial products over the partitions. Every document is read
whole in windows of two blocks of BLOCK words, each block in two windows. A window is folded into
the latent space and compared by cosine with the latent passages. A passage of l words is a
candidate at COSINE * sqrt(min(1, l / window)) * captured: that a window holds the passage among
other words lowers the cosine by that root, and the rank by what it captures of the passage (the norm
of the latent row; the cosine of the passage with itself). One matrix holds PASSAGES passages at
most, so the rank captures about half of them however large the benchmark is. Candidates are then confirmed: the longest common subsequence of
the passage's words and the words around the window must cover LCS of the passage, and ANSWER of
the answer's words must occur there. The answer is the column ``answer`` where the benchmark has
one, else the passage's quarter of words with the highest idf. A document leaks an item when one of
the item's passages is confirmed; the figures are the means of those that are.

Words are runs of letters, digits and other non-ASCII characters, lower-cased. Null or empty texts and items have no
words and match nothing. Repeated items and documents are reported each under its id; extra columns
are ignored. Items go through in blocks of ITEM_WORDS words at most (or one item), so what is broadcast is
bounded; each block, with all its matrices, is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import textvec as tv
from gridloom.llm.common import doc_texts, fresh

PASSAGE, BLOCK, RANK, OVERSAMPLE = 48, 16, 112, 16
COSINE, LCS, ANSWER = 0.33, 0.7, 0.5
ITEM_WORDS = 100_000
PASSAGES = 256  # of one matrix


@dataclass
class Index:
    """vocab: sorted word hashes; basis: a row for each word, idf included; latent: unit rows of the passages."""

    vocab: np.ndarray
    idf: np.ndarray
    other_idf: float
    basis: np.ndarray
    latent: np.ndarray
    bar: np.ndarray
    item: np.ndarray
    words: list[np.ndarray]
    answer: list[np.ndarray]
    lookup: tv.Lookup | None = None
    plain: dict[int, tuple[list[int], set[int]]] | None = None

    def passage(self, q: int) -> tuple[list[int], set[int]]:
        """The words of a passage and of its answer as Python's, as a window has too few words for array calls."""
        if self.plain is None:
            self.plain = {}
        if q not in self.plain:
            self.plain[q] = self.words[q].tolist(), set(self.answer[q].tolist())
        return self.plain[q]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash in the vocabulary, -1 if it isn't there."""
        if self.lookup is None:
            self.lookup = tv.Lookup(self.vocab)
        return self.lookup.find(h)


def _lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case, all letters."""
    return tv.buffers(pc.utf8_lower(column))


def _words(text: str) -> np.ndarray:
    data, off = _lower(pa.array([text], pa.string()))
    return tv.Words(data, off, tv.LOOSE).h


def document_frequencies(docs: DataFrame, vocab: np.ndarray) -> tuple[np.ndarray, int]:
    """(documents that hold each word, documents) over all of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, *[None] * 8)
        df, n = np.zeros(len(shared.value) + 1, np.int64), 0
        for batch in batches:
            data, off = _lower(batch.column("text"))
            n += batch.num_rows
            for i, j in tv.slices(off):
                w = tv.Words(data, off[i : j + 1], tv.LOOSE)
                at, row = index.find(w.h), w.row_of()
                hit = at >= 0
                pair = np.unique(row[hit].astype(np.int64) * len(df) + at[hit])
                df += np.bincount(pair % len(df), minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(np.append(df[:-1], n))], ["word", "n"])

    sums = docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocab) + 1, np.int64)
    if sums.num_rows:
        out[sums.column("word").to_numpy()] = sums.column("n").to_numpy()
    return out[:-1], int(out[-1])


def randomised_svd(spark: SparkSession, rows: list[tuple[list[int], list[float]]], width: int, rank: int, steps: int = 2, seed: int = 3) -> np.ndarray:
    """Right singular vectors (width x rank) of a sparse matrix whose rows are dealt over the cluster.

    Each step sends the current width x l block out and sums the partitions' A^T (A X).
    """
    l = min(rank + OVERSAMPLE, len(rows), width)
    parts = max(1, min(8, len(rows) // 64))
    frame = spark.createDataFrame(rows, "col array<int>, val array<double>").repartition(parts)
    x = np.random.default_rng(seed).standard_normal((width, l))
    for _ in range(steps + 1):
        x, _ = np.linalg.qr(x)
        shared = spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(shared.value)
            for batch in batches:
                for c, v in zip(batch.column("col"), batch.column("val"), strict=True):
                    c, v = c.values.to_numpy(), v.values.to_numpy()
                    total[c] += v[:, None] * (v @ shared.value[c])[None, :]
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

        got = frame.mapInArrow(run, "sum binary").toArrow()
        y = sum(np.frombuffer(b.as_py(), np.float64).reshape(width, l) for b in got.column("sum"))
        small = x.T @ y
        value, vec = np.linalg.eigh((small + small.T) / 2)
        best, x = x @ vec[:, ::-1], y
    keep = max(1, int((value[::-1] > 1e-9).sum()))
    return best[:, : min(rank, keep)]


def build_indexes(spark: SparkSession, items: list[tuple[int, str, str | None]], docs: DataFrame, rank: int = RANK) -> list[Index]:
    """The indexes of a bounded block of items, PASSAGES passages each at most; none if no item has a word."""
    item, words, given = [], [], []
    for i, text, answer in items:
        w = _words(text or "")
        n = max(1, -(-len(w) // PASSAGE))
        for part in np.array_split(w, n):
            if len(part):
                item.append(i)
                words.append(part)
                given.append(_words(answer) if answer else None)
    if not words:
        return []
    vocab = np.unique(np.concatenate([*words, *(g for g in given if g is not None)]))
    df, n = document_frequencies(docs, vocab)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    cut = [int(x) for x in np.linspace(0, len(words), -(-len(words) // PASSAGES) + 1)]
    return [_index(spark, item[a:b], words[a:b], given[a:b], vocab, idf, rank) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _index(spark: SparkSession, item: list[int], words: list[np.ndarray], given: list[np.ndarray | None], all_words: np.ndarray, all_idf: np.ndarray, rank: int) -> Index:
    """The index of some passages; all_words, all_idf: the block's vocabulary."""
    vocab = np.unique(np.concatenate([*words, *(g for g in given if g is not None)]))
    idf = all_idf[np.searchsorted(all_words, vocab)]
    rows, norms = [], []
    for w in words:
        col, tf = np.unique(np.searchsorted(vocab, w), return_counts=True)
        v = (1 + np.log(tf)) * idf[col]
        rows.append((col.tolist(), (v / np.linalg.norm(v)).tolist()))
        norms.append(len(w))
    v = randomised_svd(spark, rows, len(vocab), rank)
    latent = np.stack([np.array(x) @ v[c] for c, x in rows])
    captured = np.maximum(np.linalg.norm(latent, axis=1), 1e-12)
    latent /= captured[:, None]
    answers = []
    for w, g in zip(words, given, strict=True):
        u = np.unique(w)
        answers.append(np.unique(g) if g is not None and len(g) else u[np.argsort(-idf[np.searchsorted(vocab, u)], kind="stable")[: max(1, len(u) // 4)]])
    bar = COSINE * np.sqrt(np.minimum(1, np.array(norms) / (2 * BLOCK))) * captured
    return Index(vocab, idf, float(idf.mean()), (v * idf[:, None]).astype(np.float32), latent.astype(np.float32), bar.astype(np.float32), np.array(item), words, answers)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = at.get(y)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _search(w: tv.Words, index: Index) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, passage, cosine, lcs share, answer share) of the confirmed candidates of a slice."""
    counts = w.counts
    n_blocks = -(-counts // BLOCK)
    first = np.concatenate([[0], np.cumsum(n_blocks)])
    total = int(first[-1])
    if not total:
        return
    doc = np.repeat(np.arange(len(counts)), n_blocks)
    start = w.ptr[doc] + tv.ramp(n_blocks) * BLOCK
    at = index.find(w.h)
    weight = np.where(at >= 0, index.idf[at], index.other_idf).astype(np.float32) ** 2
    bounds = np.append(start, len(w.h))
    norm2 = tv.row_sums(weight.astype(np.float64), bounds)
    known2 = tv.row_sums(np.where(at >= 0, weight, 0).astype(np.float64), bounds)
    last = np.append(doc[1:] != doc[:-1], True)
    nxt = np.minimum(np.arange(total) + 1, total - 1)
    w_norm2, w_known2 = np.where(last, norm2, norm2 + norm2[nxt]), np.where(last, known2, known2 + known2[nxt])
    alone = last & (n_blocks[doc] > 1)  # the window before holds it too
    live = ~alone & (w_known2 >= float(index.bar.min()) ** 2 * w_norm2)  # cos^2 cannot exceed the share of known words
    hits = np.flatnonzero(at >= 0)
    ptr = np.searchsorted(hits, bounds)
    for a in range(0, total, 2048):
        b = min(a + 2048, total)
        if not live[a:b].any():
            continue
        c = min(b + 1, total)
        sums = np.zeros((c - a, index.basis.shape[1]), np.float32)
        rows = hits[ptr[a] : ptr[c]]
        full = np.flatnonzero(np.diff(ptr[a : c + 1]))
        if len(full):
            sums[full] = np.add.reduceat(index.basis[at[rows]], ptr[a:c][full] - ptr[a], axis=0)
        pick = a + np.flatnonzero(live[a:b])
        both = sums[pick - a] + np.where(last[pick], 0, 1)[:, None].astype(np.float32) * sums[np.minimum(pick + 1, c - 1) - a]
        cos = both @ index.latent.T / np.sqrt(w_norm2[pick]).astype(np.float32)[:, None]
        for p, q in zip(*np.nonzero(cos >= index.bar), strict=True):
            blk = pick[p]
            r, (item, answer) = int(doc[blk]), index.passage(int(q))
            lo = max(int(w.ptr[r]), int(start[blk]) - len(item))
            hi = min(int(w.ptr[r + 1]), int(start[blk]) + 2 * BLOCK + len(item))
            span = w.h[lo:hi].tolist()
            met = set(span)
            here = len(answer & met) / len(answer)
            if here < ANSWER or sum(map(met.__contains__, item)) / len(item) < LCS:
                continue
            share = lcs(item, span) / len(item)
            if share >= LCS:
                yield r, int(q), float(cos[p, q]), share, here


def _indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[list[Index]]:
    """The indexes of each bounded block of items, read a partition at a time."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), answer.alias("answer"))
    block: list[tuple[int, str, str | None]] = []
    size = 0
    for row in _closed(items.toLocalIterator()):
        words = len(row["text"].split()) + 1 if row is not None else 0
        if block and (row is None or size + words > ITEM_WORDS):
            indexes = build_indexes(docs.sparkSession, block, docs)
            if indexes:
                yield indexes
            block, size = [], 0
        if row is not None:
            block.append((row["item_id"], row["text"], row["answer"]))
            size += words


def _closed(rows: Iterator) -> Iterator:
    yield from rows
    yield None


def _found(data: np.ndarray, off: np.ndarray, indexes: list[Index]) -> Iterator[tuple[int, int, list[float]]]:
    """(row, item, mean figures) of the items that the rows of a batch hold."""
    for i, j in tv.slices(off, 1 << 19):
        best: dict[tuple[int, int], dict[tuple[int, int], tuple]] = {}
        w = tv.Words(data, off[i : j + 1], tv.LOOSE)
        for k, index in enumerate(indexes):
            for r, q, *figures in _search(w, index):
                seen = best.setdefault((i + r, int(index.item[q])), {})
                seen[k, q] = max(seen.get((k, q), ()), tuple(figures))
        for (r, item), seen in best.items():
            yield r, item, np.mean(list(seen.values()), axis=0).tolist()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, lcs_share, answer_share) for each document and item it holds."""
    docs = doc_texts(docs, id_col, text_col)
    schema = "doc_id long, item_id long, similarity double, lcs_share double, answer_share double"
    found = docs.sparkSession.createDataFrame([], schema)
    for indexes in _indexes(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(batch.column("doc_id")[r].as_py(), item, *figures) for r, item, figures in _found(*_lower(batch.column("text")), shared.value)]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "similarity", "lcs_share", "answer_share"])

        found = found.union(docs.mapInArrow(run, schema))
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns kept. Each block of items filters where the text stands, without a join."""
    text = fresh(docs, "text_to_search")
    left = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    for indexes in _indexes(left.select(F.col(text).alias("text")), benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _, _ in _found(*_lower(batch.column(text)), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        left = left.mapInArrow(run, left.schema)
    return left.drop(text)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, items)
