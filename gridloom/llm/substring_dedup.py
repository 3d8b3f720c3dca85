"""Suffix-array dedup: remove every byte covered by a ``length``-byte string that also starts anywhere else.

Two kinds of windows are judged: strings of ``length`` bytes, and strings of ``words`` words (split at
white space) that are shorter than that. ``words`` = 0 leaves the second kind out.

1. Anchors. A window's anchor is the ``GRAM``-byte string with the least hash (leftmost at a tie) among
   those in it that start a word after its first byte; in a window of bytes without one, among all:
   equal windows have equal anchors at the same place. The windows that share
   one anchor follow each other; the bytes they cover are the anchor's context.
2. An anchor that occurs once has no equal window anywhere and goes. Equal contexts are one string
   with a weight: a hot passage is one row however often it occurs. If its weight is over one all its
   windows repeat.
3. The different contexts of an anchor meet in one shard. A task fills shards with whole anchors, up to
   SHARD_BYTES each, so what it holds is bounded whatever the hash deals to it. A shard's contexts are concatenated and
   sorted by external induced sorting (``suffix``): windows repeat whose neighbours in suffix order share
   them whole. No window is lost: equal windows have one anchor, so one shard. An anchor with over
   SPLIT_BYTES of different contexts is split: its windows are dealt by their hash and counted.
4. Repeated windows go back to every document that has the context, are merged to spans and cut out.

Strings are judged on the input, overlaps and repeats within a document count, matches never cross
documents. Null text is empty; a text under ``length`` bytes and ``words`` words is kept whole. Rows are told apart by
doc_id and text, a null doc_id being a value like others; rows that repeat both are copies of each other. Extra columns are
kept by ``dedup`` and ignored by the digests. A kept text that is cut inside a UTF-8 character loses the broken rest of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import textvec as tv
from gridloom.llm.common import drop, fresh, materialize, small_batches
from gridloom.llm.suffix import scratch, suffixes

LENGTH, WORDS, GRAM = 400, 51, 96
SHARD_BYTES, SPLIT_BYTES = 4 << 20, 1 << 20  # of a shard at most; of an anchor's different contexts beyond which it is split
PIECE = 1 << 23  # windows of one text that are anchored at once
MEMORY = 1 << 22  # suffixes that the sorter of a shard holds; more go to disk
_POS = np.uint64(28)
_NEVER = np.iinfo(np.uint64).max
_NONE = 1023  # of ten bits: no such window
KEYS = ["k1", "k2"]
CODE = 6  # letters of a word's code
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
#: symbols of the bytes: white space first, so that windows of the same words are neighbours; 0 stands between contexts
_SYMBOL = np.empty(256, np.uint16)
_SYMBOL[np.argsort(~tv.SPACE, kind="stable")] = np.arange(1, 257)


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring keys."""
    n = len(key)
    rows = -(-n // w)
    x = np.full(rows * w, _NEVER, np.uint64)
    x[:n] = key
    x = x.reshape(rows, w)
    before = np.minimum.accumulate(x, axis=1).reshape(-1)
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def _least_between(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each key[a..b], both included."""
    out, level, span = np.full(len(a), _NEVER, np.uint64), key, 1
    size = b - a + 1
    while len(a) and span <= size.max():
        now = (size >= span) & (size < 2 * span)
        out[now] = np.minimum(level[a[now]], level[b[now] - span + 1])
        level, span = np.minimum(level[:-span], level[span:]) if len(level) > span else level, 2 * span
    return out


def _runs(best: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbouring windows of one row with one anchor."""
    if not len(at):
        return at, at
    cut = np.flatnonzero((best[1:] != best[:-1]) | (row[1:] != row[:-1])) + 1
    return np.concatenate([[0], cut]), np.append(cut - 1, len(at) - 1)


class Anchored:
    """The anchors of a slice of rows: row, anchor and context hashes, and by the context's first byte ``lo`` in
    the row its shape: size, first and last byte window, first and last word window and the end of that."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int, words: int, gram: int, by_bytes: bool = True, piece: int = 0, torn: tuple[bool, bool] = (False, False)):
        """by_bytes: whether byte windows count; piece: only windows that start before it count, if it isn't 0; torn: whether the slice begins and ends inside a word."""
        w = tv.Words(data, off)
        raw, n = w.raw, len(w.raw)
        begin, stop = w.off[:-1], w.off[1:]
        sums = tv.prefix_hash(raw)
        owner = w.row_of()
        can = (w.start > begin[owner]) & (w.start + gram <= stop[owner])
        key = np.full(n + 1, _NEVER, np.uint64)
        spot = w.start[can]
        key[spot] = tv.range_hash(sums, spot, spot + gram) >> _POS << _POS | spot.astype(np.uint64)
        low = np.uint64((1 << 28) - 1)

        row_of = np.repeat(np.arange(len(begin)), stop - begin)
        at = np.arange(max(0, n - length + 1) if by_bytes else 0)
        at = at[at + length <= stop[row_of[: len(at)]]]
        best = _least(key[1:], length - gram)[at] if len(at) else np.zeros(0, np.uint64)
        bare = np.flatnonzero(best == _NEVER)
        if len(bare):
            every = np.arange(n - gram + 1)
            every = tv.range_hash(sums, every, every + gram) >> _POS << _POS | every.astype(np.uint64)
            best[bare] = _least(every, length - gram + 1)[at[bare]]
        p1, r1 = (best & low).astype(np.int64), row_of[at]
        a1, b1 = _runs(p1, r1, at)
        p1, r1, a1, b1 = p1[a1], r1[a1], at[a1], at[b1]

        first = np.zeros(0, np.int64)
        if words and len(w.start) >= words:
            first = np.arange(len(w.start) - words + 1)
            last = first + words - 1
            whole = (w.end[last] < n) | (not torn[1]) if piece else True
            whole &= (w.start[first] < piece) & ((w.start[first] > 0) | (not torn[0])) if piece else True
            first = first[(owner[first] == owner[last]) & (w.end[last] - w.start[first] < length) & whole]
        end = w.end[first + words - 1]
        reach = np.searchsorted(w.start, end - gram, "right") - 1
        p2, r2 = (_least_between(key[w.start], first + 1, reach) & low).astype(np.int64), owner[first]
        a2, b2 = _runs(p2, r2, first)
        p2, r2, a2, b2, e2 = p2[a2], r2[a2], w.start[first[a2]], w.start[first[b2]], end[b2]

        # a run of byte windows and one of word windows with the same anchor make one context
        twin = np.full(len(p1), -1)
        if len(p1) and len(p2):
            order = np.argsort(p1, kind="stable")
            k = order[np.minimum(np.searchsorted(p1[order], p2), len(p1) - 1)]
            same = np.flatnonzero((p1[k] == p2) & (r1[k] == r2))
            same = same[np.unique(k[same], return_index=True)[1]]
            twin[k[same]] = same
        single = np.setdiff1d(np.arange(len(p2)), twin)
        has2 = twin >= 0
        t = np.where(has2, twin, 0)
        far = np.iinfo(np.int64).max

        def both(one: np.ndarray, two: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
            pad = np.full(len(single), none)
            return np.concatenate([one, pad]), np.concatenate([np.where(has2, two[t], none) if len(two) else np.full(len(one), none), two[single]])

        p = np.concatenate([p1, p2[single]])
        self.row = np.concatenate([r1, r2[single]])
        a1, a2 = both(a1, a2, far)
        b1, b2 = both(b1, b2, -1)
        _, e2 = both(p1, e2, -1)
        lo = np.minimum(a1, a2)
        size = np.maximum(np.where(b1 >= 0, b1 + length, -1), e2) - lo
        parts = [size, *(np.where(x >= 0, x - lo, _NONE) for x in (np.where(b1 >= 0, a1, -1), b1, np.where(b2 >= 0, a2, -1), b2, e2))]
        self.shape = sum(x.astype(np.int64) << 10 * i for i, x in enumerate(parts)) if len(lo) else np.zeros(0, np.int64)
        self.anchor = tv.range_hash(sums, p, p + gram) if len(p) else np.zeros(0, np.uint64)
        self.context = tv.mix(tv.range_hash(sums, lo, lo + size) ^ tv.mix(self.shape.view(np.uint64))) if len(p) else np.zeros(0, np.uint64)
        self.lo = lo - begin[self.row]


def _pieces(data: np.ndarray, off: np.ndarray, length: int, words: int, gram: int, by_bytes: bool, piece: int = PIECE) -> Iterator[tuple[int, int, Anchored]]:
    """(first row, first byte in it, anchors) of slices; a row of more than ``piece`` bytes is read in overlapping pieces.

    The overlap is one byte less than a window of bytes, and word windows are shorter, so each window lies in one piece.
    """
    for i, j in tv.slices(off):
        if j > i + 1 or off[j] - off[i] <= piece + length:
            yield i, 0, Anchored(data, off[i : j + 1], length, words, gram, by_bytes)
            continue
        for s in range(0, int(off[j] - off[i]), piece):
            a, b = int(off[i]) + s, min(int(off[j]), int(off[i]) + s + piece + length - 1)
            torn = [x > off[i] and x < off[j] and not tv.SPACE[data[x - 1]] and not tv.SPACE[data[x]] for x in (a, b)]
            yield i, s, Anchored(data, np.array([a, b]), length, words, gram, by_bytes, piece, (bool(torn[0]), bool(torn[1])))


def _occurrences(texts: DataFrame, length: int, words: int, gram: int, by_bytes: bool) -> DataFrame:
    """(k1, k2, anchor, context, lo, shape) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            keys = [batch.column(k).to_numpy() for k in KEYS]
            for i, s, x in _pieces(data, off, length, words, gram, by_bytes):
                if len(x.row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k[i + x.row]) for k in keys] + [pa.array(x.anchor.view(np.int64)), pa.array(x.context.view(np.int64)), pa.array((x.lo + s).astype(np.int32)), pa.array(x.shape)],
                        [*KEYS, "anchor", "context", "lo", "shape"],
                    )

    return texts.mapInArrow(run, "k1 long, k2 long, anchor long, context long, lo int, shape long")


def _field(shape: str, i: int) -> Column:
    return F.shiftright(shape, 10 * i).bitwiseAND(F.lit(1023)).cast("int")


def word_windows(raw: np.ndarray, base: np.ndarray, shape: np.ndarray, length: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the word windows of contexts that stand in ``raw`` from ``base`` on, apart from each other by white space."""
    first, last = (shape >> 30 & 1023), (shape >> 40 & 1023)
    has = first != _NONE
    gap = tv.SPACE[raw]
    word = ~gap
    start = np.flatnonzero(word & np.concatenate([[True], gap[:-1]]))
    end = np.flatnonzero(word & np.concatenate([gap[1:], [True]])) + 1
    if len(start) < words or not has.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.arange(len(start) - words + 1)
    size = end[k + words - 1] - start[k]
    owner = np.searchsorted(base, start[k], "right") - 1
    inside = start[k] - base[owner]
    k = k[has[owner] & (inside >= first[owner]) & (inside <= last[owner]) & (size < length)]
    return start[k], size[k]


def repeated(contexts: list[bytes], shape: np.ndarray, heavy: np.ndarray, length: int, words: int, memory: int = MEMORY) -> list[tuple[list[int], list[int]]]:
    """For each context the bytes [a, b, a, b, ...] that its repeated byte windows and its repeated word windows cover; heavy: contexts that occur more than once."""
    size = np.array([len(x) for x in contexts])
    base = np.cumsum(size + 1) - size
    raw = scratch(int(base[-1] + size[-1] + 1), np.uint8, memory)
    raw[:] = np.frombuffer(b" " + b" ".join(contexts) + b" ", np.uint8)
    a1, b1 = (shape >> 10 & 1023), (shape >> 20 & 1023)
    steps = np.zeros(len(raw) + 1, np.int8)
    has = a1 != _NONE
    steps[base[has] + a1[has]] += 1
    steps[base[has] + b1[has] + 1] -= 1
    whole = np.cumsum(steps[:-1], dtype=np.int8) > 0  # starts of byte windows
    at, span = word_windows(raw, base, shape, length, words)
    least = np.zeros(len(raw), np.int16)
    least[at] = span
    hit1, hit2 = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    text = scratch(len(raw), np.uint16, memory)
    text[:] = _SYMBOL[raw]
    text[base - 1], text[-1] = 0, 0
    held = [(-1, length), (-1, length)]  # the last window of each kind, and what is shared since
    for pos, shared in suffixes(text, length, memory):
        shared = np.append(shared, length)
        for kind, flags, hit in ((0, whole, hit1), (1, least > 0, hit2)):
            k = np.flatnonzero(flags[np.minimum(pos, len(raw) - 1)] & (pos < len(raw)))
            old, carry = held[kind]
            if not len(k):
                held[kind] = old, min(carry, int(shared.min()))
                continue
            low = np.minimum.reduceat(shared, np.concatenate([[0], k + 1]))
            low[0] = min(low[0], carry)
            here, before = pos[k], np.concatenate([[old], pos[k[:-1]]])
            ok = (low[:-1] >= length if kind == 0 else (low[:-1] >= least[here]) & (least[here] == least[before])) & (before >= 0)
            hit[here[ok]] = True
            hit[before[ok]] = True
            held[kind] = int(here[-1]), int(low[-1])
    out = []
    cut = np.searchsorted(at, np.append(base, len(raw)))
    for i, (b, n) in enumerate(zip(base.tolist(), size.tolist(), strict=True)):
        flags = whole[b : b + n] if heavy[i] else hit1[b : b + n]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
        edge[1::2] += length - 1
        k = np.arange(cut[i], cut[i + 1])
        k = k if heavy[i] else k[hit2[at[k]]]
        pairs = np.stack([at[k] - b, at[k] - b + span[k]], 1).reshape(-1)
        out.append((edge.tolist(), pairs.tolist()))
    return out


FOUND = "anchor long, context long, bytes_runs array<int>, words_runs array<int>"


def _sort_shards(rows: DataFrame, length: int, words: int, memory: int, shard_bytes: int) -> DataFrame:
    """(anchor, context, runs) of contexts (anchor, context, weight, shape, bytes) sorted by anchor."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        runs = repeated(t.column("bytes").to_pylist(), t.column("shape").to_numpy(), t.column("weight").to_numpy() > 1, length, words, memory)
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([t.column("anchor").combine_chunks(), t.column("context").combine_chunks(), pa.array([x for x, _ in runs], kind), pa.array([x for _, x in runs], kind)], ["anchor", "context", "bytes_runs", "words_runs"])

    return rows.mapInArrow(_by_shard(solve, shard_bytes), FOUND)


def _by_shard(solve: Callable[[pa.Table], pa.RecordBatch], shard_bytes: int) -> Callable:
    """``solve`` of shards: anchors that follow each other, as many as ``shard_bytes`` hold, one at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full: list[pa.RecordBatch] = []  # whole anchors
        last: list[pa.RecordBatch] = []  # the anchor that may go on in the next batch
        full_size = last_size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            starts = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), batch.num_rows]
            sums = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy())])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if last and (a or last[0].column("anchor")[0].as_py() != anchor[0]):
                    if full and full_size + last_size > shard_bytes:
                        yield solve(pa.Table.from_batches(full))
                        full, full_size = [], 0
                    full.extend(last)
                    full_size, last, last_size = full_size + last_size, [], 0
                last.append(batch.slice(a, b - a))
                last_size += int(sums[b] - sums[a])
        if full and full_size + last_size > shard_bytes:
            yield solve(pa.Table.from_batches(full))
            full = []
        if full or last:
            yield solve(pa.Table.from_batches(full + last))

    return run


def _split_windows(rows: DataFrame, length: int, words: int) -> DataFrame:
    """(anchor, context, start, size, window, weight) of every window of the contexts (anchor, context, weight, shape, bytes); window: 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts, shape = part.column("bytes").to_pylist(), part.column("shape").to_numpy()
                size = np.array([len(x) for x in texts])
                base = np.cumsum(size + 1) - size
                raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
                a1, b1 = (shape >> 10 & 1023), (shape >> 20 & 1023)
                n = np.where(a1 != _NONE, b1 - a1 + 1, 0)
                one = np.repeat(base + a1, n) + tv.ramp(n)
                two, span = word_windows(raw, base, shape, length, words)
                at, span = np.concatenate([one, two]), np.concatenate([np.full(len(one), length), span])
                owner = np.searchsorted(base, at, "right") - 1
                c, flip = tv.prefix_hash(raw), tv.prefix_hash(tv.mix(raw.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(k).take(pa.array(owner)) for k in ("anchor", "context", "weight")]
                    + [pa.array((at - base[owner]).astype(np.int32)), pa.array(span.astype(np.int32)), pa.array(tv.range_hash(c, at, at + span).view(np.int64)), pa.array(tv.range_hash(flip, at, at + span).view(np.int64))],
                    ["anchor", "context", "weight", "start", "size", "w1", "w2"],
                )

    return rows.mapInArrow(run, "anchor long, context long, weight long, start int, size int, w1 long, w2 long")


def _split_anchors(rows: DataFrame, length: int, words: int) -> DataFrame:
    """FOUND of the contexts of anchors with too many: their windows are dealt by hash and counted."""
    windows = materialize(_split_windows(rows, length, words), "windows")
    often = materialize(windows.groupBy("w1", "w2", "size").agg(F.sum("weight").alias("n")).filter("n > 1").select("w1", "w2", "size"), "often")
    # the two runs of a byte and a word window are told apart by size alone
    again = windows.join(often.hint("merge"), ["w1", "w2", "size"])
    pair = F.array("start", F.col("start") + F.col("size"))
    return again.groupBy("anchor", "context").agg(
        F.flatten(F.collect_list(F.when(F.col("size") == length, pair))).alias("bytes_runs"), F.flatten(F.collect_list(F.when(F.col("size") < length, pair))).alias("words_runs")
    )


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """k1, k2 of a row: its doc_id and a hash of the text and of whether the doc_id is null."""
    key = F.col(id_col).cast("long")
    return [F.coalesce(key, F.lit(0).cast("long")).alias("k1"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")), key.isNull()).alias("k2")]


def spans(docs: DataFrame, length: int = LENGTH, words: int = 0, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY, by_bytes: bool = True) -> DataFrame:
    """(k1, k2, cover, word_cover): for each row (k1, k2, text) or (doc_id, text) with repeated strings the bytes [a, b, a, b, ...] that byte windows and word windows cover, not yet merged; by_bytes: whether there are byte windows."""
    if not gram < length < 512 or words and by_bytes and gram > 2 * words - 3:
        raise ValueError("gram must be under length, length under 512, and 2 * words - 3 must reach gram")
    small_batches(docs.sparkSession)
    texts = docs.select(*(KEYS if docs.columns == [*KEYS, "text"] else keyed(docs)), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    occ = materialize(_occurrences(texts, length, words, gram, by_bytes), "anchors")
    often = materialize(occ.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "often")
    hot = materialize(occ.join(often.hint("merge"), "anchor", "left_semi"), "hot")
    drop(occ, often)
    distinct = hot.groupBy("anchor", "context").agg(F.min(F.struct("k1", "k2", "lo", "shape")).alias("at"), F.count("*").alias("weight"))
    distinct = materialize(distinct.select("anchor", "context", "weight", "at.*"), "contexts")
    several = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("m"), F.sum(_field("shape", 0).cast("long")).alias("held")).filter("m > 1").select("anchor", "held"), "several")
    total, most = several.agg(F.sum("held"), F.max("held")).first()
    tasks, split = max(1, -(-(total or 0) // shard_bytes)), min(SPLIT_BYTES, shard_bytes)
    mixed = distinct.join(several.hint("merge"), "anchor")
    placed = mixed.withColumn("size", _field("shape", 0))
    own = texts.dropDuplicates(KEYS)
    cut = placed.join(own.hint("merge"), KEYS).select("anchor", "context", "weight", "shape", "held", F.expr("substring(cast(text AS binary), lo + 1, size)").alias("bytes"))
    if (most or 0) > split:
        cut = materialize(cut, "cut")
    found = _sort_shards(cut.filter(F.col("held") <= split).repartition(int(min(tasks, 20000)), "anchor").sortWithinPartitions("anchor"), length, words, memory, shard_bytes).filter("size(bytes_runs) + size(words_runs) > 0")
    if (most or 0) > split:
        found = found.unionByName(_split_anchors(cut.filter(F.col("held") > split), length, words))
    alone = distinct.filter("weight > 1").join(several.hint("merge"), "anchor", "left_anti")

    def pair(a: int, b: int, more: int) -> Column:
        return F.when(_field("shape", a) != _NONE, F.array(_field("shape", a), _field("shape", b) + more)).otherwise(F.array().cast("array<int>"))

    found = found.unionByName(alone.select("anchor", "context", pair(1, 2, length).alias("bytes_runs"), pair(3, 5, 0).alias("words_runs")))
    found = materialize(found, "found")
    drop(distinct, several)
    back = hot.join(found.hint("merge"), ["anchor", "context"]).select(*KEYS, *(F.transform(c, lambda x: x + F.col("lo")).alias(c) for c in ("bytes_runs", "words_runs")))
    out = materialize(back.groupBy(*KEYS).agg(F.flatten(F.collect_list("bytes_runs")).alias("cover"), F.flatten(F.collect_list("words_runs")).alias("word_cover")), "cover")
    drop(hot, found)
    return out


def covered(n: int, *covers: np.ndarray) -> np.ndarray:
    """Which of n bytes the runs [a, b, a, b, ...] cover."""
    step = np.zeros(n + 1, np.int32)
    for c in covers:
        np.add.at(step, c[::2], 1)
        np.add.at(step, c[1::2], -1)
    return np.cumsum(step)[:n] > 0


def edges(flags: np.ndarray) -> np.ndarray:
    """[a, b, a, b, ...] of the runs of True."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))


def _covers(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    return [batch.column(c)[i].values.to_numpy() for c in ("cover", "word_cover")]


def op2(spark: SparkSession, sf_dir: str, length: int = LENGTH, **how: int) -> DataFrame:
    """What is removed from every document and the digest of what is left; n_passage_bytes: bytes of repeated strings of ``length`` bytes or of 51 words, removed or not."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = spans(docs, length, WORDS, **how)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keyed(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            out = []
            for i in range(batch.num_rows):
                raw = data[off[i] : off[i + 1]]
                away = passage = np.zeros(0, bool)
                if batch.column("cover")[i].is_valid:
                    cover, by_words = _covers(batch, i)
                    away = covered(len(raw), cover)
                    passage = covered(len(raw), cover, by_words)
                kept = raw[~away] if len(away) else raw
                out.append((len(raw), len(raw) - len(kept), len(edges(away)) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), int(passage.sum())))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"])

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long"
    return rows.join(found.hint("merge"), KEYS, "left").select("doc_id", "text", "cover", "word_cover").mapInArrow(run, kind)


def _cut(docs: DataFrame, found: DataFrame, away: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``docs`` without the bytes that ``away(bytes, cover, word_cover)`` marks; all columns and rows kept, a null text stays null."""
    k1, k2, cover, by_words = (fresh(docs, c) for c in ("span_k1", "span_k2", "span_cover", "span_words"))
    found, names = found.withColumnsRenamed({"k1": k1, "k2": k2, "cover": cover, "word_cover": by_words}), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            texts = []
            for i, (one, two, old) in enumerate(zip(batch.column(cover), batch.column(by_words), batch.column("text"), strict=True)):
                if not one.is_valid or not old.is_valid:
                    texts.append(old.as_py())
                else:
                    raw = data[off[i] : off[i + 1]]
                    texts.append(raw[~away(raw, one.values.to_numpy(), two.values.to_numpy())].tobytes().decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    a, b = keyed(docs)
    rows = docs.withColumns({k1: a, k2: b})
    return rows.join(found.hint("merge"), [k1, k2], "left").select(*names, cover, by_words).mapInArrow(run, docs.schema)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **how: int) -> DataFrame:
    """``docs`` with repeated strings of ``length`` bytes cut out of the text."""
    return _cut(docs, spans(docs, length, 0, gram, **how), lambda raw, cover, _: covered(len(raw), cover))


def word_codes(data: np.ndarray, off: np.ndarray) -> tuple[tv.Words, np.ndarray]:
    """(words, CODE letters and a space for each): letters stand for 6 bits each of a word's hash, capitals told apart."""
    w = tv.Words(data, off)
    h = tv.string_hash(w.raw, w.start, w.end)
    code = _LETTERS[(h[:, None] >> (np.arange(CODE, dtype=np.uint64) * np.uint64(6)) & np.uint64(63)).astype(np.int64)]
    return w, np.concatenate([code, np.full((len(h), 1), 32, np.uint8)], axis=1)


def dedup_words(docs: DataFrame, words: int = WORDS, gram: int = 14, **how: int) -> DataFrame:
    """``docs`` without the repeated passages of ``words`` words (split at white space) and more, whatever their bytes; ``gram``: words of an anchor.

    The texts go through ``spans`` as codes of one width for each word. What stands between the words of a passage goes with it.
    """
    width = CODE + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            for i, j in tv.slices(off):
                w, codes = word_codes(data, off[i : j + 1])
                flat, ends = codes.tobytes(), (w.ptr * width).tolist()
                texts = [flat[a:b].decode("ascii") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in KEYS), pa.array(texts, pa.string())], [*KEYS, "text"])

    def away(raw: np.ndarray, _: np.ndarray, cover: np.ndarray) -> np.ndarray:
        w = tv.Words(raw, np.array([0, len(raw)]))
        return covered(len(raw), np.stack([w.start[cover[::2] // width], w.end[(cover[1::2] - 1) // width]], 1).reshape(-1))

    texts = docs.select(*keyed(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    codes = materialize(texts.mapInArrow(encode, "k1 long, k2 long, text string"), "codes")
    return _cut(docs, spans(codes, words * width, words, gram * width - 1, by_bytes=False, **how), away)
