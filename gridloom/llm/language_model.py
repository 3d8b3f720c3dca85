"""LM scoring with a probabilistic suffix tree.

States are contexts of one to DEPTH words. A context is a candidate if it occurs ``least`` times at
least, a continuation is stored in a state if it occurs there ``floor`` times at least: fixed counts,
so the tree grows with the corpus. Contexts are lengthened by a word a level: only continuations of
candidates are counted, and a level without candidates ends the growth.
A candidate is retained if its next-symbol distribution diverges from that of its suffix: the
Kullback-Leibler divergence over the stored continuations and the rest, times the context's count, must
reach GAIN nats a symbol and half a logarithm of the count for each stored continuation. Suffixes of
retained contexts are retained.

Smoothing: with n(s) the count of a state, n(s, w) its stored counts and R the rest of its count,
P(w | s) = (n(s, w) + (R + MU) * P(w | suffix of s)) / (n(s) + MU); the root is
(c + 0.1) / (N + 0.1 * (V + 1)), unseen words being one symbol. Each distribution sums to one.
A token is scored in the longest retained suffix of its history; a history starts with its document.

The tree is a written table of n-grams by key, a hash of (key of the context, key of the n-gram without its first
word). Logarithms make a score a sum of one term for each n-gram of a document up to DEPTH + 1 words:
``back`` of a retained context, log10((R + MU) / (n(s) + MU)), falls due with each occurrence of it
(a token follows it, as only the end has none), ``gain`` of a stored continuation is what its probability exceeds that sum by. So scoring is one
join by key. The hottest part, shares of HOT of the tokens and more, is broadcast and looked up
in place: it has 1 / HOT n-grams of a length at most, and no key that many rows share is left to the join. N-grams that are in no
table are mostly kept out of shuffles by a bit set of fixed size, which may pass some but drops none that counts.

Null or empty text is one end token. Rows that repeat a doc_id are scored each. Extra columns are ignored.
With no training document N and V are 0 and every token has the root's probability of the unseen, 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import textvec as tv
from gridloom.llm.common import doc_texts, drop, fold_id, materialize

DEPTH, LEAST, FLOOR, MU, GAIN, HALF = 3, 16, 4, 2.0, 0.005, 0.5
HOT = 2.0**-18
SLICES = 4  # of the documents, scored one after the other, so that the shuffle of one goes before the next begins
BITS = 27  # of a bit set's size
END = np.uint64(0xE17D0F5EED0F7E87)
HELD = 1 << 19  # keys a counting task holds before it compacts them
BUCKET = 1 << 20  # tokens for each bucket of n-grams
BLOCK = 1000  # n-grams of a bucket that are one row of a shuffle at most


@dataclass
class Tree:
    """The hot part. word: its words, with their root terms; gram: its n-grams, words included, with their terms; seen: bit set of all n-grams of two words and more."""

    word: tv.Lookup
    root: np.ndarray
    gram: tv.Lookup
    more: np.ndarray
    seen: np.ndarray
    depth: int


def tokens(w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row pointers): each row's words and its end."""
    n = len(w.ptr) - 1
    ptr = w.ptr + np.arange(n + 1)
    out = np.empty(len(w.h) + n, np.uint64)
    out[ptr[1:] - 1] = END
    inside = np.ones(len(out), bool)
    inside[ptr[1:] - 1] = False
    out[inside] = w.h
    return out, ptr


def gram_key(context: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Key of an n-gram from those of its context and of itself without its first word."""
    return tv.mix(context * np.uint64(0x9FB21C651E98DF25) ^ rest)


def gram_keys(h: np.ndarray, ptr: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(token, key, context, rest) of the n-grams of 2 to ``order`` words that end with each token."""
    key, place = h, np.arange(len(h)) - np.repeat(ptr[:-1], np.diff(ptr))
    for k in range(2, order + 1):
        at = np.flatnonzero(place >= k - 1)
        context, rest = key[at - 1], key[at]
        key = key.copy()
        key[at] = gram_key(context, rest)
        yield at, key[at], context, rest


def bit_set(keys: DataFrame) -> np.ndarray:
    """Two bits for each of the keys (key)."""
    mask = (1 << BITS) - 1
    bit = keys.select(F.explode(F.array(F.col("key").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("key", 64 - BITS))).alias("bit"))
    cells = bit.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    if cells.num_rows:
        out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return out


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that are not in the set."""
    out = np.ones(len(keys), bool)
    for at in (keys & np.uint64((1 << BITS) - 1), keys >> np.uint64(64 - BITS)):
        out &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _compact(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Key columns and count of the distinct keys; the first column tells keys apart."""
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.argsort(cols[0])
    key = cols[0][order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return [*(c[order[first]] for c in cols[:-1]), np.add.reduceat(cols[-1][order], first) if len(key) else cols[-1]]


def _blocks(x: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Context, rest and count (key, context, rest, n) in order of their keys, packed by bucket: the first ``bits`` bits of the key. A bucket's rows are a block of BLOCK at most."""
    bucket = (x[0] >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    size = np.diff(np.append(first, len(bucket)))
    n = -(-size // BLOCK)
    start = np.repeat(first, n) + tv.ramp(n) * BLOCK
    off = np.append(start, len(bucket))
    for k in range(0, len(start), 500):
        part = off[k : k + 501]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[part[:-1]].astype(np.int32)), *(tv.blobs(c[part[0] : part[-1]], part - part[0]) for c in x[1:])], ["bucket", "context", "rest", "n"])


def _merged(floor: int):
    """Counts of the n-grams of blocks in order of their buckets, a bucket at a time; those of ``floor`` and more."""
    names = ["context", "rest", "n"]

    def solve(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x = _compact(held)
        often = np.flatnonzero(x[-1] >= floor)
        for k in range(0, len(often), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[often[k : k + 50_000]].view(np.int64)) for c in x], ["key", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], -1
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            edge = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else []
            for a, b in zip(edge[:-1], edge[1:]):
                if bucket[a] != now and held:
                    yield from solve(held)
                    held = []
                now = bucket[a]
                cols = []
                for c in names:
                    data, off = tv.buffers(batch.column(c).slice(a, b - a))
                    cols.append(np.frombuffer(data[off[0] : off[-1]].tobytes(), np.int64 if c == "n" else np.uint64))
                held.append([gram_key(cols[0], cols[1]), *cols])
        if held:
            yield from solve(held)

    return run


def _counted(docs: DataFrame, order: int, known: tuple[np.ndarray, np.ndarray] | None = None, floor: int = 1, total: int = 0) -> DataFrame:
    """(key, n) of the words, or (key, context, rest, n) of the n-grams of ``floor`` occurrences and more whose context and rest may be in the two bit sets ``known``; pre-aggregated in the tasks.

    N-grams go through the shuffle in blocks of a bucket, not as a row each; the buckets grow in number with the ``total`` of tokens, so each is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)
    bits = min(24, max(8, (total // BUCKET).bit_length()))

    def grams(h: np.ndarray, ptr: np.ndarray) -> list[np.ndarray]:
        if order == 1:
            return [h]
        for _, key, context, rest in gram_keys(h, ptr, order):  # the last is the longest
            pass
        contexts, rests = shared.value
        k = np.flatnonzero(maybe(contexts, context))
        k = k[maybe(rests, rest[k])]
        return [key[k], context[k], rest[k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if order > 1:
                yield from _blocks(x, bits)
                return
            for k in range(0, len(x[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000].view(np.int64)) for c in x], ["key", "n"])

        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            for i, j in tv.slices(off):
                g = grams(*tokens(tv.Words(data, off[i : j + 1])))
                held.append(_compact([[*g, np.ones(len(g[0]), np.int64)]]))
                size += len(held[-1][0])
                if size > 2 * HELD:
                    held = [_compact(held)]
                    size = len(held[0][0])
                    if size > HELD:
                        yield from out(held[0])
                        held, size = [], 0
        if held:
            yield from out(_compact(held))

    if order == 1:
        return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    blocks = docs.mapInArrow(run, "bucket int, context binary, rest binary, n binary")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_merged(floor), "key long, context long, rest long, n long")


def _diverging(rows: DataFrame) -> DataFrame:
    """(context, c, left, keep): each state of the stored continuations (context, c, n, q), the rest of its count and whether it passes the divergence test."""
    sums = rows.groupBy("context").agg(
        F.first("c").alias("c"), F.sum("n").alias("stored"), F.sum("q").alias("covered"), F.count("*").alias("k"), F.sum(F.col("n") * F.log(F.col("n") / F.col("c") / F.col("q"))).alias("gain")
    )
    left = F.col("c") - F.col("stored")
    gain = F.col("gain") + F.when(left > 0, left * F.log(left / F.col("c") / F.greatest(1 - F.col("covered"), F.lit(1e-9)))).otherwise(0.0)
    keep = (gain >= GAIN * F.col("c")) & (gain >= HALF * F.col("k") * F.log(F.greatest(F.col("c"), F.lit(2))))
    return sums.select("context", F.col("c"), left.alias("left"), keep.alias("keep"))


def grow(training: DataFrame, words: DataFrame, floor: int, least: int, depth: int, total: int = 0) -> list[tuple[DataFrame, DataFrame]]:
    """(continuations (key, context, rest, n, q, p), states (context, c, left, keep)) of each level; q: probability in the suffix, p: in the state."""
    levels = []
    shorter = words.select("key", "n", "p")
    for order in range(2, depth + 2):
        contexts = shorter.filter(F.col("n") >= least).select(F.col("key").alias("context"), F.col("n").alias("c"))
        bits = bit_set(contexts.select(F.col("context").alias("key")))
        if not bits.any():
            break
        # an n-gram is no more frequent than what is left of it without its first word
        rests = bit_set(shorter.filter(F.col("n") >= floor).select("key"))
        counted = materialize(_counted(training, order, (bits, rests), floor, total), "counted")
        rows = counted.join(shorter.select(F.col("key").alias("rest"), F.col("p").alias("q")).hint("merge"), "rest").join(contexts.hint("merge"), "context")
        rows = materialize(rows.select("key", "context", "rest", "n", "q", "c"), "rows")
        states = materialize(_diverging(rows), "states")
        p = (F.col("n") + (F.col("left") + MU) * F.col("q")) / (F.col("c") + MU)
        grams = materialize(rows.drop("c").join(states.hint("merge"), "context").select("key", "context", "rest", "n", "q", p.alias("p")), "level")
        drop(counted, rows)
        levels.append((grams, states))
        shorter = grams.select("key", "n", "p")
    return levels


def learn(training: DataFrame, floor: int = FLOOR, least: int = LEAST, depth: int = DEPTH, hot: float = HOT) -> tuple[Tree, DataFrame, int, int]:
    """(hot tree, table (key, root, more) of what is not in it, N, V) from the texts of ``training``; root is null but for words."""
    words = materialize(_counted(training, 1), "words")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = words.withColumn("p", (F.col("n") + 0.1) / F.lit(total + 0.1 * (kinds + 1)))
    levels = grow(training, words, floor, least, depth, total)
    back = F.log10((F.col("left") + MU) / (F.col("c") + MU))
    nothing = F.lit(None).cast("double")
    parts = [words.select("key", "n", F.log10("p").alias("root"), F.log10("p").alias("more"))]
    forced = None
    for k in reversed(range(len(levels))):
        grams, states = levels[k]
        if forced is not None:
            states = states.join(forced.hint("merge"), "context", "left").withColumn("keep", F.col("keep") | F.coalesce("forced", F.lit(False)))
        kept = materialize(states.filter("keep").select("context", "c", back.alias("back")), "kept")
        parts.append(kept.select(F.col("context").alias("key"), F.col("c").alias("n"), nothing.alias("root"), F.col("back").alias("more")))
        gain = F.log10("p") - F.col("back") - F.log10("q")
        parts.append(grams.join(kept.hint("merge"), "context").select("key", "n", nothing.alias("root"), gain.alias("more")))
        if k:
            shorter = levels[k - 1][0].select(F.col("key").alias("context"), "rest")
            forced = kept.join(shorter.hint("merge"), "context").select(F.col("rest").alias("context")).distinct().withColumn("forced", F.lit(True))
    table = parts[0]
    for x in parts[1:]:
        table = table.unionByName(x)
    table = materialize(table.groupBy("key").agg(F.max("n").alias("n"), F.max("root").alias("root"), F.sum("more").alias("more")), "table")
    drop(words, *(x for level in levels for x in level))
    hottest = table.filter(F.col("n") >= max(1.0, hot * total)).select("key", "root", "more").toArrow()
    key = hottest.column("key").to_numpy().view(np.uint64) if hottest.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(key)
    root, more = (hottest.column(c).to_numpy()[order].astype(np.float64) if len(key) else np.zeros(0) for c in ("root", "more"))
    key, is_word = key[order], ~np.isnan(root)
    seen = bit_set(table.filter("root IS NULL").select("key"))
    tree = Tree(tv.Lookup(key[is_word]), root[is_word], tv.Lookup(key), more, seen, len(levels))
    return tree, table.filter(F.col("n") < max(1.0, hot * total)).select("key", "root", "more"), total, kinds


def _terms(h: np.ndarray, ptr: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word ids, root part, score part) of the tokens in log10 as far as the hot tree has them; (token, key) of the n-grams that the table may hold."""
    w = tree.word.find(h)
    root = np.where(w >= 0, tree.root[w], 0.0) if len(tree.root) else np.zeros(len(h))
    full = np.zeros(len(h))
    where, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for order, (at, key) in enumerate(((np.arange(len(h)), h), *((a, k) for a, k, _, _ in gram_keys(h, ptr, tree.depth + 1)))):
        if order:
            k = np.flatnonzero(maybe(tree.seen, key))
            at, key = at[k], key[k]
        k = tree.gram.find(key)
        hit = np.flatnonzero(k >= 0)
        full[at[hit]] += tree.more[k[hit]]
        if order:
            miss = np.flatnonzero(k < 0)
            where.append(at[miss])
            keys.append(key[miss])
    return w, root, full, np.concatenate(where), np.concatenate(keys)


def _lists(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, how often) of the distinct keys of each row."""
    order = np.lexsort((key, row))
    r, x = row[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])])) if len(r) else np.zeros(0, int)
    return r[first], x[first], np.diff(np.append(first, len(r)))


#: Kinds of the rows of a scoring pass: n-grams, words, the row's id with base sum and tokens, its score sum and known tokens, a row without id
GRAM, WORD, BASE, SUM, NO_ID = range(5)


def score(docs: DataFrame, tree: Tree, table: DataFrame, total: int, kinds: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (row, doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            row_id, doc_id = batch.column("row").to_numpy(), batch.column("doc_id")
            for i, j in tv.slices(off):
                h, ptr = tokens(tv.Words(data, off[i : j + 1]))
                w, root, full, at, key = _terms(h, ptr, t)
                row, mine, ids = np.repeat(np.arange(j - i), np.diff(ptr)), row_id[i:j], doc_id.slice(i, j - i)
                rare = np.flatnonzero(w < 0)
                known = np.diff(ptr) - np.bincount(row[rare], minlength=j - i)
                lists = [_lists(row[rare], h[rare]), _lists(row[at], key)]
                no_id = ids.is_null().to_numpy(zero_copy_only=False)
                own = np.where(no_id, mine, ids.fill_null(0).to_numpy())
                rows = [mine[r] for r, _, _ in lists] + [mine, mine]
                keys = [k.view(np.int64) for _, k, _ in lists] + [own, mine]
                tf = [n for _, _, n in lists] + [np.diff(ptr), known]
                kind = [np.full(len(lists[0][0]), WORD), np.full(len(lists[1][0]), GRAM), np.where(no_id, NO_ID, BASE), np.full(j - i, SUM)]
                value = [np.zeros(len(lists[0][0]) + len(lists[1][0])), tv.row_sums(root, ptr), tv.row_sums(full, ptr)]
                cols = [np.concatenate(rows), np.concatenate(keys), np.concatenate(tf).astype(np.int32), np.concatenate(kind).astype(np.int8), np.concatenate(value)]
                for k in range(0, len(cols[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in cols], ["row", "key", "tf", "kind", "value"])

    parts = docs.mapInArrow(run, "row long, key long, tf int, kind byte, value double")
    kind, unseen = F.col("kind"), F.log10(F.lit(0.1) / F.lit(total + 0.1 * (kinds + 1)))
    about, gram, word = kind.isin(BASE, NO_ID), kind == GRAM, kind == WORD
    found = parts.join(table.hint("shuffle_hash"), "key", "left").groupBy("row").agg(
        F.max(F.when(kind == BASE, F.col("key"))).alias("doc_id"),
        F.sum(F.when(about, F.col("tf")).otherwise(0)).alias("n_tokens"),
        F.sum(F.when((kind == SUM) | word & F.col("root").isNotNull(), F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.when(about, F.col("value")).when(word, F.col("tf") * F.coalesce("root", unseen)).otherwise(0.0)).alias("base_score"),
        F.sum(F.when(kind == SUM, F.col("value")).when(word, F.col("tf") * F.when(F.col("root").isNull(), unseen).otherwise(F.col("more"))).when(gram, F.col("tf") * F.coalesce("more", F.lit(0.0))).otherwise(0.0)).alias("score"),
    )
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out():
    """Whether the model doesn't learn from a document; one without doc_id is learnt from."""
    return F.coalesce(fold_id(F.col("doc_id")) % 10 == 0, F.lit(False))


def score_sliced(docs: DataFrame, tree: Tree, table: DataFrame, total: int, kinds: int) -> DataFrame:
    """``score`` of docs (doc_id, text), written slice by slice."""
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    parts = [materialize(score(rows.filter(F.pmod(F.xxhash64("row"), F.lit(SLICES)) == k), tree, table, total, kinds), "scores") for k in range(SLICES)]
    return reduce(DataFrame.unionByName, parts)


def op6(spark: SparkSession, sf_dir: str, **how: float) -> DataFrame:
    """Base and suffix-tree scores of every document."""
    docs = doc_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    tree, table, total, kinds = learn(docs.filter(~held_out()).select("text"), **how)
    return score_sliced(docs, tree, table, total, kinds)
