"""MinHash near-dedup by a signature-coordinate inverted join.

Each distinct shingle set gets a signature of ``M`` coordinates. Sets are posted under their
(coordinate, value) pairs; pairs that one set alone has are skipped. Two sets that agree in
``MATCHES`` coordinates share at least one of the M - MATCHES + 1 rarest pairs of either, so a
set is posted under that prefix of its pairs only, rarest first: the long lists of common
passages are skipped unless a set consists of them. Collisions are then counted over the whole
signatures, pairs at or above ``MATCHES`` are confirmed on the full sets, and components follow.

Lists are never expanded into all pairs. First every member is paired with its list's smallest
member; members that a confirmed link puts in one component need no further pair, so only
members of different components of one list are compared in a second round. That round works in
blocks of a list inside a task and gives out only pairs that may still be links: agreeing
coordinates, sizes, and an upper bound of the overlap from bitmaps of the sets (a bit that one
set has and the other has not is an element that they don't share, so no link is lost).

With similarity s the number of agreeing coordinates is binomial(M, s): at s = 0.8 and 36 of 64 a
link between two sets goes unseen with a chance of about 4e-6, at 0.9 below 1e-13.

Null or empty text has an empty set, is linked with nothing and is its own component. Equal
sets are one class with a number of its own; a component's id is the smallest doc_id of its rows. Rows are told apart
by doc_id and text: those that share a doc_id but not the text are documents of their own. A null doc_id is never
the smallest; a component of such rows alone has a null id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import textvec as tv
from gridloom.llm.common import doc_texts, drop, fresh, materialize
from gridloom.llm.graph import components

M, MATCHES = 64, 36
BITS, BLOCK = 4096, 1024  # of a set's bitmap; members of a block of a list
SALTS = 16
_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(0, 1 << 63, M, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, M, np.uint64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, k2, n_shingles, d1, d2, sig) of every row: hash of the text, set size, 128-bit digest of the set and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            for i, j in tv.slices(off):
                u, ptr = tv.row_sets(*tv.Words(data, off[i : j + 1]).shingles(words))
                sig = np.empty((j - i, M), np.uint32)
                for k in range(M):
                    sig[:, k] = tv.row_mins(u * _MUL[k] + _ADD[k], ptr, 0) >> np.uint64(32)
                digests = [tv.row_sums(tv.mix(u ^ np.uint64(s)), ptr).view(np.int64) for s in (0x1234567, 0xFEDCBA98)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in ("doc_id", "k2")), pa.array(np.diff(ptr)), *map(pa.array, digests), tv.blobs(sig.reshape(-1), np.arange(j - i + 1) * M)],
                    ["doc_id", "k2", "n_shingles", "d1", "d2", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, k2 long, n_shingles long, d1 long, d2 long, sig binary")


def _post(classes: DataFrame) -> DataFrame:
    """(rep, n, key) for each coordinate of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, _ = tv.buffers(batch.column("sig"))
            off = tv.buffers(batch.column("sig"))[1]
            sig = data[off[0] : off[-1]].view(np.uint32).reshape(-1, M)
            key = sig.astype(np.int64) | (np.arange(M, dtype=np.int64) << 32)[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(c).to_numpy(), M)) for c in ("rep", "n")] + [pa.array(key.reshape(-1))], ["rep", "n", "key"])

    return classes.select("rep", "n", "sig").mapInArrow(run, "rep long, n long, key long")


def _collide(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in MATCHES coordinates at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ((lambda d, o: d[o[0] : o[-1]].view(np.uint32).reshape(-1, M))(*tv.buffers(batch.column(c))) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= MATCHES))

    sig = classes.select("rep", "sig")
    both = pairs.join(sig.withColumnsRenamed({"rep": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"rep": "b", "sig": "sb"}), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs with 100 * |A & B| >= percent * |A | B| on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [tv.buffers(batch.column(c)) for c in ("ta", "tb")]
            step = 256
            for i in range(0, batch.num_rows, step):
                j = min(i + step, batch.num_rows)
                (ua, pa_), (ub, pb) = (tv.row_sets(*tv.Words(d, o[i : j + 1]).shingles(words)) for d, o in cols)
                ok = np.zeros(j - i, bool)
                for r in range(j - i):
                    x, y = ua[pa_[r] : pa_[r + 1]], ub[pb[r] : pb[r + 1]]
                    z = np.sort(np.concatenate([x, y]))
                    both = int(np.count_nonzero(z[1:] == z[:-1]))
                    ok[r] = both > 0 and 100 * both >= percent * (len(z) - both)
                yield batch.select(["a", "b"]).slice(i, j - i).filter(pa.array(ok))

    a, b = texts.withColumnsRenamed({"doc_id": "a", "text": "ta"}), texts.withColumnsRenamed({"doc_id": "b", "text": "tb"})
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _bitmaps(texts: DataFrame, words: int) -> DataFrame:
    """(rep, bits): each set's bitmap of BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            for i, j in tv.slices(off, 1 << 18):
                u, ptr = tv.row_sets(*tv.Words(data, off[i : j + 1]).shingles(words))
                bits = np.zeros((j - i, BITS), bool)
                bits[np.repeat(np.arange(j - i), np.diff(ptr)), (u >> np.uint64(20)) % np.uint64(BITS)] = True
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), tv.blobs(np.packbits(bits, axis=1).reshape(-1), np.arange(j - i + 1) * (BITS // 8))], ["rep", "bits"])

    return texts.mapInArrow(run, "rep long, bits binary")


def _compare(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one block pair of a list, of different components, that may be links. Rows come sorted by (key, i, j)."""

    def pairs(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        rep, n, part, blk = (t.column(c).to_numpy() for c in ("rep", "n", "part", "blk"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, M)
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        same_block = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        a, b = [], []
        for r in range(t.num_rows - 1):
            x = r + 1 + np.flatnonzero((part[r + 1 :] != part[r]) & (100 * np.minimum(n[r + 1 :], n[r]) >= percent * np.maximum(n[r + 1 :], n[r])))
            if not same_block:
                x = x[blk[x] != blk[r]]
            x = x[(sig[x] == sig[r]).sum(1) >= MATCHES]
            if len(x):
                mine = n[r] - np.bitwise_count(bits[r] & ~bits[x]).sum(1, dtype=np.int64)
                both = np.minimum(mine, n[x] - np.bitwise_count(bits[x] & ~bits[r]).sum(1, dtype=np.int64))
                x = x[100 * both >= percent * (n[r] + n[x] - both)]
                a.append(np.minimum(rep[r], rep[x]))
                b.append(np.maximum(rep[r], rep[x]))
        if not a:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            if held and any(held[0].column(c)[0] != batch.column(c)[0] for c in ("key", "i", "j")):
                cut = np.concatenate([[0], cut])
            at = 0
            for c in cut.tolist():
                held.append(batch.slice(at, c - at))
                if out := pairs(pa.Table.from_batches(held)):
                    yield out
                held, at = [], c
            held.append(batch.slice(at))
        if held and (out := pairs(pa.Table.from_batches(held))):
            yield out

    return blocks.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, k2, n_shingles, component_id, component) of every row of ``docs``; k2 is a hash of the text, component a number of the group, null for an empty set."""
    docs = doc_texts(docs).withColumn("k2", text_key(F.col("doc_id"), F.col("text")))
    rows = materialize(signatures(docs, words), "signatures")
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k2")
    classes = rows.filter("n_shingles > 0").groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(F.min(member).alias("least"), F.min_by("sig", member).alias("sig"), F.count("*").alias("copies"))
    # numbered in the order of the rows, so that a list's smallest member, its star's centre, is its oldest text
    classes = materialize(classes.orderBy("least").withColumn("rep", F.monotonically_increasing_id()), "classes")
    posted = _post(classes)
    shared = posted.groupBy("key").agg(F.count("*").alias("freq")).filter("freq > 1")
    # pairs that a set alone has are its rarest; of the others it posts what its prefix still holds
    prefix = materialize(
        posted.join(shared.hint("merge"), "key")
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("freq", "key"))).alias("k"))
        .filter(F.size("k") >= MATCHES)
        .select("rep", "n", F.explode(F.expr(f"slice(k, 1, size(k) - {MATCHES - 1})")).alias("k"))
        .select("rep", "n", "k.key"),
        "prefix",
    )
    wanted = prefix.select("rep").distinct().join(classes.select("rep", F.coalesce("least.doc_id", F.lit(0)).alias("k1"), F.col("least.k2").alias("k2")), "rep")
    named = docs.select(F.coalesce("doc_id", F.lit(0)).alias("k1"), "k2", "text")
    texts = materialize(named.join(wanted.hint("merge"), ["k1", "k2"]).select(F.col("rep").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts")
    centre = prefix.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"), F.count("*").alias("m")).filter("m > 1")
    star = prefix.join(centre.hint("merge"), "key").filter(f"rep > c.rep AND 100 * least(n, c.n) >= {percent} * greatest(n, c.n)").select(F.col("c.rep").alias("a"), F.col("rep").alias("b"))
    first = materialize(_collide(star.distinct(), classes), "pairs", narrow=True)
    links = materialize(_confirm(first, texts, words, percent), "links", narrow=True)
    label = materialize(components(links), "labels", narrow=True)

    drop(first)
    member = materialize(prefix.join(label.select(F.col("v").alias("rep"), "label"), "rep", "left").select("rep", "n", "key", F.coalesce("label", "rep").alias("part")), "members", narrow=True)
    split = member.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("m")).filter("lo < hi").select("key", F.ceil(F.col("m") / BLOCK).alias("nb"))
    left = member.join(split, "key").withColumn("blk", F.pmod(F.xxhash64("rep"), "nb"))
    ends = F.transform(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1), lambda o: F.struct(F.least("blk", o).alias("i"), F.greatest("blk", o).alias("j")))
    bits = _bitmaps(texts.join(left.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), words)
    full = left.join(classes.select("rep", "sig"), "rep").join(bits, "rep").withColumn("e", F.explode(ends)).select("key", "e.i", "e.j", "blk", "rep", "n", "part", "sig", "bits")
    second = materialize(_compare(full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), percent).distinct(), "pairs", narrow=True)
    if second.take(1):
        more = materialize(_confirm(second, texts, words, percent), "links", narrow=True)
        label = materialize(components(links.union(more)), "labels", narrow=True)

    drop(texts, prefix, member, second)
    to = classes.join(label.select(F.col("v").alias("rep"), "label"), "rep", "left").withColumn("component", F.coalesce("label", "rep"))
    least = to.groupBy("component").agg(F.min("least").getField("doc_id").alias("component_id"))
    salt = lambda doc_id, k2: F.pmod(F.xxhash64(doc_id, k2), F.lit(SALTS)).cast("int")
    # a class of one row meets it under its own salt, a larger one is there under each
    salts = F.when(F.col("copies") == 1, F.array(salt("least.doc_id", "least.k2"))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    to = materialize(to.select("d1", "d2", F.col("n").alias("n_shingles"), "component", salts.alias("salts")).join(least, "component"), "components")
    salted = to.withColumn("salt", F.explode("salts")).drop("salts")
    own = rows.select("doc_id", "k2", "n_shingles", "d1", "d2", salt("doc_id", "k2").alias("salt"))
    found = own.join(salted, ["d1", "d2", "n_shingles", "salt"], "left")
    return found.select("doc_id", "k2", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")


def text_key(doc_id: Column, text: Column) -> Column:
    """With the doc_id it tells rows apart: a hash of the text and of whether there is a doc_id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), doc_id.isNull())


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest doc_id (then hash of the text; without doc_id the last); all columns kept. Of rows that repeat both doc_id and text one stays."""
    groups = near_groups(docs, words, percent).select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k2").alias("row"), "component")
    kept = groups.filter("component IS NOT NULL").groupBy("component").agg(F.min("row").alias("row")).select("row")
    kept = kept.unionByName(groups.filter("component IS NULL").select("row"))
    k1, k2 = fresh(docs, "kept_k1"), fresh(docs, "kept_k2")
    kept = kept.select(F.coalesce("row.doc_id", F.lit(0)).alias(k1), F.col("row.k2").alias(k2)).distinct()
    key = F.col("doc_id").cast("long")
    rows = docs.withColumns({k1: F.coalesce(key, F.lit(0)), k2: text_key(key, F.col("text"))})
    return rows.join(kept.hint("merge"), [k1, k2], "left_semi").dropDuplicates([k1, k2]).drop(k1, k2)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, component and whether it is kept; four-word shingles."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
    return groups.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: op5 in DuckDB; words hold no spaces, so a joined shingle is unambiguous.
OP5_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::varchar[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END)) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
    r(doc_id, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.x)
    SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(x) AS component_id, r.doc_id = min(x) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
