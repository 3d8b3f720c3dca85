"""Merkle manifest of a data set from contiguous digest matrices.

A row's leaf is the hash of its fields, computed where the row is read. The leaves of a group (a source) ascend by id
and every ``FANOUT`` consecutive nodes become their hash, level by level, until one is left; the groups' roots, in the
groups' order, give the root of the whole in the same way.

Ranks come from one range sort of the narrow table of leaves and from counts of each task before; a group never meets in
one task. Ranks deal a group into aligned blocks of 3^7 nodes, which are independent: a block is one contiguous
numpy matrix of 64-byte digests, reshaped by the fanout and hashed row by row a level at a time. Blocks' roots are the nodes of the next,
2,187 times smaller round, until each group has one. Going down again, each block is joined with the path of its root,
and a row's siblings at every level are found by index arithmetic in the block's matrices, those of all rows of a level at once. A path is a string of
steps, ``<place in its run><siblings' digests>;`` from the leaf to the root, enough to recompute the root from any leaf.

Leaves of one id ascend by digest, null ids come first; repeated rows have leaves of their own. Null fields are told apart from
empty ones. An empty table gives no rows. Added columns don't clash with the table's, which are read by name only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import drop, fold_id, materialize, table

FANOUT = 3
HEIGHT = 7  # levels of a block, which has 2,187 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS = 8192  # of a result batch


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**fields: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in fields.values())).cast("binary"), 256)


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def height(n: int) -> int:
    """Levels above n nodes: none above a lone one."""
    h = 0
    while FANOUT**h < n:
        h += 1
    return h


def levels(digests: np.ndarray, h: int) -> list[np.ndarray]:
    """The ``S64`` vectors of h levels, the nodes first: each run of FANOUT digests, padded with empty ones in the last run, is a row of a matrix."""
    out = [digests]
    for _ in range(h):
        nodes = out[-1]
        padded = np.zeros(-(-len(nodes) // FANOUT) * FANOUT, "S64")
        padded[: len(nodes)] = nodes
        out.append(np.array([sha(b"".join(run)) for run in padded.reshape(-1, FANOUT).tolist()], "S64"))
    return out


def siblings(tree: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of every node of the lowest level and each level that has runs: its place in its run, and the run's other digests (empty where the last run is short)."""
    n, h = len(tree[0]), len(tree) - 1
    places, others = np.zeros((n, h), np.int8), np.zeros((n, h, FANOUT - 1), "S64")
    at = np.arange(n)
    for level in range(h):
        nodes = np.append(tree[level], np.zeros(FANOUT, "S64"))
        run, places[:, level] = at - at % FANOUT, at % FANOUT
        for k in range(FANOUT - 1):
            others[:, level, k] = nodes[run + k + (k >= places[:, level])]
        at //= FANOUT
    return places, others


def steps(places: np.ndarray, others: np.ndarray) -> list[bytes]:
    """The paths as text; hexadecimal digits hold no zero bytes, so absent siblings vanish."""
    n, h = places.shape
    wide = np.zeros((n, h, 2 + 64 * (FANOUT - 1)), np.uint8)
    wide[:, :, 0] = places + ord("0")
    wide[:, :, 1:-1] = np.ascontiguousarray(others).view(np.uint8).reshape(n, h, 64 * (FANOUT - 1))
    wide[:, :, -1] = ord(";")
    whole, size = wide.tobytes(), wide[0].size if n else 0
    return [whole[i * size : (i + 1) * size].replace(b"\0", b"") for i in range(n)]


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its path give."""
    for step in path.split(b";")[:-1]:
        cut = 1 + 64 * (step[0] - 48)
        digest = sha(step[1:cut] + digest + step[cut:])
    return digest


def proof(path: bytes) -> bytes:
    """Digest of all siblings, level by level, left to right."""
    return sha(b"".join(step[1:] for step in path.split(b";")[:-1]))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (grp, block) as one table for each block, one in memory at a time; their first columns are grp and block."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        groups, numbers = b.column(0).to_numpy(), b.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(groups) != 0) | (np.diff(numbers) != 0)) + 1).tolist(), b.num_rows]
        for start, end in zip(edges, edges[1:]):
            key = (groups[start], numbers[start])
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(t: pa.Table, name: str) -> np.ndarray:
    return np.array(t.column(name).to_pylist(), "S64")


def dealt(nodes: DataFrame, tall: int) -> DataFrame:
    """Nodes (grp, i, n, digest, ...) with their block, block by block in order of i."""
    rest = [c for c in nodes.columns if c not in ("grp", "i")]
    return nodes.select("grp", F.floor(F.col("i") / FANOUT**tall).cast("long").alias("block"), "i", *rest).repartition("grp", "block").sortWithinPartitions("grp", "block", "i")


def rise(nodes: DataFrame, tall: int) -> DataFrame:
    """The nodes of the next round: each block's root; ``n`` becomes the number of blocks of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            n = t.column("n")[0].as_py()
            top = levels(column(t, "digest"), min(tall, height(n)))[-1][0].decode()
            yield pa.RecordBatch.from_pylist([{"grp": t.column("grp")[0].as_py(), "i": t.column("block")[0].as_py(), "n": -(-n // FANOUT**tall), "digest": top}], schema=NODE)

    return dealt(nodes.select("grp", "i", "n", "digest"), tall).mapInArrow(run, "grp long, i long, n long, digest string")


NODE = pa.schema([("grp", pa.int64()), ("i", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])


def sink(nodes: DataFrame, above: DataFrame | None, tall: int, kept: tuple[str, ...] = ()) -> DataFrame:
    """(grp, i, kept, subroot, path) of a round's nodes: their siblings in their block, then the path of the block's root, which ``above`` has as (grp, i, subroot, path)."""
    own = nodes.select("grp", "i", "n", "digest", *(c for c in kept if c != "digest"))
    if above is None:
        own = own.withColumns({"subroot": F.lit(""), "up": F.lit("")})
    else:
        up = above.select("grp", F.col("i").alias("b"), "subroot", F.col("path").alias("up"))
        own = own.withColumn("b", F.floor(F.col("i") / FANOUT**tall).cast("long")).join(up, ["grp", "b"]).drop("b")
    out = ["grp", "i", *kept, "subroot"]
    schema = own.select(*out).withColumn("path", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            tree = levels(column(t, "digest"), min(tall, height(t.column("n")[0].as_py())))
            up = t.column("up")[0].as_py().encode()
            places, others = siblings(tree)
            t = t.select(out)
            for at in range(0, t.num_rows, ROWS):
                paths = [(p + up).decode() for p in steps(places[at : at + ROWS], others[at : at + ROWS])]
                yield from t.slice(at, ROWS).append_column("path", pa.array(paths, pa.string())).combine_chunks().to_batches()

    return dealt(own, tall).mapInArrow(run, schema)


def climb(nodes: DataFrame, tall: int) -> list[DataFrame]:
    """The rounds of nodes up to one a group; with blocks of 3^7 one round for groups of up to 2,187 nodes, two up to 4.8 million, three up to 10^10, four up to 2 * 10^13."""
    rounds, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1 or len(rounds) == 1:
        rounds.append(materialize(rise(rounds[-1], tall), "roots", narrow=True))
        most = -(-most // FANOUT**tall)
    return rounds


def ranked(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``df`` with each row's rank ``i`` in its group by ``order``, from 0.

    Rows that are equal in all of ``order`` may be too many for one task, so their place in the table, a written one, is the last key: any order of them is right.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_first(), *order, F.col("place")]
    sort = df.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(slices, *keys).sortWithinPartitions(*keys).drop("place")
    at = sort.columns.index(group)
    schema = sort.withColumns({"part": F.lit(0), "nth": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            codes = b.column(at).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            nth = np.zeros(b.num_rows, np.int64)
            for start, end in zip(edges, edges[1:]):
                value = b.column(at)[start].as_py()
                seen = seen if value == last else 0
                nth[start:end] = seen + np.arange(end - start)
                seen, last = seen + end - start, value
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(nth)], names=[*b.schema.names, "part", "nth"])

    written = materialize(sort.mapInArrow(run, schema), "ranked")
    counts = written.groupBy(group, "part").agg(F.count("*").alias("c"))
    before = (F.sum("c").over(Window.partitionBy(group).orderBy("part")) - F.col("c")).alias("before")
    starts = counts.select(F.col(group).alias("g"), F.col("part").alias("p"), before)
    joined = written.join(starts, F.col(group).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return joined.select(*df.columns, (F.col("nth") + F.col("before")).alias("i"))


def manifest(leaves: DataFrame, tall: int = HEIGHT) -> DataFrame:
    """Of leaves (source, doc_id, leaf, other columns): the other columns, doc_id, leaf, subroot, root and the path from the leaf to the root. Blocks have ``tall`` levels."""
    leaves = materialize(leaves, "leaves")
    others = tuple(c for c in leaves.columns if c not in ("source", "doc_id", "leaf"))
    placed = ranked(leaves, "source", [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()])
    sizes = materialize(leaves.groupBy("source").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), "sources", narrow=True)
    groups = ranked(sizes, "all", [F.col("source").asc_nulls_first()]).select(F.col("source").alias("s"), F.col("i").alias("grp"), "n")
    nodes = placed.join(groups, F.col("source").eqNullSafe(F.col("s"))).select("grp", "i", "n", F.col("leaf").alias("digest"), "doc_id", *others)
    nodes = materialize(nodes, "nodes")
    drop(leaves)
    rounds = climb(nodes, tall)
    tops = rounds[-1].select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("i"), F.lit(sizes.count()).cast("long").alias("n"), "digest", F.col("digest").alias("top"))
    over = climb(tops, tall)
    root = over[-1].first()
    above = None
    for k in range(len(over) - 2, 0, -1):
        above = materialize(sink(over[k], above, tall), "paths", narrow=True)
    above = sink(tops, above, tall, ("top",)).select(F.col("i").alias("grp"), F.lit(0).cast("long").alias("i"), F.col("top").alias("subroot"), "path")
    for k in range(len(rounds) - 2, 0, -1):
        above = sink(rounds[k], materialize(above, "paths", narrow=True), tall)
    out = sink(nodes, materialize(above, "paths", narrow=True), tall, ("doc_id", "digest", *others))
    return out.select("doc_id", F.col("digest").alias("leaf"), *others, "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "path")


def certified(found: DataFrame, changed: str) -> DataFrame:
    """``manifest``'s rows with proof_sha256, folded_root (from column ``changed`` where it isn't null, else from the leaf) and verified."""
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps_ = [p.encode() for p in b.column(4).to_pylist()]
            start = [(c or own).encode() for own, c in zip(b.column(1).to_pylist(), b.column(5).to_pylist())]
            folded = [fold(d, p).decode() for d, p in zip(start, steps_)]
            roots = b.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array([proof(p).decode() for p in steps_], pa.string()), pa.array(folded, pa.string()), pa.array([f == r for f, r in zip(folded, roots)], pa.bool_())],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return found.select("doc_id", "leaf", "subroot", "root", "path", changed).mapInArrow(run, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and their check after tampering of all ``documents``; a row whose id is null isn't tampered with."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    own = {c: F.col(c) for c in FIELDS}
    text = F.col("text").cast("string")
    tampered = (F.pmod(fold_id(F.col("doc_id")), F.lit(2)) == 0) & F.contains(text, F.lit("\n"))
    bad = F.when(tampered, leaf(**(own | {"text": F.replace(text, F.lit("\n"), F.lit(""))})))
    return certified(manifest(docs.select("source", "doc_id", leaf(**own).alias("leaf"), bad.alias("bad"))), "bad")


OP12_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, text, row_number() OVER () AS k,
    concat(coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source)::VARCHAR || ':' || source, '-'),
      coalesce(strlen(lang)::VARCHAR || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-')) AS head,
    list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda crc, b:
      list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda x: x::UBIGINT)), lambda d, x: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::UBIGINT) ELSE d >> 1 END)) AS crc
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM (
    SELECT k, doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
      CASE WHEN xor(crc, 4294967295::UBIGINT) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), ''))::VARCHAR || ':' || replace(text, chr(10), ''), '-')) END AS bad FROM docs)
), tree(level, source, i, n, h) AS (
  SELECT 0, source, i, n, leaf FROM leaves
  UNION ALL
  SELECT level + 1, source, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY level, source, i // 3
), subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1
), top(level, i, n, h) AS (
  SELECT 0, i, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3
), low_steps AS (
  SELECT l.k, t.level, string_agg(CASE WHEN t.i = l.i // (3 ** t.level)::BIGINT THEN '_' ELSE t.h END, '' ORDER BY t.i) AS step
  FROM leaves l JOIN tree t ON l.source IS NOT DISTINCT FROM t.source AND t.n > 1 AND t.i // 3 = l.i // (3 ** (t.level + 1))::BIGINT GROUP BY l.k, t.level
), high_steps AS (
  SELECT s.i AS grp, t.level, string_agg(CASE WHEN t.i = s.i // (3 ** t.level)::BIGINT THEN '_' ELSE t.h END, '' ORDER BY t.i) AS step
  FROM subroots s JOIN top t ON t.n > 1 AND t.i // 3 = s.i // (3 ** (t.level + 1))::BIGINT GROUP BY s.i, t.level
), low AS (SELECT k, list(step ORDER BY level) AS steps FROM low_steps GROUP BY k), high AS (SELECT grp, list(step ORDER BY level) AS steps FROM high_steps GROUP BY grp), whole AS (
  SELECT l.doc_id, l.leaf, coalesce(l.bad, l.leaf) AS start, s.subroot, (SELECT h FROM top WHERE n = 1) AS root,
    list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN low ON low.k = l.k LEFT JOIN high ON high.grp = s.i
), folded AS (SELECT *, list_reduce(list_prepend(start, steps), lambda a, b: sha256(replace(b, '_', a))) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '_', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
