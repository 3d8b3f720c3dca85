"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets that fit in memory, by a seeded hash of the
record's place in the scan; pass two shuffles each bucket by Fisher-Yates with a generator seeded
by (seed, bucket) and writes it to the shared folder. A record's global position is its bucket's
start plus its position inside; the position gives shard (position mod n) and slot (position div
n), so counts differ by one at most (the law ``rows``) and slots have no gaps.

The buckets are written once before positions are derived, so a lost executor changes nothing
afterwards. A hash of the place, not of the content, also spreads rows that are all alike: no
key, group of equal texts or source can fill a bucket. Null text counts as no bytes. An empty
table gives no rows; repeated rows are dealt like any others; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import fresh, materialize

BUCKET_BYTES = 48 << 20
GROUP = 4096  # buckets whose starts one task sums up


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of range(n)."""
    draw = np.random.default_rng([seed, bucket]).integers(0, np.arange(n, 0, -1)) if n else np.zeros(0, int)
    out = list(range(n))
    for i, d in enumerate(draw.tolist()):  # position i gets one of those not placed yet
        j = i + d
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def added(df: DataFrame) -> tuple[str, str, str]:
    """The names under which ``shuffle`` adds size, shard and slot to ``df``: others where these clash."""
    return fresh(df, "size"), fresh(df, "shard"), fresh(df, "slot")


def shuffle(df: DataFrame, n_shards: int, seed: int = 11, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with columns size, shard and slot (named as ``added`` says); see the module text."""
    spark = df.sparkSession
    size, shard, slot = added(df)
    bucket, pos, place, begin = (fresh(df, c) for c in ("bucket_", "position_", "place_", "start_"))
    sized = df.withColumn(size, F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8)
    total = sized.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    scattered = sized.withColumn(place, F.monotonically_increasing_id()).withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), place), F.lit(buckets)).cast("int"))
    keep = [c for c in scattered.columns if c != place]

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by(place)
        order = fisher_yates(table.num_rows, seed, table.column(bucket)[0].as_py())
        return table.take(pa.array(order)).select(keep).append_column(pos, pa.array(np.arange(table.num_rows)))

    schema = scattered.select(*keep).withColumn(pos, F.lit(0).cast("long")).schema
    written = materialize(scattered.repartition(min(buckets, 20_000), bucket).groupBy(bucket).applyInArrow(one, schema), "buckets")
    # running start of each bucket: a number for each, summed in a window over GROUP buckets at a time
    counts = written.groupBy(bucket).agg(F.count("*").alias("n")).withColumn("g", F.floor(F.col(bucket) / GROUP))
    groups = {r["g"]: r["n"] for r in counts.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    before = F.create_map(*(F.lit(x) for g in sorted(groups) for x in (g, sum(n for k, n in groups.items() if k < g)))) if groups else F.create_map(F.lit(0), F.lit(0))
    inside = F.sum("n").over(Window.partitionBy("g").orderBy(bucket)) - F.col("n")
    start = counts.select(bucket, (inside + F.element_at(before.cast("map<bigint,bigint>"), F.col("g"))).alias(begin))
    whole = written.join(start, bucket).withColumn(pos, F.col(pos) + F.col(begin)).drop(begin)
    return whole.withColumns({shard: (F.col(pos) % n_shards).cast("int"), slot: F.floor(F.col(pos) / n_shards).cast("long")}).drop(bucket, pos)


def write_shards(df: DataFrame, path: str, n_shards: int, seed: int = 11) -> None:
    """Write ``df`` as one folder for each shard, rows in the order of their slots; the columns added are named as ``added`` says."""
    _, shard, slot = added(df)
    shuffle(df, n_shards, seed).repartition(n_shards, shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op4(spark: SparkSession, sf_dir: str, n_shards: int = 24) -> DataFrame:
    """Shard and slot of every document under the law ``rows``; columns of these names in the table are ignored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return shuffle(docs, n_shards).select("doc_id", "size", F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
