"""Shared helpers: materialisation in the cluster's shared folder and input hygiene."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []
#: whether Spark removes the shuffle files of a query when it ends
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="gridloom-"))
    return _LOCAL_DIR[0]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that go to Python at once: texts may be long, so fewer than Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; cuts the lineage for good.

    Unlike a local checkpoint the rows outlive any executor, and later readers prune columns.
    ``narrow``: rows of a few numbers, dealt to an eighth of the session's shuffle partitions so
    that they don't end in many tiny files.
    The shuffles behind the table go as soon as it is written. Snappy works on the heap; zstd contexts of many small files added up outside it.
    """
    spark = df.sparkSession
    small_batches(spark)
    if narrow:
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "snappy").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, as all that came from them has been written too."""
    for t in tables:
        for file in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) with null texts as empty; other columns, clashing names included, fall away."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet, ignoring case; for rows that go to Python whole."""
    small_batches(df.sparkSession)
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_id(c: Column) -> Column:
    """crc32 of the decimal id, the fold key of the hold-out split."""
    return F.crc32(c.cast("string").cast("binary"))
