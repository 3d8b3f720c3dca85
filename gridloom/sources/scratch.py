"""A folder for files that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, ``spark.checkpoint.dir``; a temporary one where it is unset, as in tests on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    shared = shared or "file://" + tempfile.mkdtemp(prefix="grid-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
