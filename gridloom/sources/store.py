"""A cell store with exactly-once commits (SNK-03, SNK-04): staged cells, blueprints and their cells under one folder.

A commit is a folder of Parquet tables that becomes visible by one rename, whole or not at all:

    <root>/commit=<number>-<writer>-<batch>/{cells,closed,blueprints,blueprint_cells,applied}

* A failed task or a lost driver leaves only a staging folder, which no reader looks at.
* A batch is known by (writer, batch id), as ``foreachBatch`` gives it; one that has been committed is not written again, so a replay changes
  nothing. Names are known until ``compact`` folds them into ``applied``, which keeps each writer's highest batch; a writer's batch ids ascend.
* Staged cells are last write wins by (commit, order inside the batch). Completing jobs writes their blueprints and the mark that
  closes their staging in one commit, so no reader sees both or neither.

A rename must be atomic, as on HDFS and local disks. One driver commits to a store at a time, as numbers are taken from the listing. A
query that was planned before ``compact`` may miss its files and is to be run again. Nothing passes the driver but names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import jobs as J
from gridloom.operators.cells import KEY, latest

CELLS = "job long, row long, col long, code string, confidence double, pos long"
CLOSED = "job long"
BLUEPRINTS = "blueprint_id string, job long, rows int, cols int"
BLUEPRINT_CELLS = "blueprint_id string, row long, col long, code string, confidence double"
APPLIED = "writer string, batch long"
TABLES = {"cells": CELLS, "closed": CLOSED, "blueprints": BLUEPRINTS, "blueprint_cells": BLUEPRINT_CELLS, "applied": APPLIED}


class CellStore:
    """The store under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[str]:
        """Names of the commits, oldest first."""
        at = self._path(self.root)
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in names if n.startswith("commit="))

    def applied(self, writer: str, batch: int) -> bool:
        """Whether this batch of the writer has been committed."""
        names = self.commits()
        if any(n.endswith(f"-{writer}-{batch}") for n in names):
            return True
        if not any("-compact-" in n for n in names):
            return False
        most = self.read("applied").filter(F.col("writer") == writer).agg(F.max("batch")).first()[0]
        return most is not None and batch <= most

    def read(self, table: str) -> DataFrame:
        """Rows of a table of all commits, with the commit's name."""
        paths = [f"{self.root}/{n}/{table}" for n in self.commits() if self._fs.exists(self._path(f"{self.root}/{n}/{table}"))]
        schema = f"{TABLES[table]}, commit string"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*paths)

    def commit(self, writer: str, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Write ``tables`` as one commit; False, and nothing written, if the batch is there already."""
        if "-" in writer:
            raise ValueError("a writer's name must not hold '-'")
        if self.applied(writer, batch):
            return False
        mark = self.spark.range(1).select(F.lit(writer).alias("writer"), F.lit(batch).cast("long").alias("batch"))
        self._publish(writer, batch, tables | {"applied": mark})
        return True

    def _publish(self, writer: str, batch: int, tables: dict[str, DataFrame]) -> None:
        done = self.commits()
        name = f"commit={int(done[-1][7:22]) + 1 if done else 0:015d}-{writer}-{batch}"
        staged, final = f"{self.root}/_staged-{uuid.uuid4().hex}", self._path(f"{self.root}/{name}")
        try:
            for t, df in tables.items():
                df.to(self.spark.createDataFrame([], TABLES[t]).schema).write.parquet(f"{staged}/{t}")
            if self._fs.exists(final) or not self._fs.rename(self._path(staged), final):
                raise RuntimeError(f"{name} could not be published")
        finally:
            self._fs.delete(self._path(staged), True)

    def apply_cells(self, cells: DataFrame, batch: int, writer: str = "cells") -> bool:
        """SNK-03: upsert (job, row, col, code, confidence, pos); of a key's rows in the batch that with the highest pos counts."""
        return self.commit(writer, batch, {"cells": latest(cells, KEY, F.desc("pos"), F.desc("confidence"), F.desc("code"))})

    def sink(self, writer: str = "cells") -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``."""
        return lambda df, batch: self.apply_cells(df, batch, writer) and None

    def staged(self) -> DataFrame:
        """The cells in effect of jobs that aren't closed; a cell that comes after its job was closed opens it again."""
        closed = self.read("closed").groupBy("job").agg(F.max("commit").alias("_closed"))
        open_ = self.read("cells").join(closed, "job", "left").filter(F.col("_closed").isNull() | (F.col("commit") > F.col("_closed"))).drop("_closed")
        return latest(open_, KEY, F.desc("commit"), F.desc("pos"))

    def complete(self, jobs: DataFrame, batch: int, writer: str = "complete") -> bool:
        """SNK-04: blueprints of the ``jobs`` (id, rows, cols, total_cells) whose staging is whole, and the end of that staging, in one commit."""
        blueprints, cells = J.complete(jobs, self.staged().drop("commit", "pos"))
        return self.commit(writer, batch, {"blueprints": blueprints, "blueprint_cells": cells, "closed": blueprints.select("job")})

    def blueprints(self) -> DataFrame:
        """A job completed twice has its last blueprint."""
        return latest(self.read("blueprints"), ["job"], F.desc("commit"))

    def blueprint_cells(self) -> DataFrame:
        return self.read("blueprint_cells").join(self.blueprints().select("blueprint_id", "commit"), ["blueprint_id", "commit"], "left_semi")

    def compact(self) -> int:
        """SNK-08: one commit with all rows in effect in place of those before it; closed staging goes. Returns how many folders went.

        The new commit is visible before the old ones go: until then, rows that are there twice are the same.
        """
        old = self.commits()
        if not old:
            return 0
        keep = {
            "cells": self.staged().drop("commit"), "blueprints": self.blueprints().drop("commit"), "blueprint_cells": self.blueprint_cells().drop("commit"),
            "applied": self.read("applied").groupBy("writer").agg(F.max("batch").alias("batch")),
        }
        self._publish("compact", 0, keep)
        for n in old:
            self._fs.delete(self._path(f"{self.root}/{n}"), True)
        return len(old)
