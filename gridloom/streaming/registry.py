"""SRC-17, SRC-18, SNK-18: a registry folder followed as a stream, with the active version of each model as state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from gridloom.sources import schemas as S

OUT = "name string, id string, version string, number long, previous string"


class Active(StatefulProcessor):
    """The model of each name with the highest version number; an older one that comes later changes nothing, nor does one that comes again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "id string, number long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = tuple(self.now.get()) if self.now.exists() else (None, -1)
        best = max(((r["number"], r["id"], r["version"]) for r in rows), default=None)
        if best is not None and best[0] > before[1]:
            self.now.update((best[1], best[0]))
            yield Row(name=key[0], id=best[1], version=best[2], number=best[0], previous=before[0])


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """The manifests of <folder>/<id>/manifest.json as a stream: new folders are found as they appear (published by rename, so whole)."""
    files = spark.readStream.schema(S.MODEL).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").option("multiLine", True)
    return files.json(folder).withColumn("id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """(name, id, version, number, previous) whenever a model's active version changes (update mode); a name that is missing is the id.

    OCR-16: manifests whose version holds no number can't be activated and are left out. Needs the state store that the life cycle needs.
    """
    found = manifests(spark, folder).withColumns({"name": F.coalesce("name", "id"), "number": F.try_to_number(F.regexp_extract("version", "([0-9]{1,18})", 1), F.lit("999999999999999999")).cast("long")})
    known = found.filter("number IS NOT NULL").select("name", "id", "version", "number")
    return known.groupBy("name").transformWithState(Active(), OUT, "Update", "None")
