"""Domain relations made from the driver's tables; each SQL text runs in Spark and in DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "dict_raw": """SELECT upper(substr(p_type, 1, 1)) || cast(p_size AS {text}) AS code, p_name AS name, p_brand AS brand,
        '#' || {hex} AS hex, p_partkey AS ord, cast(substr(p_brand, length(p_brand), 1) AS int) AS brand_rank FROM part""",
    "dict": """SELECT code, name, hex, brand FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ord) AS n FROM dict_raw) x WHERE n = 1""",
    "jobs": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCEEDED' ELSE 'PENDING' END AS status, 7 AS rows, 8 AS cols,
        o_orderdate AS created_at, o_orderpriority AS name, cast(o_orderkey % 60 AS bigint) AS processed_cells, cast(56 AS bigint) AS total_cells,
        CASE WHEN o_orderkey % 3 = 0 THEN 'STALE_RESTART' END AS error_code, o_orderpriority AS error_message FROM orders""",
    "raw_cells": """SELECT l_orderkey AS job, cast(l_linenumber - 1 AS bigint) AS row, l_partkey % 8 AS col, l_quantity / 50.0 AS confidence,
        CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'BLANK' ELSE substr('ELMPSQ', cast(l_suppkey % 6 + 1 AS int), 1) || cast(l_partkey % 55 + 1 AS {text}) END AS code,
        l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM lineitem""",
    "cells": """SELECT job, row, col, confidence, code, corrected_code FROM (SELECT *, CASE WHEN l_partkey % 17 = 0 THEN 'E1' END AS corrected_code,
        row_number() OVER (PARTITION BY job, row, col ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM raw_cells) x WHERE n = 1""",
    "pred": """SELECT id, label, confidence, CASE WHEN id % 5 = 0 THEN 'E9' ELSE label END AS code, set_name FROM (SELECT l_orderkey * 10 + l_linenumber AS id,
        CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'BLANK' ELSE substr('ELMPSQ', cast(l_suppkey % 6 + 1 AS int), 1) || cast(l_partkey % 12 + 1 AS {text}) END AS label,
        l_quantity / 50.0 AS confidence, 'set' || cast(l_suppkey % 5 AS {text}) AS set_name FROM lineitem) x""",
    "samples": """SELECT doc_id AS id, substr('ABCDE', cast(doc_id % 5 + 1 AS int), 1) || cast(n_chars % 9 AS {text}) AS code, source, CASE WHEN lang = 'en' THEN 'synth' ELSE 'real' END AS kind FROM documents""",
    "steps": """SELECT user_id AS job, cast(0 AS int) AS attempt, event_id AS seq, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN CASE WHEN event_id % 9 = 0 THEN 'completed' ELSE 'progress' END
        WHEN 'signup' THEN 'created' ELSE 'progress' END AS kind, cast(event_id % 57 AS bigint) AS processed, ts FROM events""",
}
NEEDS = {"dict": ["dict_raw"], "cells": ["raw_cells"]}
_DIALECT = {"spark": {"text": "string", "hex": "lpad(hex((p_partkey * 2654435761) % 16777216), 6, '0')"}, "duck": {"text": "varchar", "hex": "printf('%06X', (p_partkey * 2654435761) % 16777216)"}}


def _counts(query: str) -> str:
    """count_if(x) as a plain count: bigint, and 0 where x is never true."""
    while (a := query.find("count_if(")) >= 0:
        depth, b = 1, a + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(query[b], 0)
            b += 1
        query = f"{query[:a]}count(CASE WHEN {query[a + 9 : b - 1]} THEN 1 END){query[b:]}"
    return query


def duck(query: str) -> str:
    """``query`` with the views it names put in front."""
    query = _counts(query)
    used: list[str] = []

    def need(v: str) -> None:
        for x in NEEDS.get(v, []):
            need(x)
        if v not in used:
            used.append(v)

    for v in VIEWS:
        if re.search(rf"\b(FROM|JOIN)\s+{v}\b", query):
            need(v)
    views = ", ".join(f"{v} AS ({VIEWS[v].format(**_DIALECT['duck'])})" for v in used)
    if not views:
        return query
    for head in ("WITH RECURSIVE ", "WITH "):
        if query.startswith(head):
            return f"{head}{views}, {query[len(head) :]}"
    return f"WITH {views} {query}"


class Source:
    """The tables and surrogate relations of one folder, as DataFrames without registered views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __call__(self, name: str, by: str | None = None) -> DataFrame:
        """``by``: a column of the relation below that deals out its rows once, for what follows by it."""
        if name not in VIEWS:
            return self.table(name)
        sql = VIEWS[name].format(**_DIALECT["spark"])
        base = next(t for t in ("dict_raw", "raw_cells", "part", "orders", "lineitem", "documents", "events") if f"FROM {t}" in sql)
        below = self(base).repartition(by) if by else self(base)
        return self.spark.sql(sql.replace(f"FROM {base}", "FROM {base}"), base=below)

    def jobs_as_grids(self) -> DataFrame:
        return self("jobs").select(F.col("id").alias("job"), "rows", "cols")
