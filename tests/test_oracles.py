"""Every registered query of the reference's operators against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from gridloom.plans import queries as Q

DIR = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def rows(df, cols):
    def text(v):
        if not isinstance(v, str) and pd.isna(v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted(tuple(map(text, r)) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = Q.queries()[name](spark, DIR)
    got, r = df.toPandas(), duck.sql(Q.oracle_sql()[name])
    want = r.df()
    assert sorted(got.columns) == sorted(want.columns)
    kinds = dict(zip(r.columns, map(str, r.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_all_have_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())
