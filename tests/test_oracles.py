"""Every named query against its SQL in DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tripflow.plans.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted(df.itertuples(index=False, name=None), key=repr)


def kind(dtype) -> str:
    return pd.api.types.infer_dtype(pd.Series([], dtype=dtype))


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    ours = entry.queries()[name](spark, SF_DIR).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0
    assert rows(ours) == rows(theirs)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
