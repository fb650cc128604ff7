"""Corpus queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tripflow.llm.oracles import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    theirs = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    ours = entry.queries()[name](spark, SF_DIR)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(tuple, ours.select(columns).collect())) == sorted(theirs.fetchall())
