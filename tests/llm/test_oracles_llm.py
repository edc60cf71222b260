"""The operators that SQL can express agree with DuckDB on every row."""

import os
import sys

import duckdb
import pytest

from helpers import SF_SMALL
from riskmart.llm.catalog import QUERIES, SQL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
from oracle_check import TABLES, digest  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df, rel = QUERIES[name](spark, SF_SMALL), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(rel.columns, rel.fetchall())[0]


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
