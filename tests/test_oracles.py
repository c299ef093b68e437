"""Registered queries against their DuckDB oracles on the smallest tables (see also
scripts/check_oracle.py)."""

import os
import sys

import duckdb
import pytest

from conftest import SF

TABLES = ["documents", "embeddings", "benchmark", "conversations", "labels", "pages"]
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracles  # noqa: E402

KEYS = sorted(oracles.oracle_sql())


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if v != v else v for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as e
    got = e.queries()[name](spark, SF).toPandas()
    want = con.execute(e.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
