"""Every registered query with SQL is held against DuckDB on the smallest test data."""

import os

import duckdb
import pandas as pd
import pytest

from courtflow.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data is not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    plain = lambda v: None if v is None or v is pd.NA or isinstance(v, float) and v != v else float(v) if isinstance(v, (int, float, bool)) or hasattr(v, "dtype") else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())
