"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from opportune.plans.oracle import ORACLE
from opportune.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__module__ == "numpy":
        return repr(round(float(v), 5))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLE[name]).df())


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
