"""Every query of the library that has SQL returns what DuckDB does, on the smallest tables."""

import math
import os

import duckdb
import pytest

from sluice.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.5f}"
    return str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*columns).collect())
    want = oracle.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in want.fetchall())
