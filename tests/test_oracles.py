"""Every query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

from pluvion.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()), key=repr)
    assert sorted(names) == columns and len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6) for x, y in zip(a, b)), (a, b)
