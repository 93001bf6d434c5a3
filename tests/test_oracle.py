"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from packproof import catalog, derive

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in derive.SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    result = duck.execute(catalog.SQL[name])
    at = {c[0]: k for k, c in enumerate(result.description)}
    assert sorted(at) == columns
    assert got == sorted(tuple(str(r[at[c]]) for c in columns) for r in result.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
