"""Queries and their SQL agree where rows tie and where keys repeat."""

import duckdb

from packproof import catalog


def both(spark, folder, name, tables):
    """Rows of a query and of its SQL over tables given as DuckDB SELECTs."""
    con = duckdb.connect()
    for table, select in tables.items():
        con.execute(f"COPY ({select}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    result = con.execute(catalog.SQL[name])
    at = {c[0]: k for k, c in enumerate(result.description)}
    return got, sorted(tuple(str(r[at[c]]) for c in columns) for r in result.fetchall())


def test_bands_of_equal_spans(spark, tmp_path):
    lines = "SELECT (i % 100)::BIGINT AS l_orderkey, (i // 100)::INT AS l_linenumber, (hash(i) % 5 * 40)::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, (hash(i + 7) % 3 * 10 + 1)::DOUBLE AS l_quantity FROM range(300000) r(i)"
    got, expected = both(spark, tmp_path, "win7_column_bands", {"lineitem": lines})
    assert len(got) == 500 and got == expected


def test_companies_that_share_a_prefix(spark, tmp_path):
    tables = {
        "supplier": "SELECT unnest([1234, 12341, 12349])::BIGINT AS s_suppkey, 0 AS s_nationkey",
        "nation": "SELECT 0 AS n_nationkey, 'N' AS n_name",
        "lineitem": """SELECT i::BIGINT AS l_orderkey, 1 AS l_linenumber, (i * 5)::BIGINT AS l_partkey, 1234::BIGINT AS l_suppkey, 20.0::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice,
            0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, DATE '2024-01-01' AS l_shipdate FROM range(1, 7) r(i)""",
    }
    got, expected = both(spark, tmp_path, "jn1_gs1", tables)
    assert got == expected and {r[0] for r in got} == {"C12349"}
