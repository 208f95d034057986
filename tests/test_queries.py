"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from ledgerloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(name, spark, sf_dir, oracle):
    df = plans.queries()[name](spark, sf_dir)
    table = df.toArrow()
    rows = list(zip(*(c.to_pylist() for c in table.columns)))
    if name not in plans.oracle_sql():
        assert rows
        return
    cursor = oracle.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered(df.columns, rows) == ordered(columns, cursor.fetchall())
