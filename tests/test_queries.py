"""Every registered query of the library beside its SQL on the smallest tables."""

import os

import pytest

from loomgraph.plans import registry
from tools import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false; SET TimeZone = 'UTC'")
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF)
    got = compare.rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name in registry.ORACLES:
        cursor = duck.execute(registry.ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(frame.columns)
        assert got == compare.rows_of(columns, cursor.fetchall())
    else:
        assert frame.columns


def test_entry(spark):
    import __spark_entry__

    golden = [1, 2, 3, 6, 7, 14, 12, 25, 50, 0, 4, 5, 11, 13, 9, 19, 22, 27, 10, 21, 42, 24, 26, 49, 55, 53, 99, 111]
    rows = __spark_entry__.entry(spark).orderBy("pos").collect()
    assert [r["id"] for r in rows] == golden


def test_every_name_has_a_callable():
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert all(callable(f) for f in queries.values()) and set(__spark_entry__.oracle_sql()) <= set(queries)
