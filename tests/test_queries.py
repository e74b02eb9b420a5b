"""Every query that SQL can express gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def normal(rows):
    return sorted(repr(tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert normal(map(tuple, got.select(*columns).collect())) == normal(rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
