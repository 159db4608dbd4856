"""Every query that has SQL gives the rows of that SQL on DuckDB; the others give rows."""

import os

import duckdb
import pytest

import __spark_entry__
from lodestrand import plans

SF = "/root/testdata/sf0.001"


def told(value):
    return round(value, 5) + 0.0 if isinstance(value, float) else value


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(plans.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted([tuple(told(r[names.index(c)]) for c in columns) for r in found.fetchall()], key=repr)
    assert sorted([tuple(told(r[c]) for c in columns) for r in df.collect()], key=repr) == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
