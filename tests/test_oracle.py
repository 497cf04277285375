"""Every query with an SQL twin against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from gridloom.plans import registry

DATA = os.environ.get("GRIDLOOM_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}")
        return v.isoformat() if isinstance(v, datetime.datetime) else v

    return sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in registry.SQL:
        assert got
        return
    cursor = duck.execute(registry.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, cursor.fetchall())
