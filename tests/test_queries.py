"""Every query against its SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as E
from tidewatch.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, (int, float)) and x is not None for x in (*a, *b)) else [x for x in a] == [y if not isinstance(y, float) else pytest.approx(y, abs=2e-6) for y in b]


def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(catalog.oracle_sql()) <= set(E.queries())
