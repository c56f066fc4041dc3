"""Every query outside the optional subpackages against its SQL, on the smallest fixture."""

import datetime
import decimal

import duckdb
import pytest

from faultlens import catalog

SF = "/root/testdata/sf0.001"
WITHOUT_SQL = {"r03_cover_density"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:  # compared with plain versions in the tests of their operators
        assert name in WITHOUT_SQL and rows
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    other = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(rows, key=repr) == sorted(other, key=repr)


def test_flagship(spark):
    assert catalog.flagship(spark, SF).columns == ["doc_id", "tier", "score"]
