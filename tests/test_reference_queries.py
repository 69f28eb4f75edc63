"""Every registered query runs on the smallest tables, and equals its SQL where it has one."""

import datetime as dt
import os

import duckdb
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return out


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def rows(columns, found):
    order = sorted(columns)
    return sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql:
        found = db.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, found.fetchall())


def test_flagship(spark):
    assert catalog.FLAGSHIP in catalog.queries()
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
