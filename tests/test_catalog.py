"""Every query against its SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from quarry.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (bool, str)) or value is None:
        return value
    return round(float(value), 9)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name in catalog.ORACLE:
        found = duck.sql(catalog.ORACLE[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
