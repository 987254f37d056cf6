"""Every query of the engine beside its SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from framelake.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytearray, memoryview)):
        return bytes(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    want = sql.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got), key=repr)
    b = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert a == b
