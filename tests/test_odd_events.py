"""Queries beside their SQL on events without a user, of other kinds, and with texts that look like another layer."""

import duckdb
import pytest

from framelake.queries import ORACLE, QUERIES

QUERY_NAMES = ["wire_dispatch", "packet_layers", "frame_buffers"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Each user with each kind of event and each text."""
    at = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    users = "unnest([0, 7, 7056, 29466, null]::bigint[])"
    kinds = "unnest(['click', 'view', 'purchase', 'signup', 'error', 'other', null])"
    texts = """unnest(['{"k": 1}', '', null, 'GET / HTTP/1.1', 'HTTP/1.1 200 OK', 'PRI * HTTP/2.0', chr(22) || chr(3) || chr(1) || 'ab'])"""
    con.execute(f"create table events as select row_number() over () - 1 as event_id, timestamp '2024-01-01' as ts, u as user_id, k as event_type, 1.0::double as value, p as props from (select {users} as u), (select {kinds} as k), (select {texts} as p)")
    con.execute(f"copy events to '{at}/events.parquet' (format parquet)")
    return con, str(at)


@pytest.mark.parametrize("name", QUERY_NAMES)
def test_query(spark, odd, name):
    con, at = odd
    df = QUERIES[name](spark, at)
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert rows and sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(rows, key=repr)
