"""Queries beside their SQL on keys beyond those of the test tables: source ports and numbers that could be taken for something else."""

import duckdb
import pytest
from pyspark.sql import functions as F

from framelake.dissect import wire
from framelake.queries import ORACLE, QUERIES

#: Users whose source ports are 8080, 30490, 5353 and 9443, and one whose number is 5 in 16 bits; with them users of a service.
USERS = (5, 7056, 29466, 4329, 8419, 65541)
QUERY_NAMES = ["app_field_table", "frame_buffers", "packet_layers", "flt_dns_flag", "ip_reassembled_udp", "wire_dispatch", "wire_filter", "flt_packet_info", "flt_someip"]


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """Each user with each kind of event, four times; ids hold 9443 in places."""
    at = tmp_path_factory.mktemp("far")
    con = duckdb.connect()
    users, kinds = "unnest([%s])" % ", ".join(map(str, USERS)), "unnest(['click', 'view', 'purchase', 'signup', 'error'])"
    con.execute(f"create table e as select row_number() over () - 1 as n, u, k from (select {users} as u) cross join (select {kinds} as k) cross join range(4)")
    con.execute("create table events as select case when n % 7 = 0 then 944300 + n else n end as event_id, timestamp '2024-01-01' + n * interval 1 second as ts, u::bigint as user_id, k as event_type, n::double as value, '{\"k\": ' || n || '}' as props from e")
    con.execute(f"copy events to '{at}/events.parquet' (format parquet)")
    return con, str(at)


@pytest.mark.parametrize("name", QUERY_NAMES)
def test_query(spark, far, name):
    con, at = far
    df = QUERIES[name](spark, at)
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert rows and sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(rows, key=repr)


def layer(spark, transport, source, target, payload):
    make = wire.udp(F.lit(source), F.lit(target), F.lit(bytearray(payload))) if transport == 17 else wire.tcp(F.lit(source), F.lit(target), F.lit(1), F.lit(1), F.lit(0x18), F.lit(bytearray(payload)))
    frame = wire.ethernet(F.lit(1), F.lit(2), F.lit(0x800), wire.ipv4(F.lit(1), F.lit(2), F.lit(transport), make))
    return wire.dissect(spark.range(1).select(F.col("id").alias("frame_id"), F.lit(0).cast("bigint").alias("timestamp_ns"), frame.alias("data"))).first()["app"]


HELLO = bytes.fromhex("16030100020100")
SOMEIP = bytes.fromhex("00050102" + "00000008" + "00000001" + "01010000")


@pytest.mark.parametrize(
    ("transport", "source", "target", "payload", "want"),
    [
        (6, 8080, 9443, HELLO, "tls"),
        (6, 8080, 9443, b"HTTP/1.1 200 OK\r\n\r\n", "http"),
        (6, 8080, 40000, b"the rest of a body", "http"),
        (6, 40000, 8080, HELLO, "http"),
        (17, 30490, 53, SOMEIP, "dns"),
        (17, 53, 30490, SOMEIP, "dns"),
        (17, 30490, 5000, b'{"k": 69}', None),
        (17, 30490, 5000, SOMEIP, "someip"),
        (17, 5000, 30490, b"cut", "someip"),
    ],
)
def test_ports(spark, transport, source, target, payload, want):
    assert layer(spark, transport, source, target, payload) == want
