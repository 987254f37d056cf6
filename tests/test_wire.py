import struct

import pytest
from pyspark.sql import functions as F

from framelake.dissect import app, wire
from framelake.functions import text as T
from framelake.functions import wire as W
from framelake.operators.tcp import analyse, tcp_analysis


def checksum(data):
    data += b"\0" * (len(data) % 2)
    s = sum(struct.unpack(f">{len(data) // 2}H", data))
    while s >> 16:
        s = (s >> 16) + (s & 0xFFFF)
    return 0xFFFF - s


def ip4(payload, proto=17, frag=0, options=b""):
    head = bytearray(struct.pack(">BBHHHBBHII", 0x45 + len(options) // 4, 0, 20 + len(options) + len(payload), 7, frag, 64, proto, 0, 0x0A000001, 0x0A000002) + options)
    head[10:12] = struct.pack(">H", checksum(bytes(head)))
    return bytes(head) + payload


UDP = struct.pack(">HHHH", 1234, 5000, 12, 0) + b"\xde\xad\xbe\xef"
ETH = bytes.fromhex("001122334455 66778899aabb".replace(" ", ""))


def dissected(spark, *frames):
    df = spark.createDataFrame([(i, i * 1000, f) for i, f in enumerate(frames)], "frame_id long, timestamp_ns long, data binary")
    return {r["packet_id"]: r for r in wire.dissect(df).collect()}


def test_layers(spark):
    v6 = struct.pack(">IHBB", 6 << 28 | 5 << 20 | 9, 8 + len(UDP), 0, 33) + bytes(15) + b"\1" + bytes(15) + b"\2" + bytes([17, 0, 1, 4, 0, 0, 0, 0]) + UDP
    got = dissected(
        spark,
        ETH + b"\x08\x00" + ip4(UDP) + b"\0" * 6,  # padding is no payload
        ETH + bytes.fromhex("88a80064") + bytes.fromhex("8100200a") + b"\x08\x00" + ip4(UDP),
        ETH + b"\x86\xdd" + v6,
        ETH + b"\x08\x06" + bytes.fromhex("0001080006040001") + ETH[6:] + bytes([10, 0, 0, 1]) + bytes(6) + bytes([10, 0, 0, 1]),
        ETH + b"\x08\x00" + ip4(UDP, frag=0x2000),
        ETH + b"\x08\x00" + ip4(UDP)[:15],
        b"\1\2\3",
        ETH + b"\x08\x00" + ip4(UDP, options=b"\1\1\1\0"),
        ETH + b"\x00\x20" + bytes(32),
    )
    assert got[0]["protocols"] == ["frame", "eth", "ip", "udp", "data"]
    assert (got[0]["udp.srcport"], got[0]["udp.dstport"], got[0]["udp.length"], bytes(got[0]["udp.payload"][0])) == ([1234], [5000], [12], b"\xde\xad\xbe\xef")
    assert (got[0]["eth.dst"], got[0]["eth.src"], got[0]["eth.type"]) == ([0x001122334455], [0x66778899AABB], [0x800])
    assert (got[0]["ip.src"], got[0]["ip.ttl"], got[0]["ip.checksum.status"], got[0]["ip.len"]) == ([0x0A000001], [64], ["Good"], [32])
    assert got[1]["vlan.id"] == [100, 10] and got[1]["vlan.priority"] == [0, 1] and got[1]["vlan.etype"] == [0x8100, 0x800] and got[1]["udp.dstport"] == [5000]
    assert got[2]["ipv6.hlim"] == [33] and got[2]["ipv6.flow"] == [9] and got[2]["udp.srcport"] == [1234] and got[2]["ip.src"] == []
    assert got[3]["arp.opcode"] == [1] and got[3]["arp.isgratuitous"] == [True] and got[3]["arp.isprobe"] == [False]
    assert got[4]["ip.flags.mf"] == [True] and got[4]["udp.srcport"] == [] and got[4]["protocols"] == ["frame", "eth", "ip"]
    assert got[5]["errors"] == ["ip: too short or invalid"] and got[5]["ip.src"] == []
    assert got[6]["errors"] == ["eth: too short"] and got[6]["protocols"] == ["frame"]
    assert got[7]["ip.hdr_len"] == [24] and got[7]["ip.checksum.status"] == ["Good"] and got[7]["udp.srcport"] == [1234]
    assert got[8]["eth.len"] == [32] and got[8]["eth.type"] == []


@pytest.mark.parametrize("data", [b"", b"\x01", b"\x45\x00\x00\x1c", bytes(range(33))])
def test_checksum(spark, data):
    assert spark.createDataFrame([(data,)], "d binary").select(W.internet_checksum(F.col("d"))).first()[0] == checksum(data)


def test_numbers_and_slices(spark):
    row = spark.createDataFrame([(b"\xff" * 8 + b"\x01\x02", b"abcdef", b"\x01\x02\x03\x04")], "d binary, t binary, k binary").select(
        W.be(F.col("d"), 0, 8).alias("a"), W.be(F.col("d"), 8, 2).alias("b"), W.le(F.col("d"), 8, 2).alias("c"), W.be(F.col("d"), 9, 2).alias("e"), W.raw(F.col("t"), 1, 3).alias("f"), W.raw(F.col("t"), 4, 9).alias("g"), W.xor_mask(F.col("t"), F.col("k")).alias("x"), W.be_bytes(F.lit(-2), 2).alias("n")
    ).first()
    assert (int(row["a"]), row["b"], row["c"], row["e"], bytes(row["f"]), row["g"]) == ((1 << 64) - 1, 0x0102, 0x0201, None, b"bc", None)
    assert bytes(row["x"]) == bytes(c ^ k for c, k in zip(b"abcdef", b"\1\2\3\4\1\2", strict=True)) and bytes(row["n"]) == b"\xff\xfe"


def test_signals(spark):
    data = bytes([0b10110010, 0b01011100, 0xFF, 0x01])
    df = spark.createDataFrame([(data,)], "d binary")
    little = int.from_bytes(data, "little")
    big = "".join(f"{b:08b}" for b in data)
    for start, n in ((0, 8), (3, 7), (5, 20), (31, 1), (0, 32)):
        assert df.select(W.signal_raw(F.col("d"), start, n)).first()[0] == little >> start & (1 << n) - 1
    for start, n in ((7, 8), (5, 9), (7, 32), (0, 2)):
        at = start // 8 * 8 + 7 - start % 8
        assert df.select(W.signal_raw(F.col("d"), start, n, True)).first()[0] == int(big[at : at + n], 2)
    assert df.select(W.signal_raw(F.col("d"), 30, 8)).first()[0] is None


def test_texts(spark):
    cases = {b"\0" * 16: "::", bytes(15) + b"\1": "::1", bytes.fromhex("20010db8000000000001000000000001"): "2001:DB8::1:0:0:1", bytes.fromhex("fe80000000000000000000000000000a"): "FE80::A", bytes.fromhex("00010002000300040005000600070008"): "1:2:3:4:5:6:7:8", bytes.fromhex("00010000000000000000000000000000"): "1::"}
    rows = spark.createDataFrame([(k,) for k in cases], "v binary").select("v", T.ipv6(F.col("v")).alias("s")).collect()
    assert {bytes(r["v"]): r["s"] for r in rows} == cases
    row = spark.range(1).select(T.mac(F.lit(0x001A2B3C4D5E)).alias("m"), T.ipv4(F.lit(0xC0A80001)).alias("i"), T.iso_ns(F.lit(1_700_000_000_123_456_789)).alias("t"), T.iso_ns(F.lit(-1)).alias("n"), T.hex_pairs(F.lit(bytearray(b"\x0a\xff"))).alias("h"), T.uuid(F.lit(bytearray(range(16)))).alias("u")).first()
    assert tuple(row) == ("00:1A:2B:3C:4D:5E", "192.168.0.1", "2023-11-14T22:13:20.123456789Z", "1969-12-31T23:59:59.999999999Z", "0A FF", "00010203-0405-0607-0809-0A0B0C0D0E0F")


def names(kind, data):
    return [(n[4], next((v for v in n[5:] if v is not None), None)) for n in app.nodes_of(kind, data)]


def test_dns():
    q = struct.pack(">HHHHHH", 0x1234, 0x8180, 1, 2, 0, 0) + b"\7example\3com\0" + struct.pack(">HH", 1, 1)
    q += b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([93, 184, 216, 34]) + b"\xc0\x0c" + struct.pack(">HHIH", 15, 1, 60, 9) + struct.pack(">H", 10) + b"\4mail\xc0\x0c"
    got = names("dns", q)
    assert ("dns.qry.name", "example.com") in got and ("dns.a", 0x5DB8D822) in got and ("dns.mx.mail_exchange", "mail.example.com") in got and ("dns.flags.response", True) in got
    assert names("dns", q[:20])[-1][0] == "packet.error"
    loop = struct.pack(">HHHHHH", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c" + b"\0\1\0\1"
    assert names("dns", loop)[-1][0] == "packet.error"
    tree = app.nodes_of("dns", q)
    top = tree[0]
    assert top[3] == len(tree) - 1 and all(n[1] < n[0] <= n[3] for n in tree)


def test_other_layers():
    assert ("http.host", "a.b") in names(None, b"GET /x HTTP/1.1\r\nHost: a.b\r\n\r\n")
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    assert ("http.payload.decoded", b"abc") in names(None, chunked) and ("http.response.code", 200) in names(None, chunked)
    assert ("json.value.string", "y") in names("json", b'{"x": ["y", 1, null]}') and names("json", b"{")[-1][0] == "packet.error"
    assert ("someip.methodid", 2) in names("someip", struct.pack(">HHIHHBBBB", 1, 2, 10, 3, 4, 1, 1, 0, 0) + b"ab")
    assert ("can.id", 0x123) in names("can", struct.pack(">IB3x", 0x123, 2) + b"ab")
    assert ("websocket.payload", b"Hello") in names("websocket", bytes.fromhex("818537fa213d7f9f4d5158"))
    hello = b"\x03\x03" + bytes(32) + b"\0" + b"\0\2\x13\x01" + b"\1\0" + b"\0\x0f" + b"\0\0\0\x0b" + b"\0\x09\0\0\6server"
    record = b"\x16\3\1" + struct.pack(">H", len(hello) + 4) + b"\1" + len(hello).to_bytes(3, "big") + hello
    assert ("tls.handshake.extensions.server_name", "server") in names(None, record) and ("tls.handshake.ciphersuite", 0x1301) in names(None, record)


def test_app_rows(spark):
    df = spark.createDataFrame([(1, "json", b'{"a": 1}'), (2, None, b"\0\1"), (3, "json", None)], "packet_id long, app string, payload binary")
    rows = app.dissect(df).collect()
    assert {r["packet_id"] for r in rows} == {1} and [r["i64"] for r in rows if r["name"] == "json.value.number"] == [1]
    assert {r["name"] for r in app.dissect(df, ["json.key"]).collect()} == {"json.key"}


def test_tcp_analysis():
    ms = 10**6
    rows = [
        (0, 0, 0, 100, 0, 0, 2, 1000), (1, 40 * ms, 1, 500, 101, 0, 18, 1000), (2, 41 * ms, 0, 101, 501, 0, 16, 1000),
        (3, 50 * ms, 0, 101, 501, 10, 24, 1000), (4, 90 * ms, 1, 501, 111, 0, 16, 1000),
        (5, 100 * ms, 0, 121, 501, 10, 24, 1000), (6, 140 * ms, 1, 501, 111, 0, 16, 1000),
        (7, 300 * ms, 0, 111, 501, 10, 24, 1000), (8, 340 * ms, 1, 501, 131, 0, 16, 0),
        (9, 900 * ms, 0, 130, 501, 0, 16, 1000), (10, 950 * ms, 0, 111, 501, 10, 24, 1000),
    ]
    got = {r[0]: r for r in analyse(iter(rows))}
    assert got[4][2] == 40 * ms
    assert got[5][1] == "lost_segment" and got[6][1] == "duplicate_ack" and got[6][4] == 1
    assert got[7][1] == "retransmission" and got[8][1].startswith("zero_window") and got[9][1].startswith("keep_alive") and got[10][1] == "spurious_retransmission"


def test_tcp_rows(spark):
    def tcp(src, dst, seq, ack, flags, payload=b""):
        return struct.pack(">HHIIBBHHH", src, dst, seq, ack, 0x50, flags, 1000, 0, 0) + payload

    frames = [ETH + b"\x08\x00" + ip4(tcp(1, 2, 10, 0, 2), 6), ETH + b"\x08\x00" + ip4(tcp(1, 2, 11, 0, 24, b"abc"), 6), ETH + b"\x08\x00" + ip4(tcp(1, 2, 11, 0, 24, b"abc"), 6), ETH + b"\x08\x00" + ip4(tcp(1, 3, 5, 0, 2), 6)]
    df = spark.createDataFrame([(i, i * 10**8, f) for i, f in enumerate(frames)], "frame_id long, timestamp_ns long, data binary")
    rows = {r["packet_id"]: r for r in tcp_analysis(wire.dissect(df)).collect()}
    assert len(rows) == 4 and len({r["stream_key"] for r in rows.values()}) == 2
    assert rows[2]["analysis"] == "retransmission" and rows[1]["analysis"] == ""


def test_links_and_buses():
    assert ("sll.etype", 0x800) in names("sll", struct.pack(">HHH", 0, 1, 6) + bytes(range(8)) + b"\x08\x00") and ("sll.src.eth", 0x000102030405) in names("sll", struct.pack(">HHH", 0, 1, 6) + bytes(range(8)) + b"\x08\x00")
    assert ("sll2.if_index", 7) in names("sll2", struct.pack(">HHIHBB", 0x800, 0, 7, 1, 0, 6) + bytes(8))
    assert ("llc.type", 0x800) in names("llc", b"\xaa\xaa\x03\0\0\0\x08\x00") and ("llc.control", 0x0102) in names("llc", b"\x42\x42\x01\x02")
    pid = 0x10 | app.lin_parity(0x10) << 6
    frame = bytes([1, 0, 0, 0, 2 << 4 | 2, pid, app.lin_checksum(b"ab", pid), 0]) + b"ab"
    got = names("lin", frame)
    assert ("lin.parity.valid", True) in got and ("lin.checksum.status", "Good") in got and ("lin.checksum_type", "Enhanced") in got
    assert ("lin.checksum.status", "Bad") in names("lin", frame[:-1] + b"x") and names("lin", b"\1")[-1][0] == "packet.error"
    head = (1 << 35 | 5 << 24 | 1 << 17 | 9 << 6 | 3).to_bytes(5, "big")
    got = names("flexray", b"\x80\x00" + head + b"xy")
    assert {("flexray.channel", "B"), ("flexray.frame_id", 5), ("flexray.cycle", 3), ("flexray.data", b"xy"), ("flexray.stfi", True)} <= set(got)


def test_signal_messages(spark):
    from framelake.functions import signals

    text = '[{"id": 1, "name": "M", "signals": [{"name": "mode", "start": 0, "length": 8, "selector": true, "names": {"1": "on"}}, {"name": "a", "start": 8, "length": 8, "group": 1, "factor": 0.5, "offset": -1}, {"name": "b", "start": 15, "length": 8, "big_endian": true, "group": 2}]}]'
    df = spark.createDataFrame([(1, b"\x01\x08"), (1, b"\x02\x08"), (1, b"\x01"), (9, b"\x01\x08")], "id long, payload binary")
    rows = signals.decode(df, signals.load(text)).collect()
    assert rows[0]["signals"] == {"mode": 1.0, "a": 3.0} and rows[0]["shown"] == {"mode": "on"}
    assert rows[1]["signals"] == {"mode": 2.0, "b": 8.0} and rows[2]["signals"] == {"mode": 1.0} and rows[3]["signals"] is None and rows[3]["message"] is None
    with pytest.raises(ValueError, match="twice"):
        signals.Message(1, "x", (signals.Signal("a", 0, 1), signals.Signal("a", 1, 1)))
