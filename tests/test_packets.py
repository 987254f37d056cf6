"""Whole packets: link types, layers above the headers, streams, meta fields, fragments, and names that are refused."""

import struct

import pytest

from framelake.catalog import FilterError
from framelake.dissect import app, fields, packet, wire
from framelake.functions import display
from framelake.plans import compiler
from framelake.types import FieldType as T

unhex = bytes.fromhex


def ip4(proto, body, ident=1, frag=0, src=b"\x0a\0\0\1", dst=b"\x0a\0\0\2"):
    head = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), ident, frag, 64, proto, 0, src, dst)
    return head + body


def udp(body, sport=4000, dport=5000):
    return struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body


def tcp(body=b"", sport=4000, dport=9000, seq=1, ack=0, flags=0x18, window=1000, options=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, seq, ack, (20 + len(options)) // 4 << 4, flags, window, 0, 0) + options + body


ETH = bytes(12) + b"\x08\0"


def frames_of(spark, rows, link=True):
    full = [(i, i * 1000, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "frame_id long, timestamp_ns long, link_type int, data binary") if link else spark.createDataFrame([(i, t, d) for i, t, _, d in full], "frame_id long, timestamp_ns long, data binary")


def test_link_types(spark):
    inner = ip4(17, udp(b"payload"))
    rows = [(1, ETH + inner), (113, bytes(14) + b"\x08\0" + inner), (276, b"\x08\0" + bytes(18) + inner), (227, unhex("0000012304000000") + b"abcd"), (212, unhex("01000000" + "20" + "00" + "00" + "00") + b"xy"), (210, unhex("0000" + "2000000000")), (1, bytes(12) + b"\0\x08" + unhex("aaaa030000000800")), (147, b"??")]
    got = {r["packet_id"]: r for r in packet.packets(frames_of(spark, rows), ["can.id", "lin.length", "llc.oui", "sll.etype", "flexray.channel"]).collect()}
    assert [got[i]["protocols"][2] for i in range(7)] == ["eth", "sll", "sll2", "can", "lin", "flexray", "eth"]
    assert [list(got[i]["udp.dstport"]) for i in range(4)] == [[5000]] * 3 + [[]]
    assert got[3]["can.id"] == [0x123] and got[4]["lin.length"] == [2] and got[5]["flexray.channel"] == ["A"] and got[6]["llc.oui"] == [b"\0\0\0"] and got[1]["sll.etype"] == [0x800]
    assert got[7]["protocols"] == ["packet", "frame"] and got[7]["frame.len"] == [2]


def test_heuristics_and_errors(spark):
    rows = [(1, ETH + ip4(6, tcp(b"GET /x HTTP/1.1\r\nHost: h\r\n\r\n"))), (1, ETH + ip4(6, tcp(unhex("1603010002") + b"ab"))), (1, ETH + ip4(6, tcp(b"hello"))), (1, ETH + ip4(17, udp(b"\0\1", dport=53))), (1, b"short")]
    got = {r["packet_id"]: r for r in packet.packets(frames_of(spark, rows, False), ["http.host", "packet.error", "packet.info"]).collect()}
    assert [got[i]["protocols"][-1] for i in range(4)] == ["http", "tls", "data", "dns"]
    assert got[0]["http.host"] == ["h"] and got[3]["packet.error"] == ["dns: too short"] and got[4]["packet.error"] == ["eth: too short"]
    assert got[0]["packet.info"][0].startswith("4000 -> 9000 [PUS, ACK]")


def test_every_field_can_be_named(spark):
    lay = packet.layout()
    rows = [(1, ETH + ip4(17, udp(b"\0" * 12, dport=53))), (227, unhex("0000012304000000") + b"abcd")]
    df = packet.packets(frames_of(spark, rows))
    assert set(lay.columns) <= set(df.columns)
    for protocol in ("dns", "tls", "someip_sd", "can", "tcp", "packet"):
        assert compiler.apply_filter(df, protocol, lay).count() in (0, 1, 2)


def test_declared_types_are_those_of_the_values():
    """What the dissectors yield is declared, with the type of its value."""
    kinds = fields.kinds()
    whole = {"dns": unhex("00018180000100020000000003777777076578616d706c6500000100 01".replace(" ", "")) + unhex("c00c00010001000000050004" + "01020304") + unhex("c00c000f0001000000050004" + "000ac00c"), "can": unhex("8000012304000000") + b"abcd", "json": b'{"a": [1, 2.5, null, true, "x"]}', "http": b"GET / HTTP/1.1\r\nHost: h\r\nContent-Length: 2\r\n\r\nab", "websocket": unhex("8105") + b"hello"}
    for name, data in whole.items():
        nodes = list(app.nodes_safely(name, data))
        assert "packet.error" not in [n for n, _, _ in nodes], nodes
        for label, depth, v in nodes:
            if depth > 1 or label in kinds:
                assert label in kinds, label
                want = {T.U64: int, T.F64: (int, float), T.STRING: str, T.BOOL: bool, T.BYTES: bytes, T.MAC: int, T.IPV4: int, T.IPV6: bytes, T.NONE: type(None)}[kinds[label]]
                assert isinstance(v, want), (label, v)


def test_scopes_need_the_layers_tree(spark):
    rows = [(1, ETH + ip4(6, tcp(b"GET /x HTTP/1.1\r\nA: 1\r\nB: 2\r\n\r\n")))]
    df = frames_of(spark, rows)
    assert packet.find(df, '$http.header { http.header.name == "A" && http.header.value == "1" }').count() == 1
    assert packet.find(df, '$http.header { http.header.name == "A" && http.header.value == "2" }').count() == 0
    assert packet.find(df, '$http.header[1] { http.header.name == "B" }').count() == 1
    with pytest.raises(FilterError):
        packet.find(df, "$ip { ip.ttl == 64 }")


def test_unknown_names(spark):
    df = frames_of(spark, [(1, ETH)])
    with pytest.raises(FilterError, match="did you mean dns.qry.name"):
        packet.find(df, 'dns.qry.nam contains "x"')


def test_fragments_become_packets(spark):
    whole = udp(b"0123456789abcdef")
    rows = [(1, ETH + ip4(17, whole[16:], 7, 2)), (1, ETH + ip4(17, whole[:8], 7, 0x2000)), (1, ETH + ip4(17, whole[8:16], 7, 0x2001)), (1, ETH + ip4(17, whole[:8], 8, 0x2000)), (1, ETH + ip4(17, udp(b"x"), 9))]
    six = lambda body, off, more: bytes(12) + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, 8 + len(body), 44, 64) + bytes(15) + b"\1" + bytes(15) + b"\2" + struct.pack(">BBHI", 17, 0, off | more, 5) + body
    rows += [(1, six(whole[:16], 0, 1)), (1, six(whole[16:], 16, 0))]
    got = {r["packet_id"]: r for r in packet.packets(frames_of(spark, rows, False), [], datagrams=True).collect()}
    assert [bytes(got[i]["udp.payload"][0]) if got[i]["udp.payload"] else None for i in range(7)] == [None, None, b"0123456789abcdef", None, b"x", None, b"0123456789abcdef"]
    assert got[2]["ip.frag_offset"] == [8] and "data" in got[2]["protocols"]
    assert not packet.packets(frames_of(spark, rows, False), []).filter("size(`udp.payload`) > 0 and packet_id <> 4").count()


def test_post_parsers(spark):
    from pyspark.sql import functions as F

    packet.register_post_parser("mine", {"mine.size": T.U64}, lambda df: df.withColumn("mine.size", F.transform("`frame.len`", lambda x: x * 2)))
    try:
        rows = [(1, ETH + ip4(17, udp(b"x"))), (1, ETH + ip4(17, udp(b"xyz")))]
        assert [r["packet_id"] for r in packet.find(frames_of(spark, rows), "mine.size > 88").collect()] == [1]
    finally:
        packet.POST_PARSERS.clear()


def test_display_tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(6,), (250,)], "v long").select(display.labelled(F.col("v"), "ip.proto").alias("t"), display.shown(F.col("v"), "no.such").alias("n"))
    assert [tuple(r) for r in df.collect()] == [("6 (TCP)", None), ("250", None)]


def test_completions_know_their_place():
    lay = packet.layout()
    assert "contains" in compiler.completions("dns.qry.name ", 13, lay.catalog) and "contains" not in compiler.completions("ip.ttl ", 7, lay.catalog)
    assert compiler.completions("tcp ", 4, lay.catalog) == compiler.JOIN
    assert "not" in compiler.completions("", 0, lay.catalog) and compiler.completions("ip.tt", 5, lay.catalog) == ["ip.ttl"]


def test_observers_and_other_layouts():
    lay = packet.layout()
    with pytest.raises(FilterError):
        compiler.compile_observer("$http { http.request }", lay)
    with pytest.raises(FilterError):
        compiler.compile_observer("flank(ip.ttl, changed, within: 2packets) && flank(ip.id, changed, within: 2packets)", lay)
    f = compiler.compile_observer("ip.ttl == 3", lay)
    assert f.rederive(wire.layout()).text == f.text
    with pytest.raises(FilterError):
        compiler.compile_filter("can.id == 3", lay).rederive(wire.layout())


def test_deep_headers(spark):
    tags = b"".join(unhex("8100") + struct.pack(">H", i) for i in range(9))
    rows = [(1, bytes(12) + tags + b"\x08\0" + ip4(17, udp(b"x"))), (1, bytes(12) + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, 8 * 9 + 9, 0, 64) + bytes(32) + b"".join(bytes([60 if i < 8 else 17, 0]) + bytes(6) for i in range(9)) + udp(b"y"))]
    got = {r["packet_id"]: r for r in wire.dissect(frames_of(spark, rows, False)).collect()}
    assert got[0]["vlan.id"] == list(range(9)) and got[0]["protocols"].count("vlan") == 9 and got[0]["udp.payload"] == [b"x"]
    assert got[1]["udp.payload"] == [b"y"]


def test_can_xl_and_compressed_messages():
    xl = struct.pack(">IBBH", 0x00050123, 0x81, 3, 0)[:6] + struct.pack("<HI", 4, 9) + b"abcd"
    nodes = {n: v for n, _, v in app.nodes_safely("can", xl)}
    assert (nodes["can.xl.priority"], nodes["can.xl.vcid"], nodes["can.xl.sdt"], nodes["can.len"], nodes["can.xl.af"], nodes["can.data"]) == (0x123, 5, 3, 4, 9, b"abcd") and nodes["can.flags.sec"] is True
    import zlib

    c = zlib.compressobj(wbits=-15)
    body = (c.compress(b"hello hello hello") + c.flush(zlib.Z_SYNC_FLUSH))[:-4]
    nodes = {n: v for n, _, v in app.nodes_safely("websocket", bytes([0xC1, len(body)]) + body)}
    assert nodes["websocket.payload.decoded"] == b"hello hello hello"
