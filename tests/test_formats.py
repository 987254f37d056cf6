"""Header compression, SOME/IP beyond its header, and the writers of CAN logs."""

import io
import struct

import pytest

from framelake.dissect import app, hpack, someip
from framelake.sinks import writers
from framelake.sources import captures

unhex = bytes.fromhex


def test_huffman_code_is_whole():
    assert len(hpack.CODES) == 257 and len(hpack.STATIC) == 61
    assert sum(1 << (30 - n) for n, _ in hpack.CODES) == 1 << 30


@pytest.mark.parametrize(
    ("coded", "text"),
    [("f1e3c2e5f23a6ba0ab90f4ff", b"www.example.com"), ("a8eb10649cbf", b"no-cache"), ("6402", b"302"), ("aec3771a4b", b"private"), ("d07abe941054d444a8200595040b8166e082a62d1bff", b"Mon, 21 Oct 2013 20:13:21 GMT"), ("", b"")],
)
def test_huffman(coded, text):
    assert hpack.unhuffman(unhex(coded)) == text


def test_dynamic_table_follows_the_standard():
    """The requests of RFC 7541, C.4."""
    d = hpack.Decoder()
    first = [(":method", "GET"), (":scheme", "http"), (":path", "/"), (":authority", "www.example.com")]
    assert d.decode(unhex("828684418cf1e3c2e5f23a6ba0ab90f4ff")) == first
    assert d.decode(unhex("828684be5886a8eb10649cbf")) == [*first, ("cache-control", "no-cache")]
    assert d.decode(unhex("828785bf408825a849e95ba97d7f8925a849e95bb8e8b4bf")) == [(":method", "GET"), (":scheme", "https"), (":path", "/index.html"), (":authority", "www.example.com"), ("custom-key", "custom-value")]
    assert d.size == 164
    assert d.decode(b"\x20") == [] and d.size == 0
    for bad in (b"\xff", b"\xbe", b"\x80", b"\x41\x05ab", b"\x3f\xff\xff\x7f"):
        with pytest.raises(app.Malformed):
            hpack.Decoder().decode(bad)


def test_headers_keep_a_table_for_each_connection(spark):
    block = unhex("828684418cf1e3c2e5f23a6ba0ab90f4ff")
    rows = [("a", 1, 1, 1, 4, block), ("b", 2, 1, 1, 4, block), ("a", 3, 3, 1, 0, b"\x82\x86"), ("a", 4, 3, 9, 4, b"\x84\xbe"), ("c", 5, 1, 1, 4, b"\xbe"), ("c", 6, 1, 1, 4, b"\x82"), ("b", 7, 3, 1, 4 | 8 | 32, b"\x02" + bytes(5) + b"\xbe" + bytes(2)), (None, 8, 1, 1, 4, block)]
    df = spark.createDataFrame(rows, "connection string, packet_id long, stream_id long, kind int, flags int, body binary")
    got = sorted((r["packet_id"], r["position"], r["name"], r["value"], r["error"]) for r in hpack.headers(df).collect())
    assert [g[:4] for g in got if g[0] == 4] == [(4, 0, ":method", "GET"), (4, 1, ":scheme", "http"), (4, 2, ":path", "/"), (4, 3, ":authority", "www.example.com")]
    assert [g[2:4] for g in got if g[0] == 7] == [(":authority", "www.example.com")]
    assert [g for g in got if g[0] in (5, 6)] == [(5, None, None, None, "no such entry")]
    assert not [g for g in got if g[0] in (3, 8)]
    assert hpack.headers(df.limit(0)).count() == 0


def sd_bytes() -> bytes:
    entry = struct.pack(">BBBBHHII", 1, 0, 0, 1 << 4, 0x1234, 1, 1 << 24 | 3, 7)
    stop = struct.pack(">BBBBHHII", 6, 0, 0, 0, 0x1234, 1, 1 << 24, 2 << 16 | 9)
    option = struct.pack(">HBB4sBBH", 9, 4, 0, bytes([10, 0, 0, 1]), 0, 17, 30509)
    return struct.pack(">BxxxI", 0xC0, 32) + entry + stop + struct.pack(">I", len(option)) + option


def test_service_discovery():
    whole = struct.pack(">HHIHHBBBB", 0xFFFF, 0x8100, 8 + len(sd_bytes()), 0, 1, 1, 1, 2, 0) + sd_bytes()
    nodes = [(n[4], next((v for v in n[5:] if v is not None), None)) for n in app.nodes_of("someip", whole)]
    assert [v for n, v in nodes if n == "someip_sd.entry.kind"] == ["offer", "stop_subscribe"]
    assert ("someip_sd.option.address", "10.0.0.1") in nodes and ("someip_sd.option.port", 30509) in nodes and ("someip_sd.entry.eventgroupid", 9) in nodes
    assert not [n for n, _ in nodes if n == "packet.error"]
    assert app.nodes_of("someip_sd", sd_bytes()[:-3])[-1][4] == "packet.error"


def test_segments():
    data = struct.pack(">HHIHHBBBB", 1, 2, 8 + 4 + 16, 0, 1, 1, 1, 0x22, 0) + struct.pack(">I", 32 | 1) + bytes(16)
    nodes = {n[4]: n for n in app.nodes_of("someip", data)}
    assert nodes["someip_tp.offset"][5] == 32 and nodes["someip_tp.more"][9] is True


def test_payload_by_configuration(spark):
    spec = {"type": "struct", "members": [{"name": "n", "type": "uint16"}, {"name": "s", "type": "string", "length_bytes": 4}, {"name": "l", "type": "array", "length_bytes": 2, "of": {"type": "sint8"}}, {"name": "e", "type": "enum", "base": "uint8", "names": {"1": "on"}}, {"name": "f", "type": "float32", "little": True}]}
    data = struct.pack(">HI", 513, 5) + b"\xef\xbb\xbfhi" + struct.pack(">H3bB", 3, -1, 2, 3, 1) + struct.pack("<f", 1.5) + b"zz"
    got = list(someip.payload(spec, data))
    assert [v for n, _, v in got if n == "value.l.item"] == [-1, 2, 3]
    assert {n: v for n, _, v in got if n in ("value.n", "value.s", "value.e.name", "value.f", "rest")} == {"value.n": 513, "value.s": "hi", "value.e.name": "on", "value.f": 1.5, "rest": b"zz"}
    df = spark.createDataFrame([(1, 2, data), (1, 2, data[:4]), (9, 9, data), (1, 2, None)], "serviceid int, methodid int, payload binary")
    values = [r["values"] for r in someip.decode(df, {(1, 2): spec}).collect()]
    assert [v["text"] for v in values[0] if v["name"] == "value.n"] == ["513"] and values[1][-1]["name"] == "packet.error" and values[2] is None and values[3] is None


def test_end_to_end_protection():
    assert someip.crc32_p4(b"123456789") == 0x1697D06A
    sent = someip.protect_p4(7, 5, b"body")
    assert [someip.check_p4(7, sent, last) for last in (None, 4, 5, 2)] == ["ok", "ok", "repeated", "lost"]
    assert someip.check_p4(8, sent) == "wrong_id" and someip.check_p4(7, sent[:-1] + b"?") == "wrong_crc" and someip.check_p4(7, b"") == "too_short"


CAN = [
    (10_000_000_123, struct.pack(">IB3x", 0x123, 2) + b"\x0a\xff", 1),
    (10_000_000_456, struct.pack(">IB3x", 0x9ABCDEF0, 8) + bytes(range(8)), 2),
    (10_000_000_789, struct.pack(">IB3x", 0x40000077, 0), 1),
    (11_000_000_000, captures.can_fd(0x7F, bytes(range(12)), True, False), 3),
    (11_000_000_001, captures.can_fd(0x80000007, bytes(64), False, True), 1),
    (11_000_000_002, captures.can_fd(0x8, b"", True, True), 1),
]


@pytest.mark.parametrize("kind", ["asc", "blf"])
def test_can_logs_round_trip(kind):
    data = b"".join(writers.WRITERS[kind](CAN))
    assert [(t, d, c) for t, _, c, d in captures.parse(io.BytesIO(data), tolerant=False)] == CAN
    assert list(captures.parse(io.BytesIO(b"".join(writers.WRITERS[kind]([]))), tolerant=False)) == []


def lines(text):
    return list(captures.parse(io.BytesIO(text.encode()), tolerant=False))


def test_other_buses_in_asc():
    head = "date Thu Jan 1 12:00:00 am 1970\nbase hex  timestamps absolute\n"
    lin = lines(head + "0.1 Li 3C Rx 4 01 02 03 04 checksum = F0 CSM = classic\n0.2 L2 11 2 AA BB checksum = 1\n0.3 L1 11 2 AA BB\n0.4 Li 40 Rx 1 00\n0.5 Li 5 Rx 9 00\n0.6 Li 7 RcvError 8 1\n")
    assert [(t, link, c) for t, link, c, _ in lin] == [(100_000_000, 212, 1), (200_000_000, 212, 2)]
    assert lin[0][3][4:8] == bytes([0x41, 0x3C, 0xF0, 0]) and lin[0][3][8:] == bytes([1, 2, 3, 4])
    assert lin[1][3][4:8] == bytes([0x20, 0x11, 1, 0]) and lin[1][3][8:] == b"\xaa\xbb"
    ray = lines(head + "1.0 Fr RMSG 0 0 1 1 10 5 Rx 0 0 0 0 123 x 4 2 AA BB\n1.1 Fr RMSG 0 0 2 3 10 5 Tx 0 0 0 0 123 x 2 2 AA BB\n1.2 Fr 1 V9 10 5 0 0 123 x 2 AA BB\n1.3 Fr RMSG 0 0 1 1 800 5 Rx 0 0 0 0 123 x 0 0\n1.4 Fr RMSG 0 0 1 4 10 5 Rx 0 0 0 0 123 x 0 0\n1.5 Fr RMSG 0 0 1 1 10 5 Rx 0 0 0 0 123 x 2 2 AA\n1.6 Fr STAT 1\n")
    assert [(t // 10**8, link, c) for t, link, c, _ in ray] == [(10, 210, 1), (11, 210, 2), (12, 210, 1)]
    assert [d for *_, d in ray] == [captures.flexray_frame(16, 5, 0x123, b"\xaa\xbb\0\0"), captures.flexray_frame(16, 5, 0x123, b"\xaa\xbb", True), captures.flexray_frame(16, 5, 0x123, b"\xaa\xbb")]
    eth = lines(head + "0.5 ETH 1 Rx e:001122334455667788990A0B0C0D\n0.6 ETH 2 TxFwd e:001122334455\n667788990A0B\n0C 0D\n0.65 AFDX 1 Rx 1 0 0 2:0102\n0.7 ETH 1 Rx 4:01zz0304\n0.8 ETH 1 STAT 0 0\n0.9 ETH 1 Rx e 00112233\n1.0 ETH 1 Rx e:0011\n1.1 1 7F Rx d 1 AA\n")
    packet = bytes.fromhex("001122334455667788990A0B0C0D")
    assert [(t // 10**7, link, c, d) for t, link, c, d in eth[:3]] == [(50, 1, 1, packet), (60, 1, 2, packet), (65, 1, 1, b"\x01\x02")]
    assert [(t, link) for t, link, _, _ in eth[3:]] == [(1_100_000_000, 227)]
    apart = lines("base dec  timestamps relative\n0.5 ETH 1 Rx 14:001122334455667788990A0B0C0D\n0.5 Li 17 Rx 1 255\n")
    assert [t for t, *_ in apart] == [500_000_000, 1_000_000_000] and apart[1][3][5] & 63 == 17 and apart[1][3][8:] == b"\xff"


@pytest.mark.parametrize(("link", "frames"), [(1, [(5, bytes(range(60)), 1), (10**10, bytes(1518), 3)]), (212, [(7, captures.lin_frame(0x3C, b"abc"), 1), (9, captures.lin_frame(1, b"", 0xAB, 0), 4), (11, captures.lin_frame(2, bytes(8), 3, 1), 2)])])
def test_other_buses_round_trip_through_asc(link, frames):
    data = b"".join(writers.asc_bytes(frames, link))
    assert [(t, d, c) for t, _, c, d in captures.parse(io.BytesIO(data), tolerant=False)] == frames
    for bad in (b"short", bytes(2000)) if link == 1 else (b"short",):
        with pytest.raises(ValueError):
            list(writers.asc_bytes([(1, bad)], link))


def test_many_containers():
    frames = [(i, struct.pack(">IB3x", i % 2048, 8) + i.to_bytes(8, "big"), 1) for i in range(500)]
    data = b"".join(writers.blf_bytes(frames, container=1000))
    assert [(t, d, c) for t, _, c, d in captures.parse(io.BytesIO(data), tolerant=False)] == frames


def test_ethernet_in_blf():
    plain, tagged = bytes(range(12)) + b"\x08\x00abc", bytes(range(12)) + b"\x81\x00\x00\x05\x08\x00abcd"
    data = b"".join(writers.blf_bytes([(1, plain), (2, tagged)], 1))
    assert [d for _, _, _, d in captures.parse(io.BytesIO(data), tolerant=False)] == [plain, tagged]
    for bad, link in ((b"short", 1), (b"short", 227), (plain, 9)):
        with pytest.raises(ValueError):
            list(writers.blf_bytes([(1, bad)], link))


def test_sink_writes_can_logs(spark, tmp_path):
    spark.dataSource.register(writers.CaptureSink)
    df = spark.createDataFrame(CAN, "timestamp_ns long, data binary, interface_id int").repartition(2)
    df.write.format("capture_file").option("format", "blf").option("link_type", "227").mode("append").save(str(tmp_path / "out"))
    back = captures.read_captures(spark, str(tmp_path / "out")).collect()
    assert sorted((r["timestamp_ns"], bytes(r["data"]), r["interface_id"]) for r in back) == CAN
