"""Options, header chains, further application layers, message boundaries, and the command line."""

import ipaddress
import json
import struct

import pytest

from framelake import __main__ as cli
from framelake.dissect import app, options
from framelake.operators import boundaries, reassembly
from framelake.sinks import writers
from framelake.sources import captures, synthetic


def nodes(layer: str, data: bytes) -> list[tuple]:
    return [(n[4], next((v for v in n[5:] if v is not None), None)) for n in app.nodes_of(layer, data)]


ADDRESS = ipaddress.ip_address("2001:db8::1").packed
IP_HEAD = bytes([0x48]) + bytes(19)
TCP_HEAD = bytes(12) + b"\xa0" + bytes(7)


def test_ip_options():
    route = bytes([7, 7, 8, 10, 0, 0, 1])
    got = nodes("ip_options", IP_HEAD + route + bytes([148, 4, 0, 5, 0]))
    assert ("ip.opt.addr", "10.0.0.1") in got and ("ip.opt.ra", 5) in got and got[-1][0] == "ip.opt.type.number"
    stamps = nodes("ip_options", IP_HEAD + bytes([68, 12, 13, 0x21, 10, 0, 0, 2]) + struct.pack(">I", 99))
    assert ("ip.opt.overflow", 2) in stamps and ("ip.opt.time_stamp_addr", "10.0.0.2") in stamps and ("ip.opt.time_stamp", 99) in stamps
    assert nodes("ip_options", bytes([0x45]) + bytes(19)) == []
    assert nodes("ip_options", IP_HEAD + bytes([7, 1]) + bytes(10))[-1][0] == "packet.error"


def test_tcp_options():
    got = nodes("tcp_options", TCP_HEAD + struct.pack(">BBHBBBBBBIIB", 2, 4, 1460, 1, 3, 3, 7, 8, 10, 11, 12, 0) + b"\0")
    want = {"tcp.options.mss_val": 1460, "tcp.options.wscale.shift": 7, "tcp.options.wscale.multiplier": 128, "tcp.options.timestamp.tsval": 11, "tcp.options.timestamp.tsecr": 12}
    assert want.items() <= dict(got).items() and [n for n, _ in got].count("tcp.options.nop") == 1
    sack = nodes("tcp_options", TCP_HEAD + struct.pack(">BBIIIIBB", 5, 18, 1, 2, 3, 4, 1, 1))
    assert [v for n, v in sack if n.startswith("tcp.options.sack_")] == [1, 2, 3, 4]
    assert nodes("tcp_options", TCP_HEAD + bytes([34, 2, 99, 3, 7]) + bytes(15))[2] == ("tcp.options.tfo.request", True)
    assert nodes("tcp_options", bytes(5))[-1][0] == "packet.error"


def test_ipv6_chain():
    hop = bytes([43, 0, 5, 2, 0, 1, 1, 0])
    route = bytes([44, 2, 4, 0, 0, 0]) + b"\0\0" + ADDRESS
    part = bytes([17, 0]) + struct.pack(">HI", 16 | 1, 77)
    data = bytes(6) + b"\0" + bytes(33) + hop + route + part + b"rest"
    got = nodes("ipv6_chain", data)
    assert ("ipv6.opt.router_alert", 1) in got and ("ipv6.routing.srh.addr", "2001:db8::1") in got and ("ipv6.fraghdr.offset", 16) in got and ("ipv6.fraghdr.more", True) in got and ("ipv6.fraghdr.ident", 77) in got
    assert nodes("ipv6_chain", data[:45])[-1][0] == "packet.error"


def test_icmpv6():
    link = bytes([1, 1, 2, 0, 0, 0, 0, 9])
    prefix = bytes([3, 4, 64, 0xC0]) + struct.pack(">III", 100, 50, 0) + ADDRESS
    got = nodes("icmpv6", bytes([134, 0, 0, 0, 64, 0x88]) + struct.pack(">HII", 1800, 1, 2) + link + prefix)
    assert {("icmpv6.nd.ra.flag.m", True), ("icmpv6.nd.ra.flag.prf", 1), ("icmpv6.nd.ra.router_lifetime", 1800), ("icmpv6.opt.linkaddr", link[2:]), ("icmpv6.opt.prefix", "2001:db8::1"), ("icmpv6.opt.prefix.flag.a", True), ("icmpv6.opt.prefix.flag.r", False)} <= set(got)
    report = nodes("icmpv6", bytes([143, 0, 0, 0, 0, 0, 0, 1, 4, 0, 0, 1]) + ADDRESS * 2)
    assert ("icmpv6.mldr.mar.multicast_address", "2001:db8::1") in report and ("icmpv6.mldr.mar.source_address", "2001:db8::1") in report
    assert ("icmpv6.nd.na.flag.s", True) in nodes("icmpv6", bytes([136, 0, 0, 0, 0x40, 0, 0, 0]) + ADDRESS)
    assert nodes("icmpv6", bytes([135, 0, 0, 0, 0, 0, 0, 0]) + ADDRESS + b"\1\0")[-1][0] == "packet.error"


def test_dtls_tls_http2():
    hand = struct.pack(">BBHHBHBH", 1, 0, 20, 3, 0, 0, 0, 8) + bytes(8)
    got = dict(nodes("dtls", struct.pack(">BHHHIH", 22, 0xFEFD, 0, 0, 5, len(hand)) + hand))
    assert got["dtls.record.sequence_number"] == 5 and got["dtls.handshake.message_seq"] == 3 and got["dtls.handshake.is_fragment"] is True
    chain = b"\0\0\3abc"
    cert = b"\x0b\0\0\x09" + struct.pack(">I", len(chain))[1:] + chain
    assert ("tls.handshake.certificate.data", b"abc") in nodes("tls", struct.pack(">BHH", 22, 0x303, len(cert)) + cert)
    ext = struct.pack(">HHHHH", 10, 4, 2, 29, 43) + struct.pack(">HBH", 3, 2, 0x304) + struct.pack(">HHHHH", 51, 8, 6, 29, 2) + b"kk"
    hello = struct.pack(">H", 0x303) + bytes(32) + b"\0" + b"\0\2\x13\1" + b"\1\0" + struct.pack(">H", len(ext)) + ext
    got = nodes("tls", struct.pack(">BHH", 22, 0x301, len(hello) + 4) + b"\1" + struct.pack(">I", len(hello))[1:] + hello)
    assert {("tls.handshake.extensions.supported_group", 29), ("tls.handshake.extensions.supported_version", 0x304), ("tls.handshake.extensions.key_share.key_exchange", b"kk")} <= set(got) and got[-1][0] != "packet.error"
    away = nodes("http2", b"\0\0\x0a\7\0" + bytes(4) + struct.pack(">II", 5, 2) + b"hi" + b"\0\0\0\1\5\0\0\0\1")
    assert ("http2.goaway.debug_data", b"hi") in away and ("http2.frame.flags.end_headers", True) in away and ("http2.frame.flags.end_stream", True) in away


def test_layers_of_frames(spark):
    tcp = struct.pack(">HHIIBBHHH", 1, 2, 0, 0, 0x60, 2, 0, 0, 0) + struct.pack(">BBH", 2, 4, 536)
    ip = struct.pack(">BBHHHBBHII", 0x46, 0, 24 + len(tcp), 0, 0, 64, 6, 0, 1, 2) + bytes([148, 4, 0, 0])
    icmp = bytes([135, 0, 0, 0, 0, 0, 0, 0]) + ADDRESS
    v6 = struct.pack(">IHBB", 6 << 28, len(icmp), 58, 255) + ADDRESS * 2
    rows = [(1, 0, bytes(12) + b"\x08\0" + ip + tcp + b"pad"), (2, 0, bytes(12) + b"\x86\xdd" + v6 + icmp + b"pad"), (3, 0, b""), (4, 0, None), (5, 0, bytes(12) + b"\x08\0" + b"\x45" + ip[1:20])]
    got = {(r["packet_id"], r["name"]) for r in options.layers(spark.createDataFrame(rows, "frame_id long, timestamp_ns long, data binary")).collect()}
    assert {(1, "ip.opt.ra"), (1, "tcp.options.mss_val"), (2, "icmpv6.nd.ns.target_address")} <= got
    assert {p for p, _ in got} == {1, 2} and not {n for _, n in got} & {"packet.error", "icmpv6.data"}


def test_boundaries(spark):
    plain, chunked = b"GET / HTTP/1.1\r\nContent-Length: 3\r\n\r\nabc", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\nX: y\r\n\r\n"
    short = b"HTTP/1.1 304 Not Modified\r\nContent-Length: 9\r\n\r\n"
    stream = plain + chunked + short + b"noise" + plain
    for width in (1, 7, len(stream)):
        rows = [("a", i, stream[i : i + width]) for i in range(0, len(stream), width)]
        df = spark.createDataFrame(rows, "conn string, seq int, payload binary")
        assert [bytes(r["data"]) for r in reassembly.messages(df, "conn", boundaries.http1).orderBy("n").collect()] == [plain, chunked, short, plain]
    record = b"\x17\3\3\0\2ab"
    assert boundaries.tls_record(record + b"x") == 7 and boundaries.tls_record(record[:3]) is None and boundaries.tls_record(b"zz") == 0
    assert boundaries.http2_frame(boundaries.PREFACE) == 24 and boundaries.http2_frame(b"PRI") is None and boundaries.http2_frame(b"\0\0\1" + bytes(7)) == 10


def test_command_line(spark, tmp_path, capsys):
    frames = synthetic.frames(spark, 60, "mixed").orderBy("frame_id").collect()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcap").write_bytes(b"".join(writers.pcap_bytes((r["timestamp_ns"], bytes(r["data"])) for r in frames)))
    cli.main(["convert", str(tmp_path / "in"), str(tmp_path / "blf"), "--format", "blf", "--max-packets", "50"], spark)
    back = captures.read_captures(spark, str(tmp_path / "blf")).collect()
    assert sorted((r["timestamp_ns"], bytes(r["data"])) for r in back) == sorted((r["timestamp_ns"], bytes(r["data"])) for r in frames[:50])
    cli.main(["export", str(tmp_path / "in"), str(tmp_path / "json"), "--format", "json", "--filter", "udp", "--fields", "udp.dstport"], spark)
    rows = [json.loads(x) for f in (tmp_path / "json").glob("*.json") for x in f.read_text().splitlines()]
    assert rows and all("udp" in r["protocols"] and r["udp.dstport"] for r in rows)
    cli.main(["export", str(tmp_path / "in"), str(tmp_path / "set"), "--fields", "udp.dstport", "--occurrences", "first"], spark)
    assert spark.read.parquet(str(tmp_path / "set" / "packets")).count() == 60
    with pytest.raises(Exception, match="(?i)exist"):
        cli.main(["export", str(tmp_path / "in"), str(tmp_path / "set"), "--fields", "udp.dstport"], spark)
    cli.main(["export", str(tmp_path / "in"), str(tmp_path / "csv"), "--format", "csv", "--filter", "ip", "--fields", "ip.src"], spark)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["packet_id", "ip_src"]
    capsys.readouterr()
    cli.main(["fields", "udp."])
    cli.main(["layers", "--plugin", "framelake.dissect.hpack"])
    shown = capsys.readouterr().out
    assert "udp.dstport" in shown and "ipv6_chain" in shown
