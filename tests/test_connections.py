"""Connections: classes of segments, phases, window scales, and the bytes of a direction in order."""

import random

from framelake.dissect import wire
from framelake.operators import boundaries, reassembly, tcp
from tests.test_packets import ETH, frames_of, ip4
from tests.test_packets import tcp as segment

SYN, ACK, FIN, RST, PSH = 2, 16, 1, 4, 8


def seg(t, side, seq, ack, n=0, flags=ACK, window=1000, options=None):
    return t, side, seq, ack, n, flags, window, options


def run(rows):
    return [dict(zip(("id", "what", "rtt", "flight", "dup", "first", "phase", "parts", "rto", "window", "delta"), r, strict=True)) for r in tcp.analyse((i, *r) for i, r in enumerate(rows))]


WSCALE = b"\x01\x03\x03\x02"
SHAKE = [seg(0, 0, 100, 0, 0, SYN, options=WSCALE), seg(10, 1, 500, 101, 0, SYN | ACK, options=WSCALE), seg(20, 0, 101, 501)]


def test_window_full_and_scale():
    got = run([*SHAKE, seg(30, 1, 501, 101, 0, ACK, 25), seg(40, 0, 101, 501, 100, ACK)])
    assert got[4]["what"] == "window_full" and got[3]["window"] == 100
    assert run([*SHAKE, seg(30, 1, 501, 101, 0, ACK, 25), seg(40, 0, 101, 501, 99, ACK)])[4]["what"] == ""
    plain = [seg(0, 0, 100, 0, 0, SYN), seg(10, 1, 500, 101, 0, SYN | ACK, options=WSCALE), seg(20, 0, 101, 501), seg(30, 1, 501, 101, 0, ACK, 25), seg(40, 0, 101, 501, 25, ACK)]
    assert run(plain)[4]["what"] == "window_full" and run(plain)[3]["window"] == 25  # both have to agree to a scale


def test_keep_alives_and_probes():
    got = run([*SHAKE, seg(30, 0, 101, 501, 10, ACK), seg(35, 1, 501, 111), seg(40, 0, 110, 501, 0, ACK), seg(50, 1, 501, 111)])
    assert [g["what"] for g in got[5:]] == ["keep_alive", "keep_alive_ack"]
    got = run([*SHAKE, seg(30, 1, 501, 101, 0, ACK, 0), seg(40, 0, 101, 501, 1, ACK), seg(50, 1, 501, 101, 0, ACK, 0)])
    assert [g["what"] for g in got[3:]] == ["zero_window", "zero_window_probe", "zero_window,zero_window_probe_ack"]


def test_retransmissions():
    data = [*SHAKE, seg(1_000_000_000, 0, 101, 501, 10, ACK | PSH)]
    late = run([*data, seg(3_000_000_000, 0, 101, 501, 10, ACK | PSH)])[-1]
    assert late["what"] == "retransmission" and late["rto"] == 2_000_000_000
    spurious = run([*data, seg(1_000_000_010, 1, 501, 111), seg(1_500_000_000, 0, 101, 501, 10, ACK)])[-1]
    assert spurious["what"] == "spurious_retransmission"
    dups = [seg(1_100_000_000 + i, 1, 501, 101) for i in range(3)]
    fast = run([*data, seg(1_000_000_001, 0, 111, 501, 10), *dups, seg(1_100_000_005, 0, 101, 501, 10)])
    assert sum(g["what"] == "duplicate_ack" for g in fast) >= 2
    assert fast[-1]["what"] == "fast_retransmission"


def test_phases():
    close = [seg(30, 0, 101, 501, 0, FIN | ACK), seg(40, 1, 501, 102), seg(50, 1, 501, 102, 0, FIN | ACK), seg(60, 0, 102, 502)]
    assert [g["phase"] for g in run([*SHAKE, *close])] == ["SYN_SENT", "SYN_RECEIVED", "ESTABLISHED", "FIN_WAIT_1", "FIN_WAIT_2", "LAST_ACK", "TIME_WAIT"]
    both = [seg(30, 0, 101, 501, 0, FIN | ACK), seg(40, 1, 501, 101, 0, FIN | ACK), seg(50, 0, 102, 502)]
    assert [g["phase"] for g in run([*SHAKE, *both])][3:] == ["FIN_WAIT_1", "CLOSING", "CLOSING"]
    assert [g["phase"] for g in run([seg(0, 0, 5, 6, 3), seg(1, 1, 6, 8, 0, RST)])] == ["ESTABLISHED (handshake not captured)", "RESET"]
    again = run([*SHAKE, *close, seg(70, 0, 9000, 0, 0, SYN), seg(80, 0, 9000, 0, 0, SYN)])
    assert again[7]["what"] == "reused_ports" and [g["first"] for g in again[6:]] == [0, 7, 7] and again[7]["phase"] == "SYN_SENT"
    assert [g["parts"] for g in run([*SHAKE, seg(25, 0, 101, 501, 5)])] == [1, 3, 7, 15]


def order(pieces):
    return b"".join(d for _, d, _ in pieces)


def test_bytes_in_order_from_any_order():
    """Cut, repeated, overlapping and mixed up segments give the bytes that were sent, across the end of the sequence numbers."""
    rng = random.Random(7)
    for _ in range(60):
        text = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 400)))
        start = rng.choice([0, 5, (1 << 32) - 100, (1 << 32) - 1])
        parts = []
        at = 0
        while at < len(text):
            n = rng.randint(1, 40)
            parts.append((at, text[at : at + n]))
            at += n
        parts += [(a, text[a : a + rng.randint(1, 60)]) for a in (rng.randrange(len(text)) for _ in range(5))]
        first, rest = parts[0], parts[1:]
        rng.shuffle(rest)
        flow, out = tcp.Flow(1 << 20), []
        for at, data in [first, *rest]:
            out += flow.add((start + at) % (1 << 32), False, data)
        out += flow.flush()
        assert order(out) == text and not any(m for _, _, m in out)
        assert [o for o, _, _ in out] == [sum(len(d) for _, d, _ in out[:i]) for i in range(len(out))]


def test_gaps():
    flow = tcp.Flow(10)
    assert flow.add(99, True, b"") == [] and flow.add(100, False, b"abc") == [(0, b"abc", 0)]
    assert flow.add(105, False, b"fghij") == [] and flow.add(115, False, b"z") == []
    assert flow.add(110, False, b"klmno") == [(5, b"fghij", 2), (10, b"klmno", 0), (15, b"z", 0)]  # too much waits
    assert flow.add(103, False, b"de") == [] and flow.add(120, False, b"q") == []
    assert flow.flush() == [(20, b"q", 4)]


def test_streams_of_packets(spark):
    rows = [(1, ETH + ip4(6, segment(b"", seq=9, flags=2))), (1, ETH + ip4(6, segment(b"abc", seq=10))), (1, ETH + ip4(6, segment(b"ghi", seq=16))), (1, ETH + ip4(6, segment(b"abcdef", seq=10))), (1, ETH + ip4(6, segment(b"x", 9000, 4000, seq=70), src=b"\x0a\0\0\2", dst=b"\x0a\0\0\1"))]
    got = sorted((r["side"], r["n"], r["packet_id"], r["offset"], bytes(r["data"]), r["missing"]) for r in tcp.stream_bytes(wire.dissect(frames_of(spark, rows, False))).collect())
    assert sorted(g[2:] for g in got) == [(1, 0, b"abc", 0), (3, 3, b"def", 0), (3, 6, b"ghi", 0), (4, 0, b"x", 0)]
    assert len({g[0] for g in got}) == 2


def test_messages_pass_over_what_is_lost(spark):
    parts = [b"\0\2ab\0\3", b"xyz", b"yy\0\1c", b"\0\1d"]
    rows = [("k", i, p, 5 if i == 2 else 0) for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "k string, seq long, payload binary, missing long")
    resync = lambda b: next((i for i in range(1, len(b)) if b[i : i + 2] == b"\0\1"), len(b))
    size = reassembly.length_prefix(0, 2, 2)
    boundary = lambda b: 0 if b[:1] != b"\0" else size(b)
    got = [bytes(r["data"]) for r in reassembly.messages(df, "k", boundary, missing="missing", resync=resync).orderBy("n").collect()]
    assert got == [b"\0\2ab", b"\0\3xyz", b"\0\1c", b"\0\1d"]


def test_repeated_ordinals(spark):
    df = spark.createDataFrame([(1, 0, b"a"), (1, 0, b"a"), (1, 1, b"b")], "conn_id long, seq long, payload binary")
    (r,) = reassembly.concat_stream(df).collect()
    assert (bytes(r["data"]), r["segments"], r["state"]) == (b"ab", 2, "complete")
    assert boundaries.http1
