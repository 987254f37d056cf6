"""What TCP segments say about their connection, by one ordered pass over each.

A task holds the state of one connection at a time: rows are dealt by connection and sorted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What comes this soon after duplicate acknowledgments is a fast retransmission, and, where no round trip is known, what comes this soon is out of order.
FAST_NS, REORDER_NS = 20_000_000, 3_000_000
SPACE = 1 << 32
#: The parts of a conversation, as bits.
SYN, SYN_ACK, ACK, DATA, FIN, RST = 1, 2, 4, 8, 16, 32
NO_SCALE = -1


def ahead(a: int, b: int) -> int:
    """a - b on the circle of sequence numbers."""
    return (a - b + (SPACE >> 1)) % SPACE - (SPACE >> 1)


@dataclass
class Side:
    next: int | None = None
    last_ack: int | None = None
    window: int | None = None
    scale: int | None = None  # None: its SYN wasn't seen
    acks: int = 0
    dup_acks: int = 0
    last_time: int = 0
    max_time: int = 0
    isn: int | None = None
    fin_end: int | None = None
    fin_acked: bool = False
    said: tuple[str, ...] = ()  # of its last segment
    sent: list[tuple[int, int]] = field(default_factory=list)  # (end, time) not acknowledged yet


@dataclass
class Connection:
    sides: tuple[Side, Side] = field(default_factory=lambda: (Side(), Side()))
    first_id: int = 0
    syn_time: int | None = None
    first_rtt: int | None = None
    parts: int = 0
    shaken: bool = False
    reset: bool = False
    closers: list[Side] = field(default_factory=list)
    last_time: int | None = None

    def phase(self) -> str:
        """The state of the side that closed first."""
        if self.reset:
            return "RESET"
        if not self.closers:
            if not self.parts & (SYN | SYN_ACK):
                return "ESTABLISHED (handshake not captured)"
            return "ESTABLISHED" if self.shaken else "SYN_RECEIVED" if self.parts & SYN_ACK else "SYN_SENT"
        first = self.closers[0]
        if len(self.closers) == 1:
            return "FIN_WAIT_2" if first.fin_acked else "FIN_WAIT_1"
        if not first.fin_acked:
            return "CLOSING"
        return "TIME_WAIT" if self.closers[1].fin_acked else "LAST_ACK"


def window_scale(options: bytes | None) -> int | None:
    """The shift that a SYN's options ask for."""
    at, data = 0, options or b""
    while at < len(data) and data[at]:
        if data[at] == 1:
            at += 1
            continue
        size = data[at + 1] if at + 1 < len(data) else 0
        if size < 2:
            return None
        if data[at] == 3 and size == 3 and at + 2 < len(data):
            return min(14, data[at + 2])
        at += size
    return None


def analyse(rows: Iterable[tuple]) -> Iterator[tuple]:
    """rows: (id, time, side, seq, ack, length, flags, window, options of a SYN or nothing) of one pair of endpoints, in order.

    Yields (id, what, round trip ns, bytes in flight, duplicate acks, first id of the connection, phase, completeness, retransmission timeout ns, scaled window, ns since
    the connection's packet before). A SYN with another number starts a new connection.
    """
    c: Connection | None = None
    for pid, t, which, seq, ack, n, flags, window, *options in rows:
        fin, syn, rst, has_ack = flags & 1, flags >> 1 & 1, flags >> 2 & 1, flags >> 4 & 1
        what, rtt, rto = [], None, None
        if c is None:
            c = Connection(first_id=pid)
        elif syn and not has_ack and c.sides[which].next is not None and c.sides[which].isn != seq:
            c = Connection(first_id=pid)
            what.append("reused_ports")
        own, peer = c.sides[which], c.sides[1 - which]
        plain, size = not (syn or fin or rst), n + syn + fin
        delta = None if c.last_time is None else t - c.last_time
        c.last_time = t
        if syn:
            own.isn = seq
            shift = window_scale(options[0] if options else None)
            own.scale = NO_SCALE if shift is None else shift
            if has_ack and NO_SCALE in (own.scale, peer.scale):  # both have to agree
                own.scale = NO_SCALE
                peer.scale = NO_SCALE if peer.scale is not None else None
            if not has_ack:
                c.syn_time = t
            elif c.syn_time is not None:
                c.first_rtt = t - c.syn_time
        again = has_ack and own.last_ack == ack and n == 0 and plain and own.next == seq
        decided = False
        if own.next is not None and not rst:
            gap = ahead(seq, own.next)
            if plain and n == 1 and gap == 0 and peer.window == 0:
                what.append("zero_window_probe")
                decided = True
            elif n <= 1 and gap == -1 and plain:
                what.append("keep_alive")
            elif gap > 0:
                what.append("lost_segment")
            elif gap < 0 and size:
                if peer.last_ack is not None and ahead(seq + size, peer.last_ack) <= 0:
                    what.append("spurious_retransmission")
                elif peer.dup_acks >= 2 and peer.last_ack == seq and t - peer.last_time <= FAST_NS:
                    what.append("fast_retransmission")
                elif t - own.max_time <= (c.first_rtt or REORDER_NS) and ahead(seq + size, own.next) < 0:
                    what.append("out_of_order")
                else:
                    what.append("retransmission")
                if what[-1] != "out_of_order":
                    earlier = [time for end, time in own.sent if ahead(end, seq) > 0]
                    rto = t - earlier[0] if earlier else None
        if window == 0 and plain and not decided:
            what.append("zero_window")
        if n and plain and peer.window is not None and peer.last_ack is not None and peer.scale is not None and not decided:
            shift = peer.scale if peer.scale > 0 and peer.acks > 1 else 0
            if ahead(seq + n, peer.last_ack + (peer.window << shift)) == 0:
                what.append("window_full")
        if plain and has_ack and n == 0 and own.next == seq and own.window == window and own.last_ack is not None and not decided:
            if window and ack == own.last_ack and "keep_alive" in peer.said:
                what.append("keep_alive_ack")
                decided = True
            elif window == 0 and "zero_window_probe" in peer.said and ahead(ack, own.last_ack) in (0, 1):
                what.append("zero_window_probe_ack")
                if ack != own.last_ack:  # the byte of the probe was taken
                    peer.next = ack
                decided = True
        if has_ack and not rst:
            if again and not decided:
                if own.window == window:
                    if window and peer.next is not None and ahead(peer.next, ack) > 0:
                        own.dup_acks += 1
                        what.append("duplicate_ack")
                elif window:
                    what.append("window_update")
            elif own.last_ack is None or ahead(ack, own.last_ack) > 0:
                own.dup_acks = 0
            done = [x for x in peer.sent if ahead(ack, x[0]) >= 0]
            if done:
                rtt = t - done[-1][1]
                peer.sent = [x for x in peer.sent if ahead(ack, x[0]) < 0]
            own.last_ack, own.window, own.acks = ack, window, own.acks + 1
        if size and "zero_window_probe" not in what:
            end = (seq + size) % SPACE
            if own.next is None or ahead(end, own.next) > 0:
                own.next = end
                own.sent.append((end, t))
                own.max_time = t
        elif own.next is None:
            own.next = seq
        own.last_time, own.said = t, tuple(what)
        _close(c, own, peer, seq, ack, n, fin, syn, rst, has_ack)
        flight = ahead(own.next, peer.last_ack) if peer.last_ack is not None and own.next is not None else 0
        scaled = window << own.scale if own.scale is not None and own.scale > 0 and not syn else window
        yield pid, ",".join(what), rtt, max(0, flight), own.dup_acks, c.first_id, c.phase(), c.parts, rto, scaled, delta


def _close(c: Connection, own: Side, peer: Side, seq: int, ack: int, n: int, fin: int, syn: int, rst: int, has_ack: int) -> None:
    """Notes which parts of a conversation were seen, and who closed it."""
    completes = (own.isn is None or seq == (own.isn + 1) % SPACE) and (peer.isn is None or ack == (peer.isn + 1) % SPACE)
    c.parts |= (0 if not syn else SYN_ACK if has_ack else SYN) | (FIN if fin else 0) | (RST if rst else 0)
    c.parts |= ACK if has_ack and n == 0 and not (syn or fin or rst) and completes else 0
    c.parts |= DATA if n and not rst and not (syn and has_ack) else 0
    c.reset = c.reset or bool(rst)
    if fin and own.fin_end is None:
        own.fin_end = (seq + n + 1) % SPACE
        c.closers.append(own)
    if has_ack and peer.fin_end is not None and ahead(ack, peer.fin_end) >= 0:
        peer.fin_acked = True
    if has_ack and not syn and c.parts & (SYN | SYN_ACK):
        c.shaken = True


OUT = "packet_id bigint, stream_key string, analysis string, rtt_ns bigint, bytes_in_flight bigint, dup_acks bigint, first_id bigint, phase string, completeness bigint, rto_ns bigint, window bigint, delta_ns bigint"


def _innermost(name: str) -> Column:
    return F.try_element_at(F.col(f"`{name}`"), F.lit(-1))


def _endpoints(packets: DataFrame, proto: str) -> tuple[Column, Column]:
    address = lambda end: F.coalesce(F.hex(_innermost(f"ip.{end}")), F.hex(_innermost(f"ipv6.{end}")), F.lit(""))
    return tuple(F.struct(address(end).alias("a"), _innermost(f"{proto}.{end}port").alias("p")) for end in ("src", "dst"))


def segments(packets: DataFrame) -> DataFrame:
    """(key, packet_id, timestamp_ns, side, seq, ack, n, flags, window, options, data) of the TCP packets of dissected frames."""
    one = _innermost
    src, dst = _endpoints(packets, "tcp")
    flags = sum((F.when(one(f"tcp.flags.{n}"), 1 << i).otherwise(0) for i, n in enumerate(("fin", "syn", "reset", "push", "ack"))), F.lit(0))
    options = one("tcp.options") if "tcp.options" in packets.columns else F.lit(None).cast("binary")
    rows = packets.filter(F.size("`tcp.seq`") > 0).select("packet_id", "timestamp_ns", src.alias("s"), dst.alias("d"), one("tcp.seq").alias("seq"), one("tcp.ack").alias("ack"), F.coalesce(F.octet_length(one("tcp.payload")), F.lit(0)).alias("n"), flags.alias("flags"), one("tcp.window_size_value").alias("window"), F.when(one("tcp.flags.syn"), options).alias("options"), one("tcp.payload").alias("data"))
    end = lambda c: F.concat_ws(":", c["a"], c["p"].cast("string"))
    low = F.col("s") <= F.col("d")
    return rows.select(F.when(low, F.concat_ws("-", end(F.col("s")), end(F.col("d")))).otherwise(F.concat_ws("-", end(F.col("d")), end(F.col("s")))).alias("key"), "packet_id", "timestamp_ns", F.when(low, 0).otherwise(1).alias("side"), "seq", "ack", "n", "flags", "window", "options", "data")


def by_key(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(key, its rows without the key) of sorted batches; rows that weren't taken are passed over."""
    source = (row for pdf in batches for row in pdf.itertuples(index=False, name=None))
    row = next(source, None)
    while row is not None:
        key = row[0]

        def of_key() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == key:  # noqa: B023
                yield row[1:]
                row = next(source, None)

        rest = of_key()
        yield key, rest
        for _ in rest:
            pass


def tcp_analysis(packets: DataFrame) -> DataFrame:
    """(packet_id, stream_key, analysis, rtt_ns, bytes_in_flight, dup_acks, ..: see OUT) of the TCP packets of dissected frames."""
    keyed = segments(packets).drop("data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for key, rows in by_key(batches):
            for pid, what, *rest in analyse(rows):
                out.append((pid, key, what, *rest))
                if len(out) >= 10_000:
                    yield _frame(out)
                    out = []
        yield _frame(out)

    return keyed.repartition("key").sortWithinPartitions("key", "packet_id").mapInPandas(run, OUT)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
    return out.astype({c: "Int64" for c in ("rtt_ns", "rto_ns", "delta_ns")})


def add_streams(packets: DataFrame, wanted: set[str]) -> DataFrame:
    """packets with the wanted fields of streams and analysis, as arrays that are empty where they don't apply."""
    out = packets
    if "udp.stream" in wanted:
        from framelake.operators.reassembly import stream_index

        src, dst = _endpoints(packets, "udp")
        ends = packets.filter(F.size("`udp.srcport`") > 0).select("packet_id", src.alias("s"), dst.alias("d"))
        numbers = stream_index(ends, ["s"], ["d"]).select(F.col("packet_id").alias("__u"), F.array(F.col("stream").cast("bigint")).alias("udp.stream"))
        out = out.join(numbers, F.col("packet_id") == F.col("__u"), "left").drop("__u").withColumn("udp.stream", F.coalesce(F.col("`udp.stream`"), F.array().cast("array<bigint>")))
    rest = sorted(wanted - {"udp.stream"})
    if not rest:
        return out
    seen = tcp_analysis(packets)
    if "tcp.stream" in wanted:
        from framelake.operators.presence import Presence

        firsts = Presence(seen.select(F.col("first_id").alias("packet_id")).distinct(), "packet_id").numbered().select(F.col("packet_id").alias("first_id"), F.col("rank").alias("stream"))
        seen = seen.join(firsts, "first_id")
    columns = {
        "tcp.stream": "stream", "tcp.analysis.ack_rtt": "rtt_ns", "tcp.analysis.rto": "rto_ns", "tcp.analysis.bytes_in_flight": "bytes_in_flight", "tcp.analysis.dup_acks": "dup_acks", "tcp.window_size": "window",
        "tcp.connection.phase": "phase", "tcp.completeness": "completeness", "tcp.time_delta": "delta_ns",
    }

    def made(name: str) -> Column:
        if name in columns:
            return F.array_compact(F.array(F.col(columns[name])))
        return F.array_compact(F.array(F.when(F.array_contains(F.split("analysis", ","), name.removeprefix("tcp.analysis.")), F.lit(True))))

    facts = seen.select(F.col("packet_id").alias("__t"), *[made(n).alias(n) for n in rest])
    kinds = dict(facts.dtypes)
    joined = out.join(facts, F.col("packet_id") == F.col("__t"), "left").drop("__t")
    return joined.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.array().cast(kinds[n])) for n in rest})


class Flow:
    """The bytes of one direction, in order: repeats are dropped, what came early waits, and what never comes is counted as missing."""

    def __init__(self, most_bytes: int) -> None:
        self.most, self.next, self.at = most_bytes, None, 0
        self.waiting: dict[int, bytes] = {}  # by offset
        self.held = 0

    def add(self, seq: int, syn: bool, data: bytes) -> list[tuple[int, bytes, int]]:
        """[(offset, bytes, missing bytes before them)] that can be told now."""
        out = []
        if syn:
            seq = (seq + 1) % SPACE
            if self.next is not None and ahead(seq, self.next) != 0:  # a new connection, or a SYN that was sent again
                if self.at == 0 or abs(ahead(seq, self.next)) > self.at:
                    out = self.flush()
                    self.__init__(self.most)
        if self.next is None:
            self.next = seq
        start = self.at + ahead(seq, self.next)
        if start < self.at:
            data, start = data[self.at - start :], self.at
        if not data:
            return out
        if start > self.at:
            old = self.waiting.get(start, b"")
            if len(data) > len(old):
                self.waiting[start] = data
                self.held += len(data) - len(old)
            if self.held > self.most:
                out += self._skip()
            return out
        self._take(out, start, data, 0)
        self._drain(out)
        return out

    def _take(self, out: list, offset: int, data: bytes, missing: int) -> None:
        out.append((offset, data, missing))
        self.next = (self.next + offset + len(data) - self.at) % SPACE
        self.at = offset + len(data)

    def _drain(self, out: list) -> None:
        while self.waiting and (low := min(self.waiting)) <= self.at:
            data = self.waiting.pop(low)
            self.held -= len(data)
            if low + len(data) > self.at:
                self._take(out, self.at, data[self.at - low :], 0)

    def _skip(self) -> list[tuple[int, bytes, int]]:
        out: list[tuple[int, bytes, int]] = []
        low = min(self.waiting)
        data = self.waiting.pop(low)
        self.held -= len(data)
        self._take(out, low, data, low - self.at)
        self._drain(out)
        return out

    def flush(self) -> list[tuple[int, bytes, int]]:
        out = []
        while self.waiting:
            out += self._skip()
        return out


def stream_bytes(packets: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """(key, side, n, packet_id, offset, data, missing): the bytes that each direction of each connection carries, in pieces.

    packet_id: the packet that made the piece known. missing: bytes before it that never came; a direction waits
    for them until most_bytes wait behind them, or to its end. No row holds more than a segment.
    """
    rows = segments(packets).select(F.concat_ws("/", "key", F.col("side").cast("string")).alias("flow"), "packet_id", "seq", (F.col("flags").bitwiseAND(F.lit(2)) > 0).alias("syn"), F.coalesce("data", F.lit(bytearray())).alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []

        def put(flow: str, pid: int, pieces: list[tuple[int, bytes, int]], n: int) -> int:
            for offset, data, missing in pieces:
                key, _, side = flow.rpartition("/")
                out.append((key, int(side), n, pid, offset, data, missing))
                n += 1
            return n

        for flow, segs in by_key(batches):
            state, n, pid = Flow(most_bytes), 0, 0
            for pid, seq, syn, data in segs:
                n = put(flow, pid, state.add(int(seq), bool(syn), bytes(data)), n)
                if len(out) >= 5_000:
                    yield pd.DataFrame(out, columns=names)
                    out.clear()
            put(flow, pid, state.flush(), n)
        yield pd.DataFrame(out, columns=names)

    schema = "key string, side int, n bigint, packet_id bigint, offset bigint, data binary, missing bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.repartition("flow").sortWithinPartitions("flow", "packet_id").mapInPandas(run, schema)
