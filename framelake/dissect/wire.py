"""Fixed headers of link, network and transport layers as column programs: no UDF, so that only the bytes of the fields asked for are looked at."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.catalog import Catalog
from framelake.functions import wire as W
from framelake.functions.stage import staged
from framelake.plans.compiler import Layout
from framelake.types import FieldType as T

VLAN_TYPES = (0x8100, 0x88A8)
#: IPv6 headers that say their length in units of eight bytes: hop-by-hop, routing, destination options.
CHAINED = (0, 43, 60)
UDP_PORTS = {53: "dns", 67: "dhcp", 68: "dhcp", 546: "dhcpv6", 547: "dhcpv6", 30490: "someip"}
TCP_PORTS = {53: "dns", 80: "http", 8080: "http", 443: "tls"}
#: Link types: 1 is Ethernet; cooked captures lead to the same network layers; the others hold one layer of their own.
ETHERNET, SLL, SLL2 = 1, 113, 276
BUSES = {227: "can", 212: "lin", 210: "flexray"}

#: Probes of payloads on ports that say nothing; the first that holds wins.
HEURISTICS: list[tuple[str, Callable[[Column], Column]]] = [
    ("http", lambda p: F.substring(p, 1, 8).cast("string").rlike("^((GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|CONNECT|TRACE) |HTTP/1[.])")),
    ("tls", lambda p: F.hex(F.substring(p, 1, 3)).rlike("^1[4567]030[0-4]") & (F.octet_length(p) >= 5)),
    ("http2", lambda p: F.substring(p, 1, 14) == F.lit(bytearray(b"PRI * HTTP/2.0"))),
]


def _someip(p: Column) -> Column:
    """A header of version 1 whose length counts its own second half."""
    return (F.octet_length(p) >= 16) & (W.be(p, 12, 1) == 1) & (W.be(p, 4, 4) >= 8)


#: Layers that only a TCP segment holds: datagrams aren't probed for them.
STREAMED = ("http", "tls", "http2")
#: What a payload holds for sure if it is of a layer that no probe above knows.
PLAUSIBLE: dict[str, Callable[[Column], Column]] = {"someip": _someip}
#: Ports from here on may be a client's by chance.
FREE_PORTS = 1024


def register_heuristic(name: str, test: Callable[[Column], Column], first: bool = False) -> None:
    """test: a condition on the column of payload bytes that no fixed port claims."""
    HEURISTICS.insert(0 if first else len(HEURISTICS), (name, test))


FIELDS: dict[str, tuple[T, str]] = {
    "frame.id": (T.U64, "Frame"), "frame.len": (T.U64, "Length"), "frame.time": (T.TIMESTAMP, "Time"), "frame.link_type": (T.U64, "Link type"),
    "eth.dst": (T.MAC, "Destination"), "eth.src": (T.MAC, "Source"), "eth.type": (T.U64, "Type"), "eth.len": (T.U64, "Length"),
    "vlan.priority": (T.U64, "Priority"), "vlan.dei": (T.BOOL, "Drop eligible"), "vlan.id": (T.U64, "Id"), "vlan.etype": (T.U64, "Type"),
    "arp.opcode": (T.U64, "Operation"), "arp.src.hw_mac": (T.MAC, "Sender MAC"), "arp.src.proto_ipv4": (T.IPV4, "Sender IP"), "arp.dst.hw_mac": (T.MAC, "Target MAC"), "arp.dst.proto_ipv4": (T.IPV4, "Target IP"), "arp.isgratuitous": (T.BOOL, "Gratuitous"), "arp.isannouncement": (T.BOOL, "Announcement"), "arp.isprobe": (T.BOOL, "Probe"),
    "ip.version": (T.U64, "Version"), "ip.hdr_len": (T.U64, "Header length"), "ip.dscp": (T.U64, "DSCP"), "ip.ecn": (T.U64, "ECN"), "ip.flags": (T.U64, "Flags"), "ip.flags.rb": (T.BOOL, "Reserved bit"), "ip.len": (T.U64, "Total length"), "ip.id": (T.U64, "Identification"), "ip.flags.df": (T.BOOL, "Don't fragment"), "ip.flags.mf": (T.BOOL, "More fragments"), "ip.frag_offset": (T.U64, "Fragment offset"), "ip.ttl": (T.U64, "Time to live"), "ip.proto": (T.U64, "Protocol"), "ip.checksum": (T.U64, "Checksum"), "ip.checksum.status": (T.STRING, "Checksum status"), "ip.src": (T.IPV4, "Source"), "ip.dst": (T.IPV4, "Destination"),
    "ipv6.tclass": (T.U64, "Traffic class"), "ipv6.flow": (T.U64, "Flow label"), "ipv6.plen": (T.U64, "Payload length"), "ipv6.nxt": (T.U64, "Next header"), "ipv6.hlim": (T.U64, "Hop limit"), "ipv6.src": (T.IPV6, "Source"), "ipv6.dst": (T.IPV6, "Destination"),
    "icmp.type": (T.U64, "Type"), "icmp.code": (T.U64, "Code"), "icmp.checksum": (T.U64, "Checksum"), "icmp.ident": (T.U64, "Identifier"), "icmp.seq": (T.U64, "Sequence number"), "icmpv6.type": (T.U64, "Type"), "icmpv6.code": (T.U64, "Code"),
    "udp.srcport": (T.U64, "Source port"), "udp.dstport": (T.U64, "Destination port"), "udp.length": (T.U64, "Length"), "udp.checksum": (T.U64, "Checksum"), "udp.payload": (T.BYTES, "Payload"),
    "tcp.srcport": (T.U64, "Source port"), "tcp.dstport": (T.U64, "Destination port"), "tcp.seq": (T.U64, "Sequence number"), "tcp.ack": (T.U64, "Acknowledgment number"), "tcp.hdr_len": (T.U64, "Header length"),
    **{f"tcp.flags.{n}": (T.BOOL, n.upper()) for n in ("fin", "syn", "reset", "push", "ack", "urg", "ece", "cwr")},
    "tcp.flags": (T.U64, "Flags"), "tcp.len": (T.U64, "Segment length"), "tcp.window_size_value": (T.U64, "Window"), "tcp.checksum": (T.U64, "Checksum"), "tcp.options": (T.BYTES, "Options"), "tcp.payload": (T.BYTES, "Payload"),
    "data.data": (T.BYTES, "Data"), "data.len": (T.U64, "Length"),
}


def layout() -> Layout:
    c = Catalog()
    for p in ("frame", "eth", "vlan", "arp", "ip", "ipv6", "icmp", "icmpv6", "udp", "tcp", "data", "dns", "dhcp", "dhcpv6", "someip", "http", "tls"):
        c.protocol(p)
    for name, (kind, ui) in FIELDS.items():
        c.add(name, kind, ui_name=ui)
    for alias, members in {"eth.addr": ("eth.src", "eth.dst"), "ip.addr": ("ip.src", "ip.dst"), "ipv6.addr": ("ipv6.src", "ipv6.dst"), "tcp.port": ("tcp.srcport", "tcp.dstport"), "udp.port": ("udp.srcport", "udp.dstport")}.items():
        c.alias(alias, members)
    return Layout(c.build(), {f: f for f in c.fields}, exhaustive=True)


def _flag(v: Column, bit: int) -> Column:
    return F.shiftright(v, bit).bitwiseAND(F.lit(1)) == 1


def _header_sum(d: Column, at: Column) -> Column:
    """The folded sum of an IPv4 header: 65535 if its checksum is right. 32-bit words fold to what 16-bit words do; options, which are rare, are added word by word."""
    total = sum((W.be(d, at + 4 * i, 4) for i in range(1, 5)), W.be(d, at, 4))
    options = F.substring(d, at + 21, (F.col("__hl") - 20).cast("int"))
    total = total + F.when(F.col("__hl") > 20, W.words_sum(options)).otherwise(0)
    return W.fold(W.fold(total))


def _some(value: Column) -> Column:
    return F.array_compact(F.array(value))


def headers(frames: DataFrame, data: str = "data") -> DataFrame:
    """frames with `h`: a struct of the header values, null where a layer isn't there, and `errors`: what was too short or wrong.

    Bad input never fails: it ends the dissection of its packet at that layer.
    """
    d = F.col(data)
    if "link_type" in frames.columns:  # cooked captures become a header without addresses; buses have no network layer
        blank, link = hexed("00" * 12), F.col("link_type")
        cooked = F.when(link == SLL, F.concat(blank, F.substring(d, F.lit(15), F.octet_length(d)))).when(link == SLL2, F.concat(blank, F.substring(d, 1, 2), F.substring(d, F.lit(21), F.octet_length(d))))
        frames = staged(frames, __d=F.when(link == ETHERNET, d).when(link.isin(SLL, SLL2), cooked).otherwise(hexed("")))
        d = F.col("__d")
    else:
        frames = frames.withColumn("__d", d)
        d = F.col("__d")
    digits = F.regexp_extract(F.hex(F.substring(d, F.lit(13), F.octet_length(d))), "^((?:(?:8100|88A8).{4})*)", 1)
    out = staged(frames, __tags=F.when(F.coalesce(W.be(d, 12, 2).isin(*VLAN_TYPES), F.lit(False)), (F.length(digits) / 8).cast("int")).otherwise(0))
    out = staged(out, __l3=14 + 4 * F.col("__tags"))
    l3 = F.col("__l3")
    out = staged(out, __type=W.be(d, l3 - 2, 2), __vi=W.be(d, l3, 1), __size=F.octet_length(d))
    kind, size, hl = F.when(F.col("__type") >= 0x600, F.col("__type")), F.col("__size"), F.col("__vi").bitwiseAND(F.lit(15)) * 4
    ip = (kind == 0x800) & (size >= l3 + 20) & (F.shiftright("__vi", 4) == 4) & (hl >= 20) & (size >= l3 + hl)
    v6 = (kind == 0x86DD) & (size >= l3 + 40) & (F.shiftright("__vi", 4) == 6)
    out = staged(out, __hl=hl, __ip=F.coalesce(ip, F.lit(False)), __v6=F.coalesce(v6, F.lit(False)), __arp=F.coalesce((kind == 0x806) & (size >= l3 + 28), F.lit(False)))
    first = F.struct(W.be(d, l3 + 6, 1).alias("nx"), (l3 + 40).cast("bigint").alias("at"))

    def following(x: Column, _: Column) -> Column:
        more = F.coalesce(x["nx"].isin(*CHAINED) & (size >= x["at"] + 8), F.lit(False))
        return F.when(more, F.struct(W.be(d, x["at"].cast("int"), 1).alias("nx"), (x["at"] + (W.be(d, (x["at"] + 1).cast("int"), 1) + 1) * 8).alias("at"))).otherwise(x)

    chain = F.when(W.be(d, l3 + 6, 1).isin(*CHAINED), F.aggregate(F.sequence(F.lit(1), F.greatest(((size - l3) / 8).cast("int"), F.lit(1))), first, following)).otherwise(first)
    out = staged(out, __frag=F.when(F.col("__ip"), W.be(d, l3 + 6, 2)), __chain=F.when(F.col("__v6"), chain))
    whole = F.col("__frag").bitwiseAND(F.lit(0x3FFF)) == 0  # no fragment is dispatched, not even the first
    proto = F.when(F.col("__ip") & whole, W.be(d, l3 + 9, 1)).when(F.col("__v6"), F.col("__chain.nx"))
    l4 = F.when(F.col("__ip"), l3 + F.col("__hl")).when(F.col("__v6"), F.col("__chain.at"))
    stop = F.when(F.col("__ip"), F.least(size, l3 + F.greatest(W.be(d, l3 + 2, 2), F.col("__hl")))).when(F.col("__v6"), F.least(size, l3 + 40 + W.be(d, l3 + 4, 2)))
    out = staged(out, __proto=proto, __l4=l4.cast("int"), __stop=stop.cast("int"))
    at, end = F.col("__l4"), F.col("__stop")
    out = staged(out, __udp=F.coalesce((F.col("__proto") == 17) & (end >= at + 8), F.lit(False)), __long=F.coalesce((F.col("__proto") == 6) & (end >= at + 20), F.lit(False)))
    out = staged(out, __th=F.when(F.col("__long"), F.shiftright(W.be(d, at + 12, 1), 4) * 4).cast("int"))
    out = staged(out, __tcp=F.col("__long") & F.coalesce((F.col("__th") >= 20) & (at + F.col("__th") <= end), F.lit(False)))
    udp_stop = F.least(end, at + F.greatest(W.be(d, at + 4, 2), F.lit(8))).cast("int")
    return staged(out, __payload=F.when(F.col("__udp"), W.raw(d, at + 8, udp_stop)).when(F.col("__tcp"), W.raw(d, at + F.col("__th"), end)))


def dissect(frames: DataFrame, data: str = "data", frame_id: str = "frame_id", timestamp: str = "timestamp_ns") -> DataFrame:
    """(packet_id, timestamp_ns, protocols, an array for each of FIELDS, app, payload, errors). Every layer is a sibling of the others."""
    linked = "link_type" in frames.columns
    h = headers(frames, data)
    raw, d, l3, at = F.col(data), F.col("__d"), F.col("__l3"), F.col("__l4")
    link = F.col("link_type") if linked else F.lit(ETHERNET)
    eth = (F.octet_length(d) >= 14) & (link == ETHERNET)

    def on(cond: Column, value: Column) -> Column:
        return _some(F.when(cond, value))

    ip, v6, arp, udp, tcp = (F.col(f"__{n}") for n in ("ip", "v6", "arp", "udp", "tcp"))
    icmp, icmpv6 = F.coalesce(ip & (F.col("__proto") == 1), F.lit(False)), F.coalesce(v6 & (F.col("__proto") == 58), F.lit(False))
    u = W.be
    each_tag = lambda f: F.when(F.col("__tags") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("__tags") - 1, F.lit(0))), f)).otherwise(F.array().cast("array<bigint>"))
    tci = each_tag(lambda i: u(d, 14 + 4 * i, 2))
    flags = F.when(tcp, u(d, at + 13, 1))
    probed = F.lit(None).cast("string")
    for name, test in reversed(HEURISTICS):
        found = test(F.col("__payload"))
        probed = F.when(tcp & found if name in STREAMED else found, name).otherwise(probed)
    app = F.lit(None).cast("string")
    for cond, table in ((udp, UDP_PORTS), (tcp, TCP_PORTS)):
        for number, name in sorted(table.items(), reverse=True):  # the lower of two known ports, which is the server's as a rule, is set last
            source = u(d, at, 2) == number
            if number >= FREE_PORTS:  # as a source port it says nothing if the payload is of another layer
                fits = PLAUSIBLE[name](F.col("__payload")) if name in PLAUSIBLE else F.coalesce(probed == name, F.lit(True))
                source = source & fits
            app = F.when(cond & (source | (u(d, at + 2, 2) == number)) & (F.octet_length("__payload") > 0), name).otherwise(app)
    app = F.coalesce(app, F.when((udp | tcp) & (F.octet_length("__payload") > 0), probed))
    if linked:
        for number, name in BUSES.items():
            app = F.when(link == number, name).otherwise(app)
        llc = (link == ETHERNET) & (F.col("__type") < 0x600)
        app = F.when(F.coalesce(llc, F.lit(False)), "llc").otherwise(app)
    values = {
        "frame.id": _some(F.col(frame_id)), "frame.len": _some(F.octet_length(raw).cast("bigint")), "frame.time": _some(F.col(timestamp)), "frame.link_type": F.array(link.cast("bigint")),
        "eth.dst": on(eth, u(d, 0, 6)), "eth.src": on(eth, u(d, 6, 6)), "eth.type": on(eth & (F.col("__type") >= 0x600), F.col("__type")), "eth.len": on(eth & (F.col("__type") < 0x600), F.col("__type")),
        "vlan.priority": F.transform(tci, lambda x: F.shiftright(x, 13)), "vlan.dei": F.transform(tci, lambda x: _flag(x, 12)), "vlan.id": F.transform(tci, lambda x: x.bitwiseAND(F.lit(0xFFF))), "vlan.etype": each_tag(lambda i: u(d, 16 + 4 * i, 2)),
        "arp.opcode": on(arp, u(d, l3 + 6, 2)), "arp.src.hw_mac": on(arp, u(d, l3 + 8, 6)), "arp.src.proto_ipv4": on(arp, u(d, l3 + 14, 4)), "arp.dst.hw_mac": on(arp, u(d, l3 + 18, 6)), "arp.dst.proto_ipv4": on(arp, u(d, l3 + 24, 4)),
        "arp.isgratuitous": on(arp, u(d, l3 + 14, 4) == u(d, l3 + 24, 4)), "arp.isannouncement": on(arp, (u(d, l3 + 6, 2) == 1) & (u(d, l3 + 14, 4) == u(d, l3 + 24, 4)) & (u(d, l3 + 18, 6) == 0)), "arp.isprobe": on(arp, (u(d, l3 + 6, 2) == 1) & (u(d, l3 + 14, 4) == 0)),
        "ip.version": on(ip, F.lit(4).cast("bigint")), "ip.hdr_len": on(ip, F.col("__hl")), "ip.dscp": on(ip, F.shiftright(u(d, l3 + 1, 1), 2)), "ip.ecn": on(ip, u(d, l3 + 1, 1).bitwiseAND(F.lit(3))), "ip.flags": on(ip, F.shiftright("__frag", 13)), "ip.flags.rb": on(ip, _flag(F.col("__frag"), 15)), "ip.len": on(ip, u(d, l3 + 2, 2)), "ip.id": on(ip, u(d, l3 + 4, 2)), "ip.flags.df": on(ip, _flag(F.col("__frag"), 14)), "ip.flags.mf": on(ip, _flag(F.col("__frag"), 13)), "ip.frag_offset": on(ip, F.col("__frag").bitwiseAND(F.lit(0x1FFF)) * 8),
        "ip.ttl": on(ip, u(d, l3 + 8, 1)), "ip.proto": on(ip, u(d, l3 + 9, 1)), "ip.checksum": on(ip, u(d, l3 + 10, 2)), "ip.checksum.status": on(ip, F.when(_header_sum(d, l3) == 65535, "Good").otherwise("Bad")), "ip.src": on(ip, u(d, l3 + 12, 4)), "ip.dst": on(ip, u(d, l3 + 16, 4)),
        "ipv6.tclass": on(v6, F.shiftright(u(d, l3, 2), 4).bitwiseAND(F.lit(255))), "ipv6.flow": on(v6, u(d, l3, 4).bitwiseAND(F.lit(0xFFFFF))), "ipv6.plen": on(v6, u(d, l3 + 4, 2)), "ipv6.nxt": on(v6, u(d, l3 + 6, 1)), "ipv6.hlim": on(v6, u(d, l3 + 7, 1)), "ipv6.src": on(v6, W.raw(d, l3 + 8, l3 + 24)), "ipv6.dst": on(v6, W.raw(d, l3 + 24, l3 + 40)),
        "icmp.type": on(icmp, u(d, at, 1)), "icmp.code": on(icmp, u(d, at + 1, 1)), "icmp.checksum": on(icmp, u(d, at + 2, 2)), "icmp.ident": on(icmp & u(d, at, 1).isin(0, 8), u(d, at + 4, 2)), "icmp.seq": on(icmp & u(d, at, 1).isin(0, 8), u(d, at + 6, 2)), "icmpv6.type": on(icmpv6, u(d, at, 1)), "icmpv6.code": on(icmpv6, u(d, at + 1, 1)),
        "udp.srcport": on(udp, u(d, at, 2)), "udp.dstport": on(udp, u(d, at + 2, 2)), "udp.length": on(udp, u(d, at + 4, 2)), "udp.checksum": on(udp, u(d, at + 6, 2)), "udp.payload": on(udp, F.col("__payload")),
        "tcp.srcport": on(tcp, u(d, at, 2)), "tcp.dstport": on(tcp, u(d, at + 2, 2)), "tcp.seq": on(tcp, u(d, at + 4, 4)), "tcp.ack": on(tcp, u(d, at + 8, 4)), "tcp.hdr_len": on(tcp, F.col("__th").cast("bigint")),
        **{f"tcp.flags.{n}": on(tcp, _flag(flags, i)) for i, n in enumerate(("fin", "syn", "reset", "push", "ack", "urg", "ece", "cwr"))},
        "tcp.flags": on(tcp, u(d, at + 12, 2).bitwiseAND(F.lit(0xFFF))), "tcp.len": on(tcp, F.octet_length("__payload").cast("bigint")), "tcp.window_size_value": on(tcp, u(d, at + 14, 2)), "tcp.checksum": on(tcp, u(d, at + 16, 2)), "tcp.options": on(tcp & (F.col("__th") > 20), W.raw(d, at + 20, at + F.col("__th"))), "tcp.payload": on(tcp & (F.octet_length("__payload") > 0), F.col("__payload")),
    }
    plain = F.col("app").isNull() & (F.octet_length("__payload") > 0)
    tags = F.when(F.col("__tags") > 0, F.array_repeat(F.lit("vlan"), F.col("__tags"))).otherwise(F.array().cast("array<string>"))
    ends = F.array_compact(F.array(F.when(arp, F.lit("arp")), F.when(ip, F.lit("ip")), F.when(v6, F.lit("ipv6")), F.when(icmp, F.lit("icmp")), F.when(icmpv6, F.lit("icmpv6")), F.when(udp, F.lit("udp")), F.when(tcp, F.lit("tcp")), F.col("app"), F.when(plain, F.lit("data"))))
    links = [F.when(link == SLL, "sll").when(link == SLL2, "sll2")] if linked else []
    names = F.concat(F.array_compact(F.array(F.lit("frame"), F.when(eth, F.lit("eth")), *links)), tags, ends)
    too_short = F.array_compact(F.array(
        F.when((F.octet_length(d) < 14) & (link == ETHERNET), F.lit("eth: too short")),
        F.when((F.col("__type") == 0x800) & ~ip, F.lit("ip: too short or invalid")),
        F.when((F.col("__type") == 0x86DD) & ~v6, F.lit("ipv6: too short or invalid")),
        F.when((F.col("__proto") == 17) & ~udp, F.lit("udp: too short")),
        F.when((F.col("__proto") == 6) & ~tcp, F.lit("tcp: too short or invalid")),
    ))
    named = staged(h, app=app)
    held = F.col("__payload")
    if linked:  # what a layer of its own is read from: the frame, or what follows the length of an 802.3 frame
        held = F.when(link.isin(*BUSES), raw).when(F.col("app") == "llc", W.raw(d, l3)).otherwise(held)
    return named.select(F.col(frame_id).alias("packet_id"), F.col(timestamp).alias("timestamp_ns"), names.alias("protocols"), *[v.alias(k) for k, v in values.items()], on(plain, F.col("__payload")).alias("data.data"), on(plain, F.octet_length("__payload").cast("bigint")).alias("data.len"), "app", held.alias("payload"), too_short.alias("errors"))


# the inverse: headers from values


def _cat(*parts: Column) -> Column:
    return F.concat(*parts)


def hexed(digits: str) -> Column:
    return F.lit(bytearray.fromhex(digits))


def ethernet(dst: Column, src: Column, kind: Column, payload: Column, *vlans: Column) -> Column:
    tags = [part for v in vlans for part in (hexed("8100"), W.be_bytes(v, 2))]
    return _cat(W.be_bytes(dst, 6), W.be_bytes(src, 6), *tags, W.be_bytes(kind, 2), payload)


def ipv4(src: Column, dst: Column, proto: Column, payload: Column, ttl: Column | None = None, ident: Column | None = None, frag: Column | None = None) -> Column:
    size = F.octet_length(payload) + 20
    ident, frag, ttl = (F.lit(default) if c is None else c for c, default in ((ident, 0), (frag, 0), (ttl, 64)))
    words = F.lit(0x4500).cast("bigint") + size + ident + frag + F.shiftleft(ttl.cast("bigint"), 8) + proto
    for address in (src, dst):
        words = words + F.shiftright(address, 16) + address.bitwiseAND(F.lit(65535))
    checksum = F.lit(65535) - W.fold(words)
    return _cat(hexed("4500"), W.be_bytes(size, 2), W.be_bytes(ident, 2), W.be_bytes(frag, 2), W.be_bytes(ttl, 1), W.be_bytes(proto, 1), W.be_bytes(checksum, 2), W.be_bytes(src, 4), W.be_bytes(dst, 4), payload)


def udp(src: Column, dst: Column, payload: Column) -> Column:
    return _cat(W.be_bytes(src, 2), W.be_bytes(dst, 2), W.be_bytes(F.octet_length(payload) + 8, 2), hexed("0000"), payload)


def tcp(src: Column, dst: Column, seq: Column, ack: Column, flags: Column, payload: Column, window: int = 65535) -> Column:
    return _cat(W.be_bytes(src, 2), W.be_bytes(dst, 2), W.be_bytes(seq, 4), W.be_bytes(ack, 4), hexed("50"), W.be_bytes(flags, 1), W.be_bytes(F.lit(window), 2), hexed("00000000"), payload)
