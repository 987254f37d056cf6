"""Application layers: nested and repeated structures, one Python function each, run over Arrow batches.

A dissector takes bytes and yields (name, depth, value) in pre-order; a container comes before what
it holds. What is too short or wrong ends the dissection with a node `packet.error`.
"""

from __future__ import annotations

import ipaddress
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Node = tuple[str, int, object]
Dissector = Callable[[bytes], Iterator[Node]]
REGISTRY: dict[str, Dissector] = {}


class Malformed(ValueError):
    pass


def register(name: str):
    def add(f: Dissector) -> Dissector:
        REGISTRY[name] = f
        return f

    return add


class Bytes:
    """A cursor that refuses to go past the end."""

    def __init__(self, data: bytes, at: int = 0, stop: int | None = None) -> None:
        self.data, self.at, self.stop = data, at, len(data) if stop is None else stop

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.stop:
            raise Malformed("too short")
        self.at += n
        return self.data[self.at - n : self.at]

    def u(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    @property
    def left(self) -> int:
        return self.stop - self.at


def dns_name(data: bytes, at: int, hops: int = 64) -> tuple[str, int]:
    """(name, where it ends): labels, and pointers that must go back."""
    labels, end, here = [], None, at
    while True:
        if here >= len(data):
            raise Malformed("name too short")
        n = data[here]
        if n >= 0xC0:
            if here + 2 > len(data) or hops == 0:
                raise Malformed("bad pointer")
            target = (n & 0x3F) << 8 | data[here + 1]
            end = here + 2 if end is None else end
            if target >= here:
                raise Malformed("pointer forward")
            here, hops = target, hops - 1
            continue
        if n > 63:
            raise Malformed("bad label")
        here += 1
        if n == 0:
            return ".".join(labels), here if end is None else end
        labels.append(data[here : here + n].decode("latin-1"))
        here += n


@register("dns")
def dns(data: bytes) -> Iterator[Node]:
    yield "dns", 1, data
    b = Bytes(data)
    yield "dns.id", 2, b.u(2)
    flags = b.u(2)
    yield "dns.flags", 2, flags
    for name, shift, mask in (("response", 15, 1), ("opcode", 11, 15), ("authoritative", 10, 1), ("truncated", 9, 1), ("recdesired", 8, 1), ("recavail", 7, 1), ("rcode", 0, 15)):
        value = flags >> shift & mask
        yield f"dns.flags.{name}", 2, bool(value) if mask == 1 else value
    counts = [b.u(2) for _ in range(4)]
    for name, n in zip(("queries", "answers", "auth_rr", "add_rr"), counts, strict=True):
        yield f"dns.count.{name}", 2, n
    for _ in range(counts[0]):
        yield "dns.qry", 2, None
        name, b.at = dns_name(data, b.at)
        yield "dns.qry.name", 3, name
        yield "dns.qry.name.len", 3, len(name)
        yield "dns.qry.type", 3, b.u(2)
        yield "dns.qry.class", 3, b.u(2)
    for _ in range(sum(counts[1:])):
        yield "dns.resp", 2, None
        name, b.at = dns_name(data, b.at)
        kind, cls, ttl, n = b.u(2), b.u(2), b.u(4), b.u(2)
        yield "dns.resp.name", 3, name
        yield "dns.resp.type", 3, kind
        yield "dns.resp.class", 3, cls
        yield "dns.resp.ttl", 3, ttl
        yield "dns.resp.len", 3, n
        start = b.at
        body = b.take(n)
        if kind == 1 and n == 4:
            yield "dns.a", 3, int.from_bytes(body, "big")
        elif kind == 28 and n == 16:
            yield "dns.aaaa", 3, body
        elif kind in (2, 5, 12):
            yield {2: "dns.ns", 5: "dns.cname", 12: "dns.ptr.domain_name"}[kind], 3, dns_name(data, start)[0]
        elif kind == 15:
            yield "dns.mx.preference", 3, int.from_bytes(body[:2], "big")
            yield "dns.mx.mail_exchange", 3, dns_name(data, start + 2)[0]
        elif kind == 16:
            texts = Bytes(body)
            while texts.left:
                yield "dns.txt", 3, texts.take(texts.u(1)).decode("utf-8", "replace")
        elif kind == 6:
            first, here = dns_name(data, start)
            second, here = dns_name(data, here)
            yield "dns.soa.mname", 3, first
            yield "dns.soa.rname", 3, second
            numbers = Bytes(data, here, start + n)
            for field in ("serial", "refresh", "retry", "expire", "minimum"):
                yield f"dns.soa.{field}", 3, numbers.u(4)
        elif kind == 41:  # the class and the time are other things here
            yield "dns.opt.udp_size", 3, cls
            yield "dns.opt.rcode", 3, ttl >> 24
            yield "dns.opt.version", 3, ttl >> 16 & 255
            yield "dns.opt.do", 3, bool(ttl >> 15 & 1)
        elif kind == 47:
            after, here = dns_name(data, start)
            yield "dns.nsec.next", 3, after
            maps = Bytes(data, here, start + n)
            while maps.left:
                block, bits = maps.u(1), maps.take(maps.u(1))
                for i in range(8 * len(bits)):
                    if bits[i // 8] >> 7 - i % 8 & 1:
                        yield "dns.nsec.type", 3, block << 8 | i
        elif kind == 33:
            for i, field in enumerate(("priority", "weight", "port")):
                yield f"dns.srv.{field}", 3, int.from_bytes(body[2 * i : 2 * i + 2], "big")
            yield "dns.srv.name", 3, dns_name(data, start + 6)[0]


@register("dhcp")
def dhcp(data: bytes) -> Iterator[Node]:
    yield "dhcp", 1, data
    b = Bytes(data)
    for name, n in (("type", 1), ("hw.type", 1), ("hw.len", 1), ("hops", 1), ("id", 4), ("secs", 2), ("flags", 2), ("ip.client", 4), ("ip.your", 4), ("ip.server", 4), ("ip.relay", 4)):
        yield f"dhcp.{name}", 2, b.u(n)
    yield "dhcp.hw.mac_addr", 2, int.from_bytes(b.take(16)[:6], "big")
    b.take(192)
    yield "dhcp.cookie", 2, b.u(4)
    numbers = {1: "subnet_mask", 3: "router", 6: "dns_server", 50: "requested_ip", 51: "lease_time", 53: "dhcp", 54: "dhcp_server_id"}
    while b.left:
        code = b.u(1)
        if code == 0:
            continue
        if code == 255:
            break
        body = b.take(b.u(1))
        yield "dhcp.option", 2, body
        yield "dhcp.option.type", 3, code
        yield "dhcp.option.length", 3, len(body)
        if code in (3, 6):
            for i in range(0, len(body) - 3, 4):
                yield f"dhcp.option.{numbers[code]}", 3, int.from_bytes(body[i : i + 4], "big")
        elif code in numbers:
            yield f"dhcp.option.{numbers[code]}", 3, int.from_bytes(body, "big")
        elif code in (12, 60):
            yield "dhcp.option.hostname" if code == 12 else "dhcp.option.vendor_class_id", 3, body.decode("utf-8", "replace")


@register("dhcpv6")
def dhcpv6(data: bytes) -> Iterator[Node]:
    yield "dhcpv6", 1, data
    b = Bytes(data)
    yield "dhcpv6.msgtype", 2, b.u(1)
    yield "dhcpv6.xid", 2, b.u(3)
    while b.left:
        code, body = b.u(2), None
        body = b.take(b.u(2))
        yield "dhcpv6.option", 2, body
        yield "dhcpv6.option.code", 3, code
        yield "dhcpv6.option.length", 3, len(body)
        if code == 8:
            yield "dhcpv6.option.elapsed_time", 3, int.from_bytes(body, "big")
        elif code == 13:
            yield "dhcpv6.option.status_code", 3, int.from_bytes(body[:2], "big")
        elif code == 14:
            yield "dhcpv6.option.rapid_commit", 3, True
        elif code == 23:
            for i in range(0, len(body) - 15, 16):
                yield "dhcpv6.option.dns_server", 3, body[i : i + 16]
        else:
            yield "dhcpv6.option.value", 3, body


METHODS = (b"GET", b"POST", b"PUT", b"DELETE", b"HEAD", b"OPTIONS", b"PATCH", b"CONNECT", b"TRACE")
KNOWN_HEADERS = {"host": "http.host", "user-agent": "http.user_agent", "content-type": "http.content_type_value", "content-length": "http.content_length", "transfer-encoding": "http.transfer_encoding", "content-encoding": "http.content_encoding", "upgrade": "http.upgrade", "connection": "http.connection"}


def dechunk(body: bytes) -> bytes:
    out, at = b"", 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = int(body[at:end].split(b";")[0] or b"0", 16)
        if size == 0:
            break
        out += body[end + 2 : end + 2 + size]
        at = end + 4 + size
    return out


@register("http")
def http(data: bytes) -> Iterator[Node]:
    yield "http", 1, data
    head, gap, body = data.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    first = lines[0].split(" ", 2)
    if len(first) < 2:
        raise Malformed("not HTTP")
    if first[0].startswith("HTTP/"):
        yield "http.response", 2, True
        yield "http.response.version", 2, first[0]
        yield "http.response.code", 2, int(first[1]) if first[1].isdigit() else 0
        yield "http.response.phrase", 2, first[2] if len(first) > 2 else ""
    elif first[0].encode() in METHODS:
        yield "http.request", 2, True
        yield "http.request.method", 2, first[0]
        yield "http.request.uri", 2, first[1]
        yield "http.request.version", 2, first[2] if len(first) > 2 else ""
    else:
        raise Malformed("not HTTP")
    seen = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        value = value.strip()
        seen[name.lower()] = value
        yield "http.header", 2, None
        yield "http.header.name", 3, name
        yield "http.header.value", 3, value
        if name.lower() in KNOWN_HEADERS:
            yield KNOWN_HEADERS[name.lower()], 2, int(value) if name.lower() == "content-length" and value.isdigit() else value
    if gap and body:
        yield "http.payload", 2, body
        plain = dechunk(body) if "chunked" in seen.get("transfer-encoding", "").lower() else body
        if seen.get("content-encoding", "").lower() in ("gzip", "deflate"):
            plain = zlib.decompressobj(47).decompress(plain, 1 << 24)
        if plain != body:
            yield "http.payload.decoded", 2, plain


@register("tls")
def tls(data: bytes) -> Iterator[Node]:
    yield "tls", 1, data
    b = Bytes(data)
    while b.left:
        kind, version = b.u(1), b.u(2)
        body = b.take(b.u(2))
        yield "tls.record", 2, None
        yield "tls.record.content_type", 3, kind
        yield "tls.record.version", 3, version
        yield "tls.record.length", 3, len(body)
        if kind == 21 and len(body) == 2:
            yield "tls.alert.level", 3, body[0]
            yield "tls.alert.description", 3, body[1]
        if kind != 22:
            continue
        h = Bytes(body)
        while h.left >= 4:
            what = h.u(1)
            m = Bytes(h.take(h.u(3)))
            yield "tls.handshake", 3, None
            yield "tls.handshake.type", 4, what
            yield "tls.handshake.length", 4, m.left
            if what == 11 and version < 0x304 and m.left >= 3:
                chain = Bytes(m.take(m.u(3)))
                while chain.left:
                    yield "tls.handshake.certificate", 4, None
                    certificate = chain.take(chain.u(3))
                    yield "tls.handshake.certificate.length", 5, len(certificate)
                    yield "tls.handshake.certificate.data", 5, certificate
            if what not in (1, 2):
                continue
            yield "tls.handshake.version", 4, m.u(2)
            yield "tls.handshake.random", 4, m.take(32)
            yield "tls.handshake.session_id", 4, m.take(m.u(1))
            if what == 1:
                suites = Bytes(m.take(m.u(2)))
                while suites.left:
                    yield "tls.handshake.ciphersuite", 4, suites.u(2)
                m.take(m.u(1))
            else:
                yield "tls.handshake.ciphersuite", 4, m.u(2)
                m.u(1)
            if not m.left:
                continue
            extensions = Bytes(m.take(m.u(2)))
            while extensions.left:
                code = extensions.u(2)
                e = Bytes(extensions.take(extensions.u(2)))
                yield "tls.handshake.extension", 4, None
                yield "tls.handshake.extension.type", 5, code
                if code == 0 and what == 1 and e.left:
                    e.u(2)
                    e.u(1)
                    yield "tls.handshake.extensions.server_name", 5, e.take(e.u(2)).decode("latin-1")
                elif code in (10, 13) and e.left:
                    e.u(2)
                    while e.left >= 2:
                        yield f"tls.handshake.extensions.{'supported_group' if code == 10 else 'sig_hash_alg'}", 5, e.u(2)
                elif code == 43:
                    if what == 1:
                        e.u(1)
                    while e.left >= 2:
                        yield "tls.handshake.extensions.supported_version", 5, e.u(2)
                elif code == 51 and e.left > 2:
                    if what == 1:
                        e.u(2)
                    while e.left >= 4:
                        yield "tls.handshake.extensions.key_share.entry", 5, None
                        yield "tls.handshake.extensions.key_share.group", 6, e.u(2)
                        yield "tls.handshake.extensions.key_share.key_exchange", 6, e.take(e.u(2))
                elif code == 16:
                    e.u(2)
                    while e.left:
                        yield "tls.handshake.extensions.alpn_str", 5, e.take(e.u(1)).decode("latin-1")


@register("json")
def json_text(data: bytes) -> Iterator[Node]:
    yield "json", 1, data

    def value(v: object, depth: int) -> Iterator[Node]:
        if isinstance(v, dict):
            yield "json.object", depth, None
            for k, x in v.items():
                yield "json.member", depth + 1, None
                yield "json.key", depth + 2, k
                yield from value(x, depth + 2)
        elif isinstance(v, list):
            yield "json.array", depth, None
            for x in v:
                yield from value(x, depth + 1)
        elif v is None or isinstance(v, bool):
            yield {None: "json.value.null", True: "json.value.true", False: "json.value.false"}[v], depth, v
        else:
            yield "json.value.string" if isinstance(v, str) else "json.value.number", depth, v

    try:
        parsed = json.loads(data)
    except ValueError as e:
        raise Malformed(str(e)) from None
    yield from value(parsed, 2)


@register("websocket")
def websocket(data: bytes) -> Iterator[Node]:
    yield "websocket", 1, data
    b = Bytes(data)
    while b.left:
        first, second = b.u(1), b.u(1)
        size = second & 127
        size = b.u(2) if size == 126 else b.u(8) if size == 127 else size
        yield "websocket.frame", 2, None
        yield "websocket.fin", 3, bool(first & 128)
        yield "websocket.rsv1", 3, bool(first & 64)
        yield "websocket.opcode", 3, first & 15
        yield "websocket.mask", 3, bool(second & 128)
        yield "websocket.payload_length", 3, size
        key = b.take(4) if second & 128 else b"\0\0\0\0"
        body = b.take(size)
        plain = bytes(c ^ key[i % 4] for i, c in enumerate(body))
        yield "websocket.payload", 3, plain
        if first & 64 and first & 128 and first & 15 in (1, 2):  # permessage-deflate, without context from message to message
            try:
                yield "websocket.payload.decoded", 3, zlib.decompressobj(-15).decompress(plain + b"\0\0\xff\xff", 1 << 24)
            except zlib.error as e:
                raise Malformed(f"bad compression: {e}") from None


@register("http2")
def http2(data: bytes) -> Iterator[Node]:
    yield "http2", 1, data
    b = Bytes(data)
    if data.startswith(b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"):
        yield "http2.magic", 2, b.take(24)
    while b.left:
        size, kind, flags, stream = b.u(3), b.u(1), b.u(1), b.u(4) & 0x7FFFFFFF
        body = b.take(size)
        yield "http2.frame", 2, None
        yield "http2.frame.length", 3, size
        yield "http2.frame.type", 3, kind
        yield "http2.frame.flags", 3, flags
        yield "http2.frame.stream_id", 3, stream
        names = ((0, "ack"),) if kind in (4, 6) else ((0, "end_stream"), (2, "end_headers"), (3, "padded"), (5, "priority"))
        for bit, name in names if kind in (0, 1, 4, 5, 6, 9) else ():
            yield f"http2.frame.flags.{name}", 4, bool(flags >> bit & 1)
        if kind == 4:
            for i in range(0, len(body) - 5, 6):
                yield "http2.settings", 3, None
                yield "http2.settings.id", 4, int.from_bytes(body[i : i + 2], "big")
                yield "http2.settings.value", 4, int.from_bytes(body[i + 2 : i + 6], "big")
        elif kind == 8 and size == 4:
            yield "http2.window_update.increment", 3, int.from_bytes(body, "big") & 0x7FFFFFFF
        elif kind == 3 and size == 4:
            yield "http2.rst_stream.error_code", 3, int.from_bytes(body, "big")
        elif kind == 6 and size == 8:
            yield "http2.ping.opaque", 3, body
        elif kind == 7 and size >= 8:
            yield "http2.goaway.last_stream_id", 3, int.from_bytes(body[:4], "big") & 0x7FFFFFFF
            yield "http2.goaway.error_code", 3, int.from_bytes(body[4:8], "big")
            if size > 8:
                yield "http2.goaway.debug_data", 3, body[8:]
        else:
            yield "http2.frame.payload", 3, body


@register("someip")
def someip(data: bytes) -> Iterator[Node]:
    b = Bytes(data)
    while b.left >= 16:
        start = b.at
        service, method, size = b.u(2), b.u(2), b.u(4)
        if size < 8:
            raise Malformed("bad length")
        yield "someip", 1, data[start : start + 8 + size]
        client, session, version, interface, kind, code = (b.u(n) for n in (2, 2, 1, 1, 1, 1))
        for name, value in (("serviceid", service), ("methodid", method), ("length", size), ("clientid", client), ("sessionid", session), ("protocol_version", version), ("ifversion", interface), ("msgtype", kind), ("returncode", code)):
            yield f"someip.{name}", 2, value
        body = b.take(size - 8)
        yield "someip.payload", 2, body
        if (service, method) == (0xFFFF, 0x8100):
            yield from REGISTRY["someip_sd"](body)
        elif kind & 0x20:
            yield from REGISTRY["someip_tp"](body)


@register("pdu_transport")
def pdu_transport(data: bytes) -> Iterator[Node]:
    b = Bytes(data)
    while b.left:
        yield "pdu_transport", 1, None
        ident, size = b.u(4), b.u(4)
        yield "pdu_transport.id", 2, ident
        yield "pdu_transport.length", 2, size
        yield "pdu_transport.payload", 2, b.take(size)


@register("can")
def can(data: bytes) -> Iterator[Node]:
    """A SocketCAN frame; FD frames have flags beside the length."""
    b = Bytes(data)
    yield "can", 1, data
    if len(data) >= 12 and data[4] & 0x80:  # XL: priority and network, flags, type, little-endian length, acceptance field
        word, flags, kind = b.u(4), b.u(1), b.u(1)
        size = int.from_bytes(b.take(2), "little")
        yield "can.xl.priority", 2, word & 0x7FF
        yield "can.xl.vcid", 2, word >> 16 & 0xFF
        yield "can.flags.xl", 2, True
        yield "can.flags.sec", 2, bool(flags & 1)
        yield "can.xl.sdt", 2, kind
        yield "can.len", 2, size
        yield "can.xl.af", 2, int.from_bytes(b.take(4), "little")
        yield "can.data", 2, b.take(min(size, b.left))
        return
    ident, size, flags = b.u(4), b.u(1), b.u(1)
    b.take(2)
    extended = bool(ident & 0x80000000)
    yield "can.id", 2, ident & (0x1FFFFFFF if extended else 0x7FF)
    for name, bit in (("xtd", 31), ("rtr", 30), ("err", 29)):
        yield f"can.flags.{name}", 2, bool(ident >> bit & 1)
    yield "can.len", 2, size
    if flags & 4 or size > 8:
        for name, bit in (("fd", 2), ("brs", 0), ("esi", 1)):
            yield f"can.flags.{name}", 2, bool(flags >> bit & 1) or name == "fd"
    yield "can.data", 2, b.take(min(size, b.left))


@register("text")
def text(data: bytes) -> Iterator[Node]:
    yield "text", 1, data
    for line in data.decode("utf-8", "replace").splitlines():
        yield "text.line", 2, line


def nodes_safely(name: str, data: bytes) -> Iterator[Node]:
    """What the dissector yields; a fault is a last node `packet.error`."""
    dissector = REGISTRY.get(name)
    if dissector:
        try:
            yield from dissector(data)
        except (Malformed, struct.error, ipaddress.AddressValueError, ValueError, IndexError) as e:
            yield "packet.error", 1, f"{name}: {e}"


#: First match wins, as for payloads on ports that say nothing.
HEURISTICS: list[tuple[str, Callable[[bytes], bool]]] = [
    ("http", lambda d: d.startswith(tuple(m + b" " for m in METHODS)) or d.startswith(b"HTTP/1.")),
    ("tls", lambda d: len(d) >= 5 and d[0] in (20, 21, 22, 23) and d[1] == 3 and d[2] <= 4),
    ("http2", lambda d: d.startswith(b"PRI * HTTP/2.0")),
]


def guess(data: bytes) -> str | None:
    return next((name for name, test in HEURISTICS if test(data)), None)


def nodes_of(name: str | None, data: bytes) -> list[tuple]:
    """(node_id, parent, depth, stop, name, i64, f64, str, bin, bool); a fault is the last node."""
    out: list[list] = []
    above: list[int] = []

    def put(label: str, depth: int, v: object) -> None:
        while len(above) >= depth:
            above.pop()
        own = len(out)
        i64 = v if isinstance(v, int) and not isinstance(v, bool) and v < 1 << 63 else None
        out.append([own, above[-1] if above else -1, depth, own, label, i64, v if isinstance(v, float) else None, v if isinstance(v, str) else None, v if isinstance(v, bytes) else None, v if isinstance(v, bool) else None])
        for a in above:
            out[a][3] = own
        above.append(own)

    for label, depth, v in nodes_safely(name or guess(data) or "", data):
        if label == "packet.error":
            above.clear()
        put(label, depth, v)
    return [tuple(x) for x in out]


NODE_SCHEMA = "packet_id bigint, node_id int, parent int, depth int, stop int, name string, i64 bigint, f64 double, str string, bin binary, bool boolean"


def dissect(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Node rows of df (packet_id, app, payload). names: the nodes that are wanted, so that no others leave the workers."""
    wanted = set(names) if names else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for pid, app, payload in pdf.itertuples(index=False):
                if payload is not None:
                    rows += [(pid, *n) for n in nodes_of(app, bytes(payload)) if wanted is None or n[4] in wanted]
            out = pd.DataFrame(rows, columns=["packet_id", "node_id", "parent", "depth", "stop", "name", "i64", "f64", "str", "bin", "bool"])
            out["i64"] = out["i64"].astype("Int64")
            yield out

    return df.select("packet_id", "app", "payload").filter("payload is not null").mapInPandas(run, NODE_SCHEMA)


# cooked link layers and vehicle buses


@register("sll")
def sll(data: bytes) -> Iterator[Node]:
    """Linux cooked capture, version 1."""
    b = Bytes(data)
    yield "sll", 1, data[:16]
    yield "sll.pkttype", 2, b.u(2)
    yield "sll.hatype", 2, b.u(2)
    size = b.u(2)
    yield "sll.halen", 2, size
    address = b.take(8)
    yield "sll.src.eth", 2, int.from_bytes(address[:6], "big") if size >= 6 else 0
    yield "sll.etype", 2, b.u(2)


@register("sll2")
def sll2(data: bytes) -> Iterator[Node]:
    b = Bytes(data)
    yield "sll2", 1, data[:20]
    for name, n in (("etype", 2), ("reserved", 2), ("if_index", 4), ("hatype", 2), ("pkttype", 1)):
        yield f"sll2.{name}", 2, b.u(n)
    size = b.u(1)
    yield "sll2.halen", 2, size
    address = b.take(8)
    yield "sll2.src.eth", 2, int.from_bytes(address[:6], "big") if size >= 6 else 0


@register("llc")
def llc(data: bytes) -> Iterator[Node]:
    b = Bytes(data)
    yield "llc", 1, data
    yield "llc.dsap", 2, b.u(1)
    yield "llc.ssap", 2, b.u(1)
    control = b.u(1)
    if control & 3 != 3:
        control = control << 8 | b.u(1)
    yield "llc.control", 2, control
    if data[:3] == b"\xaa\xaa\x03":
        yield "llc.oui", 2, b.take(3)
        yield "llc.type", 2, b.u(2)


#: What the two-bit codes of a LIN header stand for.
LIN_TYPES = ("Frame", "Event-triggered", "Sporadic", "Event")
LIN_CHECKSUMS = ("Unknown/Error", "Classic", "Enhanced", "Undefined")


def lin_parity(ident: int) -> int:
    bit = lambda i: ident >> i & 1
    return (bit(0) ^ bit(1) ^ bit(2) ^ bit(4)) | (1 ^ bit(1) ^ bit(3) ^ bit(4) ^ bit(5)) << 1


def lin_checksum(data: bytes, start: int = 0) -> int:
    """The inverted sum with carries; start: 0 in the classic form, the protected id in the enhanced one."""
    total = start
    for c in data:
        total += c
        total = total - 255 if total > 255 else total
    return 255 - total


@register("lin")
def lin(data: bytes) -> Iterator[Node]:
    b = Bytes(data)
    revision, _, packed, pid, checksum, errors = b.u(1), b.take(3), b.u(1), b.u(1), b.u(1), b.u(1)
    size, kind, form = packed >> 4, packed >> 2 & 3, packed & 3
    body = b.take(min(size, b.left))
    yield "lin", 1, data[: 8 + len(body)]
    yield "lin.message_format", 2, revision
    yield "lin.message_type", 2, LIN_TYPES[kind]
    if kind == 3:
        return
    yield "lin.checksum_type", 2, LIN_CHECKSUMS[form]
    yield "lin.pid", 2, pid
    yield "lin.id", 2, pid & 63
    yield "lin.parity", 2, pid >> 6
    yield "lin.parity.valid", 2, lin_parity(pid & 63) == pid >> 6
    yield "lin.length", 2, size
    yield "lin.checksum", 2, checksum
    if len(body) == size and form in (1, 2):
        yield "lin.checksum.status", 2, "Good" if lin_checksum(body, pid if form == 2 else 0) == checksum else "Bad"
    yield "lin.errors", 2, errors
    yield "lin.data", 2, body


@register("flexray")
def flexray(data: bytes) -> Iterator[Node]:
    """Channel and error flags, then the five bytes of the bus header and the payload."""
    b = Bytes(data)
    measured, errors = b.u(1), b.u(1)
    yield "flexray", 1, data
    yield "flexray.channel", 2, "B" if measured & 128 else "A"
    for name, bit in (("fcrc_err", 4), ("hcrc_err", 3), ("fes_err", 2), ("cod_err", 1), ("tss_viol", 0)):
        yield f"flexray.{name}", 2, bool(errors >> bit & 1)
    head = b.u(5)
    for name, bit in (("ppi", 38), ("nfi", 37), ("sfi", 36), ("stfi", 35)):
        yield f"flexray.{name}", 2, bool(head >> bit & 1)
    yield "flexray.frame_id", 2, head >> 24 & 0x7FF
    words = head >> 17 & 0x7F
    yield "flexray.payload_length", 2, 2 * words
    yield "flexray.hcrc", 2, head >> 6 & 0x7FF
    yield "flexray.cycle", 2, head & 63
    yield "flexray.data", 2, b.take(min(2 * words, b.left))


from framelake.dissect import options as _options  # noqa: E402, F401  these register their layers here, on executors too
from framelake.dissect import someip as _someip  # noqa: E402, F401
