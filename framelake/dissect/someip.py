"""SOME/IP beyond its header: service discovery, segments, payloads by configuration, and end-to-end protection.

A payload's type is plain JSON: {"type": "uint16"}, {"type": "string", "length_bytes": 4},
{"type": "array", "of": .., "length_bytes": 4} or with "count", {"type": "struct", "members":
[{"name": .., "type": ..}, ..]}, {"type": "enum", "base": "uint8", "names": {"1": "on"}}. Numbers are
big-endian unless "little" is set. Length fields count bytes.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.dissect.app import Bytes, Malformed, Node, register

#: struct codes of the base types.
BASE = {"uint8": "B", "sint8": "b", "uint16": "H", "sint16": "h", "uint32": "I", "sint32": "i", "uint64": "Q", "sint64": "q", "float32": "f", "float64": "d", "bool": "?"}
ENTRY = {0: "find", 1: "offer", 6: "subscribe", 7: "subscribe_ack"}


@register("someip_sd")
def service_discovery(data: bytes) -> Iterator[Node]:
    """Flags, entries of services and event groups, and options."""
    b = Bytes(data)
    yield "someip_sd", 1, data
    flags = b.u(1)
    b.take(3)
    yield "someip_sd.flags.reboot", 2, bool(flags & 128)
    yield "someip_sd.flags.unicast", 2, bool(flags & 64)
    size = b.u(4)
    if size % 16:
        raise Malformed("entries aren't whole")
    entries = Bytes(b.take(size))
    while entries.left:
        yield "someip_sd.entry", 2, None
        kind, first, second, numbers, service, instance, rest, last = (entries.u(n) for n in (1, 1, 1, 1, 2, 2, 4, 4))
        major, ttl = rest >> 24, rest & 0xFFFFFF
        yield "someip_sd.entry.type", 3, kind
        yield "someip_sd.entry.kind", 3, ("stop_" if kind in (1, 6) and ttl == 0 else "") + ENTRY.get(kind, "unknown")
        for name, value in (("index1", first), ("index2", second), ("count1", numbers >> 4), ("count2", numbers & 15), ("serviceid", service), ("instanceid", instance), ("major", major), ("ttl", ttl)):
            yield f"someip_sd.entry.{name}", 3, value
        if kind < 4:
            yield "someip_sd.entry.minor", 3, last
        else:
            yield "someip_sd.entry.counter", 3, last >> 16 & 15
            yield "someip_sd.entry.eventgroupid", 3, last & 0xFFFF
    options = Bytes(b.take(b.u(4)))
    while options.left:
        yield "someip_sd.option", 2, None
        n, kind = options.u(2), options.u(1)
        body = options.take(n)[1:]
        yield "someip_sd.option.type", 3, kind
        wide = 16 if kind in (0x06, 0x16, 0x26) else 4
        if kind == 1:
            items = Bytes(body)
            while items.left and (size := items.u(1)):
                yield "someip_sd.option.config", 3, items.take(size).decode("utf-8", "replace")
        elif kind in (0x04, 0x14, 0x24, 0x06, 0x16, 0x26):
            if len(body) < wide + 4:
                raise Malformed("option too short")
            yield "someip_sd.option.address", 3, str(ipaddress.ip_address(body[:wide]))
            yield "someip_sd.option.protocol", 3, body[wide + 1]
            yield "someip_sd.option.port", 3, int.from_bytes(body[wide + 2 : wide + 4], "big")
        else:
            yield "someip_sd.option.data", 3, body


@register("someip_tp")
def segment(data: bytes) -> Iterator[Node]:
    """The payload of a message whose type has the bit 0x20: its place in bytes, whether more follow, and its part."""
    b = Bytes(data)
    word = b.u(4)
    yield "someip_tp", 1, data
    yield "someip_tp.offset", 2, word & 0xFFFFFFF0
    yield "someip_tp.more", 2, bool(word & 1)
    yield "someip_tp.data", 2, b.take(b.left)


def payload(spec: dict, data: bytes, name: str = "value", depth: int = 1) -> Iterator[Node]:
    """Nodes of data by its type; what follows is a node `rest`."""
    b = Bytes(data)
    yield from _value(spec, b, name, depth)
    if b.left:
        yield "rest", depth, b.take(b.left)


def _value(spec: dict, b: Bytes, name: str, depth: int) -> Iterator[Node]:
    kind, order = spec["type"], "little" if spec.get("little") else "big"
    number = lambda base: struct.unpack(("<" if spec.get("little") else ">") + BASE[base], b.take(struct.calcsize("=" + BASE[base])))[0]
    inner = lambda: Bytes(b.take(int.from_bytes(b.take(spec["length_bytes"]), order)))
    if depth > 64:
        raise Malformed("too deep")
    if kind in BASE:
        yield name, depth, number(kind)
    elif kind == "enum":
        value = number(spec["base"])
        yield name, depth, value
        yield f"{name}.name", depth + 1, spec["names"].get(str(value), "unknown")
    elif kind == "string":
        raw = inner().data if spec.get("length_bytes") else b.take(spec["count"])
        mark = raw[:3]
        code, skip = ("utf-16-be", 2) if mark[:2] == b"\xfe\xff" else ("utf-16-le", 2) if mark[:2] == b"\xff\xfe" else ("utf-8", 3 if mark == b"\xef\xbb\xbf" else 0)
        yield name, depth, raw[skip:].decode(code, "replace").rstrip("\0")
    elif kind == "array":
        yield name, depth, None
        if spec.get("length_bytes"):
            items = inner()
            while items.left:
                before = items.left
                yield from _value(spec["of"], items, f"{name}.item", depth + 1)
                if items.left == before:
                    raise Malformed("items of no length")
        else:
            for _ in range(spec["count"]):
                yield from _value(spec["of"], b, f"{name}.item", depth + 1)
    elif kind == "struct":
        yield name, depth, None
        items = inner() if spec.get("length_bytes") else b
        for member in spec["members"]:
            yield from _value(member, items, f"{name}.{member['name']}", depth + 1)
    else:
        raise ValueError(f"no such type: {kind}")


def decode(df: DataFrame, specs: dict[tuple[int, int], dict], service: str = "serviceid", method: str = "methodid", data: str = "payload") -> DataFrame:
    """df with the column values: array of (name, depth, text) by the type of (service, method); null where there is none."""

    def one(s, m, raw):
        spec = specs.get((s, m)) if raw is not None else None
        if spec is None:
            return None
        out = []
        try:
            for name, depth, value in payload(spec, bytes(raw)):
                out.append((name, depth, None if value is None else bytes(value).hex() if isinstance(value, bytes) else str(value).lower() if isinstance(value, bool) else str(value)))
        except Malformed as e:
            out.append(("packet.error", 1, str(e)))
        return out

    @F.pandas_udf("array<struct<name: string, depth: int, text: string>>")
    def run(s: pd.Series, m: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([None if (v := one(*x)) is None else [dict(zip(("name", "depth", "text"), n, strict=True)) for n in v] for x in zip(s, m, raw, strict=True)], dtype=object)

    return df.withColumn("values", run(F.col(service), F.col(method), F.col(data)))


# end-to-end protection


def _crc_table(poly: int) -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ poly if c & 1 else c >> 1
        out.append(c)
    return out


#: The polynomial 0xF4ACFB13 with its bits in reverse.
CRC32_P4 = _crc_table(0xC8DF352F)


def crc32_p4(data: bytes, start: int = 0) -> int:
    c = start ^ 0xFFFFFFFF
    for x in data:
        c = c >> 8 ^ CRC32_P4[(c ^ x) & 255]
    return c ^ 0xFFFFFFFF


def protect_p4(data_id: int, counter: int, body: bytes) -> bytes:
    """Profile 4: length, counter, data id and checksum before the body."""
    head = struct.pack(">HHI", len(body) + 12, counter & 0xFFFF, data_id)
    return head + struct.pack(">I", crc32_p4(head + body)) + body


def check_p4(data_id: int, data: bytes, last: int | None = None, most: int = 1) -> str:
    """ok, repeated, lost, wrong_crc, wrong_id or too_short. last: the counter before; most: the steps it may take."""
    if len(data) < 12:
        return "too_short"
    size, counter, ident, crc = struct.unpack(">HHII", data[:12])
    if size != len(data) or crc32_p4(data[:8] + data[12:]) != crc:
        return "wrong_crc"
    if ident != data_id:
        return "wrong_id"
    step = 1 if last is None else (counter - last) & 0xFFFF
    return "repeated" if step == 0 else "ok" if step <= most else "lost"
