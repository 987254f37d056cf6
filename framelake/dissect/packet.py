"""Whole packets: the fixed headers, the layers above them, streams and meta fields, all of them fields to filter, project and store.

Which fields are made is decided by the names that are asked for: headers are column programs, the
layers above come from one pass of Python over the payloads that have one, and stream numbers and
analysis from one pass over each connection, if and only if something names them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from framelake.catalog import Catalog
from framelake.dissect import app, fields, wire
from framelake.functions import text as X
from framelake.functions import wire as W
from framelake.functions.stage import staged
from framelake.lang import nodes as N
from framelake.lang.parser import parse
from framelake.plans.compiler import Layout, apply_filter
from framelake.types import NODE_TYPES, SPARK
from framelake.types import FieldType as T

META = {"packet.id": T.U64, "packet.time": T.TIMESTAMP, "packet.info": T.STRING, "packet.error": T.STRING, "frame.data": T.BYTES, "frame.interface_id": T.U64}
#: Made by one ordered pass over each connection.
STREAMS = {"tcp.stream": T.U64, "udp.stream": T.U64}
ANALYSIS = {
    **{f"tcp.analysis.{n}": T.BOOL for n in ("retransmission", "fast_retransmission", "spurious_retransmission", "out_of_order", "lost_segment", "duplicate_ack", "keep_alive", "keep_alive_ack", "zero_window", "zero_window_probe", "zero_window_probe_ack", "window_full", "window_update", "reused_ports")},
    "tcp.analysis.ack_rtt": T.U64, "tcp.analysis.rto": T.U64, "tcp.analysis.bytes_in_flight": T.U64, "tcp.analysis.dup_acks": T.U64,
    "tcp.window_size": T.U64, "tcp.connection.phase": T.STRING, "tcp.completeness": T.U64, "tcp.time_delta": T.U64,
}

#: The fields of cooked headers: link type, offset and width.
COOKED = {
    "sll.pkttype": (wire.SLL, 0, 2), "sll.hatype": (wire.SLL, 2, 2), "sll.halen": (wire.SLL, 4, 2), "sll.src.eth": (wire.SLL, 6, 6), "sll.etype": (wire.SLL, 14, 2),
    "sll2.etype": (wire.SLL2, 0, 2), "sll2.reserved": (wire.SLL2, 2, 2), "sll2.if_index": (wire.SLL2, 4, 4), "sll2.hatype": (wire.SLL2, 8, 2), "sll2.pkttype": (wire.SLL2, 10, 1), "sll2.halen": (wire.SLL2, 11, 1), "sll2.src.eth": (wire.SLL2, 12, 6),
}

PostParser = Callable[[DataFrame], DataFrame]
#: name -> (fields it adds, the function that adds their columns); run in order after all layers.
POST_PARSERS: dict[str, tuple[dict[str, T], PostParser]] = {}


def register_post_parser(protocol: str, adds: dict[str, T], run: PostParser) -> None:
    """run: a function of the packets that adds an array column for each of its fields; what it adds can be filtered like any other."""
    POST_PARSERS[protocol] = (adds, run)


def layout() -> Layout:
    """Everything there is to name."""
    c = Catalog()
    for p in dict.fromkeys(["packet", "frame", "eth", "vlan", "arp", "ip", "ipv6", "icmp", "icmpv6", "udp", "tcp", "data", *fields.FIELDS, *POST_PARSERS]):
        c.protocol(p)
    for name, (kind, ui) in wire.FIELDS.items():
        c.add(name, kind, ui_name=ui)
    for name, kind in {**META, **STREAMS, **ANALYSIS}.items():
        c.add(name, kind, ui_name=name.split(".")[-1].replace("_", " ").capitalize())
    for protocol, groups in fields.FIELDS.items():
        for kind, names in groups.items():
            for name in names:
                if name != protocol:
                    c.add(name, kind, protocol, ui_name=name.split(".")[-1].replace("_", " ").capitalize())
    for protocol, (adds, _) in POST_PARSERS.items():
        for name, kind in adds.items():
            c.add(name, kind, protocol)
    for alias, members in {"eth.addr": ("eth.src", "eth.dst"), "ip.addr": ("ip.src", "ip.dst"), "ipv6.addr": ("ipv6.src", "ipv6.dst"), "tcp.port": ("tcp.srcport", "tcp.dstport"), "udp.port": ("udp.srcport", "udp.dstport")}.items():
        c.alias(alias, members)
    return Layout(c.build(), {f: f for f in c.fields}, nodes="nodes", trees=frozenset(fields.FIELDS), exhaustive=not POST_PARSERS, carriers=dict(fields.CARRIER))


def names_of(text: str, lay: Layout) -> tuple[set[str], set[str]]:
    """The fields and the protocols that an expression names; those inside a scope need the tree, and are given as `nodes`."""
    out: set[str] = set()
    protocols: set[str] = set()
    for n in N.walk(parse(text)):
        name = getattr(n, "name", None) or getattr(getattr(n, "operand", None), "name", None)
        if isinstance(n, N.Scope):
            out.add("nodes")
        if not name:
            continue
        if name in lay.catalog.protocols:
            protocols.add(name)
        elif name in lay.catalog.fields or name in lay.catalog.aliases:
            out |= {f.name for f in lay.catalog.members(name)}
    return out, protocols


def _value(kind: T, v: object) -> object:
    if kind == T.NONE:
        return True
    if kind == T.F64:
        return float(v)
    if kind in (T.STRING, T.BOOL, T.BYTES, T.IPV6):
        return bytes(v) if isinstance(v, (bytearray, memoryview)) else v
    return v if v is not None and v < 1 << 63 else None


def parsed(names: Iterable[str], tree: bool) -> Column:
    """A struct of the wanted fields of the layers above (arrays), the layers met, what was wrong, and the tree."""
    kinds = {n: k for n, k in fields.kinds().items() if n in set(names)}
    types = [S.StructField(n, S.ArrayType(S.BooleanType() if k == T.NONE else S._parse_datatype_string(SPARK[k]))) for n, k in kinds.items()]
    types += [S.StructField("layers", S.ArrayType(S.StringType())), S.StructField("errors", S.ArrayType(S.StringType()))]
    node = S._parse_datatype_string("struct<name: string, node_id: int, parent: int, depth: int, stop: int, " + ", ".join(f"{k}: {t}" for k, t in NODE_TYPES.items()) + ">")
    if tree:
        types.append(S.StructField("nodes", S.ArrayType(node)))
    wanted = dict(kinds)

    @F.pandas_udf(S.StructType(types))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for apps, payloads in batches:
            columns: dict[str, list] = {n: [] for n in [*wanted, "layers", "errors", *(["nodes"] if tree else [])]}
            for name, payload in zip(apps, payloads, strict=True):
                row: dict[str, list] = {n: [] for n in columns}
                if name is not None and payload is not None:
                    if tree:
                        for i, parent, depth, stop, label, i64, f64, text, raw, flag in app.nodes_of(name, bytes(payload)):
                            row["nodes"].append({"name": label, "node_id": i, "parent": parent, "depth": depth, "stop": stop, "i64": i64, "f64": f64, "str": text, "bin": raw, "dec": None, "bool": flag})
                    for label, depth, v in app.nodes_safely(name, bytes(payload)):
                        if label == "packet.error":
                            row["errors"].append(v)
                        elif depth == 1:
                            row["layers"].append(label)
                        if label in wanted and (value := _value(wanted[label], v)) is not None:
                            row[label].append(value)
                for n, values in row.items():
                    columns[n].append(values)
            yield pd.DataFrame(columns)

    return run(F.col("app"), F.col("payload"))


def info() -> Column:
    """A line about the packet: its innermost layer and what tells it from others."""
    one = lambda name: F.try_element_at(F.col(f"`{name}`"), F.lit(-1))
    ports = lambda p: F.concat(one(f"{p}.srcport").cast("string"), F.lit(" -> "), one(f"{p}.dstport").cast("string"))
    set_ = F.array_compact(F.array(*[F.when(one(f"tcp.flags.{n}"), n[:3].upper()) for n in ("syn", "fin", "reset", "push", "ack", "urg")]))
    tcp = F.concat(ports("tcp"), F.lit(" ["), F.array_join(set_, ", "), F.lit("] Seq="), one("tcp.seq").cast("string"), F.lit(" Len="), one("tcp.len").cast("string"))
    udp = F.concat(ports("udp"), F.lit(" Len="), (one("udp.length") - 8).cast("string"))
    arp = F.when(one("arp.opcode") == 1, F.concat(F.lit("Who has "), X.ipv4(one("arp.dst.proto_ipv4")), F.lit("? Tell "), X.ipv4(one("arp.src.proto_ipv4")))).otherwise(F.concat(X.ipv4(one("arp.src.proto_ipv4")), F.lit(" is at "), X.mac(one("arp.src.hw_mac"))))
    inner = F.try_element_at(F.col("protocols"), F.lit(-1))
    return F.coalesce(F.when(F.size("`tcp.seq`") > 0, tcp), F.when(F.size("`udp.length`") > 0, udp), F.when(F.size("`arp.opcode`") > 0, arp), F.concat(F.lit("Layer "), inner))


TRANSPORT = ("icmp.", "icmpv6.", "udp.", "tcp.", "data.")


def with_datagrams(frames: DataFrame) -> DataFrame:
    """wire.dissect(), where the fragment that completes an IPv4 or IPv6 datagram has the layers that the datagram holds.

    Fragments are dealt by datagram; the headers of the network layer stay those of the frame.
    """
    from framelake.operators import reassembly

    base, h = wire.dissect(frames), wire.headers(frames)
    d, l3, at = F.col("__d"), F.col("__l3"), F.col("__chain.at").cast("int")
    stop4 = F.least(F.col("__size"), l3 + F.greatest(W.be(d, l3 + 2, 2), F.col("__hl"))).cast("int")
    v4 = h.filter(F.col("__ip") & (F.col("__frag").bitwiseAND(F.lit(0x3FFF)) != 0)).select(
        F.col("frame_id").alias("packet_id"), F.hex(F.substring(d, l3 + 13, F.lit(8))).alias("ends"), W.be(d, l3 + 9, 1).alias("proto"), W.be(d, l3 + 4, 2).alias("ident"),
        (F.col("__frag").bitwiseAND(F.lit(0x1FFF)) * 8).alias("offset"), (F.col("__frag").bitwiseAND(F.lit(0x2000)) != 0).alias("more"), W.raw(d, l3 + F.col("__hl").cast("int"), stop4).alias("data"),
    )
    word = W.be(d, at + 2, 2)
    v6 = h.filter(F.col("__v6") & (F.col("__chain.nx") == 44) & (F.col("__size") >= at + 8)).select(
        F.col("frame_id").alias("packet_id"), F.hex(F.substring(d, l3 + 9, F.lit(32))).alias("ends"), W.be(d, at, 1).alias("proto"), W.be(d, at + 4, 4).alias("ident"),
        F.shiftright(word, 3).alias("units"), (word.bitwiseAND(F.lit(1)) != 0).alias("more"), W.raw(d, at + 8, F.least(F.col("__size"), l3 + 40 + W.be(d, l3 + 4, 2)).cast("int")).alias("data"),
    ).withColumn("offset", F.col("units") * 8).drop("units")
    keys = ["ends", "proto", "ident"]
    done = None
    for parts, policy, version in ((v4, reassembly.IPV4, 4), (v6, reassembly.IPV6, 6)):
        whole = reassembly.reassemble(parts.filter("data is not null"), keys, policy).filter("outcome = 'complete'").select("packet_id", "payload", F.lit(version).alias("version"))
        done = whole if done is None else done.unionAll(whole)
    parts_of = v4.select("packet_id", "ends", "proto").unionAll(v6.select("packet_id", "ends", "proto"))
    n = F.octet_length("payload")
    four = F.concat(wire.hexed("00" * 12 + "08004500"), W.be_bytes(n + 20, 2), wire.hexed("0000000040"), W.be_bytes(F.col("proto"), 1), wire.hexed("0000"), F.unhex("ends"), F.col("payload"))
    six = F.concat(wire.hexed("00" * 12 + "86dd60000000"), W.be_bytes(n, 2), W.be_bytes(F.col("proto"), 1), wire.hexed("40"), F.unhex("ends"), F.col("payload"))
    rebuilt = done.join(parts_of, "packet_id").select(F.col("packet_id").alias("frame_id"), F.lit(0).cast("bigint").alias("timestamp_ns"), F.when(F.col("version") == 4, four).otherwise(six).alias("data"))
    inner = [c for c in base.columns if c.startswith(TRANSPORT)]
    more = wire.dissect(rebuilt).select(F.col("packet_id").alias("__id"), F.slice("protocols", F.lit(4), F.size("protocols")).alias("__layers"), *[F.col(f"`{c}`").alias(f"__{c}") for c in [*inner, "app", "payload"]])
    out = base.join(more, F.col("packet_id") == F.col("__id"), "left")
    there = F.col("__id").isNotNull()
    changed = {c: F.when(there, F.col(f"`__{c}`")).otherwise(F.col(f"`{c}`")) for c in [*inner, "app", "payload"]}
    return out.withColumns({**changed, "protocols": F.when(there, F.concat("protocols", "__layers")).otherwise(F.col("protocols"))}).select(*[F.col(f"`{c}`") for c in base.columns])


def packets(frames: DataFrame, names: Iterable[str] | None = None, protocols: Iterable[str] = (), datagrams: bool = False) -> DataFrame:
    """(packet_id, timestamp_ns, protocols, an array for each field, app, payload, errors) of frames (frame_id, timestamp_ns, data, perhaps link_type and interface_id).

    names: the fields that are wanted besides those of the fixed headers, and `nodes` for the tree; None is all of them.
    datagrams: fragments are put together first, see with_datagrams().
    """
    lay = layout()
    wanted = set(names) if names is not None else {*lay.catalog.fields, "nodes"}
    raw = frames
    df = with_datagrams(frames) if datagrams else wire.dissect(frames)
    above = [n for n in fields.kinds() if n in wanted and n not in COOKED]
    inside = set(protocols) & set(fields.CARRIER)
    meta = {"packet.id": F.array("packet_id"), "packet.time": F.array("timestamp_ns")}
    if above or inside or wanted & {"nodes", "packet.error"}:
        df = staged(df, **{"__app": parsed(above, "nodes" in wanted)})
        df = df.select("*", *[F.col(f"__app.`{n}`").alias(n) for n in above], *([F.col("__app.nodes").alias("nodes")] if "nodes" in wanted else []))
        df = df.withColumn("errors", F.concat("errors", "__app.errors"))
        if inside:
            df = df.withColumn("protocols", F.concat("protocols", F.array_except("__app.layers", "protocols")))
        df = df.drop("__app")
    meta["packet.error"] = F.col("errors")
    if "packet.info" in wanted:
        meta["packet.info"] = F.array(info())
    df = df.withColumns({n: c for n, c in meta.items() if n in wanted})
    df = df.withColumn("protocols", F.concat(F.array(F.lit("packet")), "protocols"))
    extra = {"frame.data": F.array("data"), "frame.interface_id": F.array(F.col("interface_id").cast("bigint") if "interface_id" in raw.columns else F.lit(0).cast("bigint"))}
    for name, (link, at, width) in COOKED.items():
        value = F.when(F.col("link_type") == link, W.be(F.col("data"), at, width)) if "link_type" in raw.columns else F.lit(None).cast("bigint")
        extra[name] = F.array_compact(F.array(value))
    if wanted & set(extra):
        own = raw.select(F.col("frame_id").alias("packet_id"), *[c.alias(n) for n, c in extra.items() if n in wanted])
        df = df.join(own, "packet_id")
    if wanted & {*STREAMS, *ANALYSIS}:
        from framelake.operators import tcp

        df = tcp.add_streams(df, wanted & {*STREAMS, *ANALYSIS})
    for adds, run in POST_PARSERS.values():
        if wanted & set(adds):
            df = run(df)
    return df


def find(frames: DataFrame, text: str, show: Iterable[str] = (), short_circuit: bool = False, datagrams: bool = False) -> DataFrame:
    """The packets that match, with the columns that the expression names and those to be shown."""
    lay = layout()
    names, protocols = names_of(text, lay)
    return apply_filter(packets(frames, names | set(show), protocols, datagrams), text, lay, short_circuit)
