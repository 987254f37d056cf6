"""Outputs: the dataset of tables, text formats, and capture files."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from framelake.catalog import Field
from framelake.functions import text as T
from framelake.operators import projection
from framelake.plans.compiler import Layout
from framelake.types import NODE_COLUMN, NODE_TYPES, FieldType, default_text

CODECS = ("none", "snappy", "gzip", "brotli", "lz4", "zstd")
LAYOUT_VERSION = 1


def dataset_rows(df: DataFrame, layout: Layout, names: Iterable[str] | None = None, occurrences: str = "all", hierarchy: bool = False, node_ids: bool = False) -> DataFrame:
    """(table, packet_id, position, timestamp_ns, parent, name, and a column for each storage class): what all tables of a dataset hold, in one pass over the packets.

    table: `packets`, `topology` for trees, or a field's name. position: the occurrence, or with node_ids the node's id.
    """
    fields = {f.name: f for f in _fields(layout, names)}
    classes = [(k, t) for k, t in NODE_TYPES.items()]

    def row(table: Column, position: Column, value: Column | None = None, kind: str = "", **more: Column) -> Column:
        members = {"table": table, "position": position.cast("int"), "timestamp_ns": F.lit(None).cast("bigint"), "parent": F.lit(None).cast("int"), "name": F.lit(None).cast("string"), **{k: F.lit(None).cast(t) for k, t in classes}, **more}
        if value is not None:
            members[kind] = value.cast(NODE_TYPES[kind])
        return F.struct(*[c.alias(k) for k, c in members.items()])

    parts = [F.array(row(F.lit("packets"), F.lit(0), timestamp_ns=F.col(layout.timestamp)))]
    if hierarchy:
        nodes = F.col(layout.nodes)
        parts.append(F.transform(nodes, lambda n: row(F.lit("topology"), n["node_id"], parent=n["parent"], name=n["name"])))
    if hierarchy and node_ids:
        valued = F.filter(F.col(layout.nodes), lambda n: n["name"].isin(list(fields)))
        parts.append(F.transform(valued, lambda n: row(n["name"], n["node_id"], **{k: n[k] for k, _ in classes})))
    else:
        for f in fields.values():
            values = F.col(f"`{layout.columns[f.name]}`")
            if occurrences != "all":
                values = F.slice(values, 1 if occurrences == "first" else -1, 1)
            parts.append(_rows_of(values, f, row))
    return df.select(F.col(layout.packet_id).alias("packet_id"), F.explode(F.concat(*parts)).alias("r")).select("r.table", "packet_id", "r.position", "r.timestamp_ns", "r.parent", "r.name", *[f"r.{k}" for k, _ in classes])


def _rows_of(values: Column, f: Field, row) -> Column:
    return F.transform(values, lambda v, i: row(F.lit(f.name), i, v, NODE_COLUMN[f.type]))


def _fields(layout: Layout, names: Iterable[str] | None) -> list[Field]:
    return layout.catalog.select(names) if names is not None else [f for f in layout.catalog.fields.values() if f.type != FieldType.NONE and f.name in layout.columns]


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_dataset(df: DataFrame, layout: Layout, path: str, names: Iterable[str] | None = None, occurrences: str = "all", hierarchy: bool = False, codec: str = "zstd", overwrite: bool = False, buffers: Iterable[str] = (), node_ids: bool = False) -> None:
    """packets, a table for each field, catalog, protocols, export_info and, for trees, topology; each a Parquet folder.

    The packets are read once: their rows are written by table beside the dataset, and each table is made from its own
    part. The dataset is put together under another name and moved to its place when it is whole. packets
    has info and frame_bytes where df has `packet.info` and `frame.data`; buffers: columns of further bytes, for packet_buffers;
    node_ids: the rows of a tree's fields have their node's id, which topology has too, instead of their occurrence.
    """
    if codec not in CODECS:
        raise ValueError(f"codec is one of {', '.join(CODECS)}")
    spark, names = df.sparkSession, list(names) if names is not None else None
    fs, place = _folder(spark, path)
    if fs.exists(place) and not overwrite:
        raise FileExistsError(f"{path} already exists")
    fields = _fields(layout, names)
    made = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows_at = f"{made}/_rows"

    def put(table: DataFrame, name: str) -> None:
        table.write.option("compression", codec).parquet(f"{made}/{name}")

    dataset_rows(df, layout, names, occurrences, hierarchy, node_ids).withColumn("part", F.regexp_replace("table", "[^A-Za-z0-9_]", "_")).write.partitionBy("part").parquet(rows_at)
    rows = spark.read.parquet(rows_at)
    of = lambda table: rows.filter(F.col("part") == re.sub("[^A-Za-z0-9_]", "_", table)).filter(F.col("table") == table)
    packets = of("packets").select("packet_id", "timestamp_ns")
    extra = {"info": "packet.info", "frame_bytes": "frame.data"}
    there = {k: c for k, c in extra.items() if c in df.columns}
    if there:
        packets = packets.join(df.select(F.col(layout.packet_id).alias("packet_id"), *[F.try_element_at(F.col(f"`{c}`"), F.lit(1)).alias(k) for k, c in there.items()]), "packet_id")
    put(packets, "packets")
    for f in fields:
        put(of(f.name).select("packet_id", F.col("position").alias("node_id" if hierarchy and node_ids else "occurrence"), F.col(NODE_COLUMN[f.type]).alias("value")), f"field_{layout.catalog.field_id(f.name)}")
    put(layout.catalog.frame(spark), "catalog")
    put(layout.catalog.protocol_frame(spark), "protocols")
    if hierarchy:
        put(of("topology").select("packet_id", F.col("position").alias("node_id"), "name", F.col("parent").alias("parent_node_id")), "topology")
    buffers = list(buffers)
    if buffers:
        each = F.array(*[F.struct(F.lit(i + 1).alias("buffer_index"), F.try_element_at(F.col(f"`{c}`"), F.lit(1)).cast("binary").alias("bytes")) for i, c in enumerate(buffers)])
        put(df.select(F.col(layout.packet_id).alias("packet_id"), F.inline(F.filter(each, lambda x: x["bytes"].isNotNull()))), "packet_buffers")
    info = {"shape": "hierarchy" if hierarchy else "selected" if names is not None else "all", "fields": ",".join(f.name for f in fields), "occurrences": occurrences, "layout_version": str(LAYOUT_VERSION)}
    put(spark.createDataFrame(list(info.items()), "key string, value string"), "export_info")
    fs.delete(_folder(spark, rows_at)[1], True)
    if fs.exists(place):
        fs.delete(place, True)
    if not fs.rename(_folder(spark, made)[1], place):
        raise OSError(f"{made} can't be moved to {path}")


def write_duckdb(dataset: str, file: str) -> None:
    """The tables of a dataset on a mounted folder, as one DuckDB file."""
    import duckdb

    with duckdb.connect(file) as con:
        for name in sorted(os.listdir(dataset)):
            if os.path.isdir(os.path.join(dataset, name)):
                con.execute(f"create or replace table \"{name}\" as select * from read_parquet('{os.path.join(dataset, name)}/*.parquet')")


def csv_rows(df: DataFrame, layout: Layout, info: str | None = None, data: str | None = None) -> DataFrame:
    """No., Time, Info, and for a column of bytes Length and Bytes: text that could be a formula is guarded."""
    first = lambda c: F.try_element_at(F.col(f"`{c}`"), F.lit(1)) if dict(df.dtypes)[c].startswith("array") else F.col(f"`{c}`")
    shown = first(info).cast("string") if info else F.lit("")
    more = [F.octet_length(first(data)).cast("bigint").alias("Length"), T.hex_pairs(first(data)).alias("Bytes")] if data else []
    return df.select(F.col(layout.packet_id).alias("No."), T.iso_ns(F.col(layout.timestamp)).alias("Time"), T.formula_guard(shown).alias("Info"), *more)


def _quoted(text: Column) -> Column:
    """A JSON string."""
    inner = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(inner, F.lit(2), F.length(inner) - 2))


def json_trees(df: DataFrame, layout: Layout, keep: Iterable[str] | None = None, indent: bool = False) -> DataFrame:
    """(packet_id, json): the tree of each packet, children inside their container, in order. keep: the leaves that are wanted.

    Nodes come in pre-order, so that what stands between two of them follows from their depths alone.
    """
    wanted = list(keep) if keep is not None else None
    nodes = F.col(layout.nodes)
    if wanted is not None:
        nodes = F.filter(nodes, lambda n: (n["stop"] > n["node_id"]) | n["name"].isin(wanted))
    rows = df.select(F.col(layout.packet_id).alias("packet_id"), F.inline(F.array(F.struct(nodes.alias("n")))))

    def text(n: Column, i: Column) -> Column:
        number = F.to_json(F.array(n["f64"]))
        value = F.coalesce(_quoted(n["str"]), n["i64"].cast("string"), F.when(n["f64"].isNotNull(), F.substring(number, F.lit(2), F.length(number) - 2)), n["bool"].cast("string"), n["dec"].cast("string"), F.concat(F.lit('"'), F.lower(F.hex(n["bin"])), F.lit('"')))
        before = F.get(F.col("n"), i - 1)["depth"]
        between = F.when(i == 0, "").when(n["depth"] > before, ',"fields":[').otherwise(F.concat(F.lit("}"), F.repeat(F.lit("]}"), before - n["depth"]), F.lit(",")))
        return F.concat(between, F.lit('{"name":'), _quoted(n["name"]), F.coalesce(F.concat(F.lit(',"value":'), value), F.lit("")))

    last, first = F.try_element_at("n", F.lit(-1))["depth"], F.try_element_at("n", F.lit(1))["depth"]
    end = F.when(F.size("n") > 0, F.concat(F.lit("}"), F.repeat(F.lit("]}"), last - first))).otherwise("")
    out = rows.select("packet_id", F.concat(F.lit("["), F.array_join(F.transform("n", text), ""), end, F.lit("]")).alias("json"))
    return out.withColumn("json", _pretty("json")) if indent else out


def _pretty(column: str) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), indent=2, ensure_ascii=False))

    return run(F.col(column))


def json_object(*members: Column) -> Column:
    """One object of named columns; null members are left out."""
    return F.to_json(F.struct(*members))


def json_array(rows: DataFrame) -> DataFrame:
    """(json): the lines of a JSON array with an element a packet, for a text sink; its order is that of packet ids, in as many files as there are partitions."""
    return rows.orderBy("packet_id").select(F.concat(F.col("json"), F.lit(",")).alias("json"))


def json_flat(df: DataFrame, layout: Layout, names: Iterable[str] | None = None) -> DataFrame:
    """(packet_id, json): one object a packet, an array for each field; numbers and truth values as such, all else by its default text."""
    plain = (FieldType.I64, FieldType.U64, FieldType.F64, FieldType.BOOL, FieldType.STRING)

    def member(f: Field) -> Column:
        c = F.col(f"`{layout.columns[f.name]}`")
        return (c if f.type in plain else F.transform(c, lambda v: default_text(v, f.type))).alias(f.name)

    return df.select(F.col(layout.packet_id).alias("packet_id"), json_object(*[member(f) for f in _fields(layout, names)]).alias("json"))


def text_lines(df: DataFrame, layout: Layout, most_chars: int | None = None) -> DataFrame:
    """(packet_id, text): a display line for each node, indented by depth, control characters written out. most_chars: longer values end in an ellipsis."""
    ui = F.create_map(*[x for f in layout.catalog.fields.values() for x in (F.lit(f.name), F.lit(f.ui_name))], *[x for p, u in layout.catalog.protocols.items() for x in (F.lit(p), F.lit(u))])

    def line(n):
        value = _cut(projection.node_text(n, layout), most_chars)
        name = F.coalesce(F.try_element_at(ui, n["name"]), n["name"])
        return F.concat(F.repeat(F.lit("  "), n["depth"] - 1), name, F.coalesce(F.concat(F.lit(": "), T.escape_line(value)), F.lit("")))

    return df.select(F.col(layout.packet_id).alias("packet_id"), F.array_join(F.transform(layout.nodes, line), "\n").alias("text"))


def _cut(text: Column, most_chars: int | None) -> Column:
    return text if most_chars is None else F.when(F.length(text) > most_chars, F.concat(F.substring(text, 1, most_chars), F.lit("…"))).otherwise(text)


def text_flat(df: DataFrame, layout: Layout, names: Iterable[str] | None = None, most_chars: int | None = None) -> DataFrame:
    """(packet_id, text): the lines of layouts without a tree: a heading for each protocol, below it its fields."""
    parts: list[Column] = []
    fields = _fields(layout, names)
    for protocol in dict.fromkeys(f.protocol for f in fields):
        own = [f for f in fields if f.protocol == protocol]
        lines = [_lines_of(layout, f, most_chars) for f in own]
        some = sum((F.size(F.col(f"`{layout.columns[f.name]}`")) for f in own), F.lit(0)) > 0
        parts.append(F.when(some, F.concat(F.array(F.lit(layout.catalog.protocols[protocol])), *lines)).otherwise(F.array().cast("array<string>")))
    return df.select(F.col(layout.packet_id).alias("packet_id"), F.array_join(F.concat(*parts), "\n").alias("text"))


def _lines_of(layout: Layout, f: Field, most_chars: int | None) -> Column:
    return F.transform(F.col(f"`{layout.columns[f.name]}`"), lambda v: F.concat(F.lit(f"  {f.ui_name}: "), T.escape_line(_cut(default_text(v, f.type), most_chars))))


def text_summary(df: DataFrame, layout: Layout, info: str | None = None) -> DataFrame:
    """(packet_id, text): one line a packet: its id, time, layers and, where there is one, its info."""
    more = [F.concat(F.lit(" "), T.escape_line(F.try_element_at(F.col(f"`{info}`"), F.lit(1))))] if info else []
    return df.select(F.col(layout.packet_id).alias("packet_id"), F.concat(F.col(layout.packet_id).cast("string"), F.lit(" "), T.iso_ns(F.col(layout.timestamp)), F.lit(" "), F.array_join(layout.protocols, "/"), *more).alias("text"))


# capture files


def pcap_bytes(frames: Iterable[tuple], link_type: int = 1) -> Iterator[bytes]:
    yield struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 262_144, link_type)
    for time, data, *_ in frames:
        yield struct.pack("<IIII", time // 10**9, time % 10**9, len(data), len(data)) + data


def pcapng_bytes(frames: Iterable[tuple], link_type: int = 1) -> Iterator[bytes]:
    yield struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    options = struct.pack("<HHB3xHH", 9, 1, 9, 0, 0)  # nanoseconds
    yield struct.pack("<IIHHI", 1, 20 + len(options), link_type, 0, 262_144) + options + struct.pack("<I", 20 + len(options))
    for time, data, *_ in frames:
        size = 32 + len(data) + -len(data) % 4
        yield struct.pack("<IIIIIII", 6, size, 0, time >> 32, time & 0xFFFFFFFF, len(data), len(data)) + data + b"\0" * (-len(data) % 4) + struct.pack("<I", size)


def _can_parts(data: bytes) -> tuple[int, bool, bool, int, bytes]:
    """(id with its long mark, remote, FD, flags, bytes) of a SocketCAN frame."""
    if len(data) < 8:
        raise ValueError("not a SocketCAN frame")
    word, size, flags = struct.unpack(">IBB", data[:6])
    return word & 0x9FFFFFFF, bool(word & 0x40000000), bool(flags & 4) or size > 8, flags, data[8 : 8 + size]


def _asc_line(time: int, data: bytes, channel: int, link_type: int) -> bytes:
    """A line of an Ethernet or a LIN message."""
    stamp = f"{time // 10**9}.{time % 10**9:09d}"
    if link_type == 1:
        if not 14 <= len(data) <= 1518:
            raise ValueError("not an Ethernet frame that a line holds")
        return f"{stamp} ETH {channel} Rx {len(data):x}:{data.hex().upper()}\n".encode()
    if len(data) < 8:
        raise ValueError("not a LIN frame")
    size, model = data[4] >> 4, {1: " CSM = classic", 2: " CSM = enhanced"}.get(data[4] & 3, "")
    value = "".join(f" {b:02X}" for b in data[8 : 8 + size])
    return f"{stamp} {'Li' if channel == 1 else f'L{channel}'} {data[5] & 63:X} Rx {size:x}{value} checksum = {data[6]:X}{model}\n".encode()


def asc_bytes(frames: Iterable[tuple], link_type: int = 227) -> Iterator[bytes]:
    """Lines of CAN and CAN FD, LIN or Ethernet messages with absolute times; the third of a frame is its channel, else 1."""
    if link_type not in (1, 212, 227):
        raise ValueError("ASC files hold Ethernet (1), LIN (212) or SocketCAN frames (227)")
    yield b"date Thu Jan 1 12:00:00 am 1970\nbase hex  timestamps absolute\nno internal events logged\n"
    for time, data, *more in frames:
        if link_type != 227:
            yield _asc_line(time, data, more[0] if more else 1, link_type)
            continue
        ident, remote, fd, flags, value = _can_parts(data)
        shown = f"{ident & 0x1FFFFFFF:X}" + ("x" if ident >> 31 else "")
        stamp, channel, body = f"{time // 10**9}.{time % 10**9:09d}", more[0] if more else 1, value.hex(" ").upper()
        if fd:
            code = next(i for i, n in enumerate((0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64)) if n >= len(value))
            line = f"{stamp} CANFD {channel} Rx {shown} {flags & 1} {flags >> 1 & 1} {code:x} {len(value)} {body}"
        else:
            line = f"{stamp} {channel} {shown} Rx r" + f" {len(value):x}" if remote else f"{stamp} {channel} {shown} Rx d {len(value):x} {body}"
        yield line.rstrip().encode() + b"\n"


def blf_bytes(frames: Iterable[tuple], link_type: int = 227, container: int = 1 << 17) -> Iterator[bytes]:
    """CAN, CAN FD or Ethernet objects in packed containers; the totals of the header are left zero, as in a log that is still open."""
    if link_type not in (1, 227):
        raise ValueError("BLF files hold Ethernet (1) or SocketCAN frames (227)")
    yield b"LOGG" + struct.pack("<I", 144) + bytes(136)

    def one(time: int, data: bytes, channel: int) -> bytes:
        if link_type == 1:
            if len(data) < 14:
                raise ValueError("not an Ethernet frame")
            kind, tpid, tci, rest = 71, 0, 0, data[12:]
            if rest[:2] in (b"\x81\x00", b"\x88\xa8") and len(rest) >= 6:
                (tpid, tci), rest = struct.unpack(">HH", rest[:4]), rest[4:]
            body = struct.pack("<6sH6sHHHHH8x", data[6:12], channel, data[:6], 0, int.from_bytes(rest[:2], "big"), tpid, tci, len(rest) - 2) + rest[2:]
        else:
            ident, remote, fd, flags, value = _can_parts(data)
            if fd:
                kind, bits = 101, 0x1000 | (flags & 1) << 13 | (flags & 2) << 13
                body = struct.pack("<BBBBIIIIIIIHBBI", channel, 0, len(value), 0, ident, 0, bits, 0, 0, 0, 0, 0, 0, 0, 0) + value
            else:
                kind, body = 1, struct.pack("<HBBI8s", channel, 0x80 if remote else 0, len(value), ident, value)
        size = 32 + len(body)
        return b"LOBJ" + struct.pack("<HHIIIHHQ", 32, 1, size, kind, 2, 0, 0, time) + body + bytes(size % 4)

    def pack(data: bytes) -> bytes:
        packed = zlib.compress(data)
        size = 32 + len(packed)
        return b"LOBJ" + struct.pack("<HHIIH6xI4x", 16, 1, size, 10, 2, len(data)) + packed + bytes(size % 4)

    held = bytearray()
    for time, data, *more in frames:
        held += one(time, data, more[0] if more else 1)
        if len(held) >= container:
            yield pack(bytes(held))
            held.clear()
    if held:
        yield pack(bytes(held))


WRITERS = {"pcap": pcap_bytes, "pcapng": pcapng_bytes, "asc": asc_bytes, "blf": blf_bytes}


class _Written(WriterCommitMessage):
    def __init__(self, path: str) -> None:
        self.path = path


class _Writer(DataSourceWriter):
    """One file a partition, given its name when the job is committed: the folder has to be shared."""

    def __init__(self, schema, options: dict, overwrite: bool) -> None:
        self.options, self.names = options, schema.fieldNames()
        folder = options["path"]
        if os.path.isdir(folder) and os.listdir(folder) and not overwrite:
            raise FileExistsError(folder)

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        kind, link = self.options.get("format", "pcapng"), int(self.options.get("link_type", 227 if self.options.get("format") == "asc" else 1))
        at_channel = self.names.index("interface_id") if "interface_id" in self.names else None
        at_time, at_data = self.names.index("timestamp_ns"), self.names.index("data")
        context = TaskContext.get()
        os.makedirs(self.options["path"], exist_ok=True)
        path = os.path.join(self.options["path"], f"_part-{context.partitionId():05d}-{context.taskAttemptId()}.{kind}")
        with open(path, "wb") as f:
            for chunk in WRITERS[kind](((r[at_time], bytes(r[at_data]), 1 if at_channel is None else r[at_channel]) for r in rows), link):
                f.write(chunk)
        return _Written(path)

    def commit(self, messages) -> None:
        for i, m in enumerate(x for x in messages if x is not None):
            folder, name = os.path.split(m.path)
            os.replace(m.path, os.path.join(folder, f"part-{i + 1:05d}.{name.rsplit('.', 1)[1]}"))

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class CaptureSink(DataSource):
    """df.write.format("capture_file").option("format", "pcapng").save(path); columns timestamp_ns, data and, for channels, interface_id."""

    @classmethod
    def name(cls) -> str:
        return "capture_file"

    def schema(self) -> str:
        return "timestamp_ns bigint, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, self.options, overwrite)
