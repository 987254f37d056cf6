"""Capture views: plain tables seen as packets, fields and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.catalog import Catalog
from framelake.functions.stage import staged
from framelake.functions.text import EPOCH
from framelake.plans.compiler import Container, Layout
from framelake.types import NODE_TYPES, FieldType


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are too few: what follows costs more than an exchange of the rows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def nanos(ts: str) -> Column:
    """Of a timestamp without a zone; microseconds are its precision."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) * 1000")


def node(name: str, node_id: Column, parent: Column, depth: int, stop: Column, **value: Column) -> Column:
    members = [F.lit(name).alias("name"), node_id.cast("int").alias("node_id"), parent.cast("int").alias("parent"), F.lit(depth).alias("depth"), stop.cast("int").alias("stop")]
    members += [(value[k] if k in value else F.lit(None)).cast(kind).alias(k) for k, kind in NODE_TYPES.items()]
    return F.struct(*members)


# C1: an event is a packet

EVENT_TYPES = ("click", "view", "purchase", "signup", "error")


def events_layout() -> Layout:
    c = Catalog().protocol("event", "Event")
    for name in EVENT_TYPES:
        c.protocol(name)
    c.add("event.type", FieldType.STRING, ui_name="Type").add("event.user_id", FieldType.U64, ui_name="User").add("event.value", FieldType.F64, ui_name="Value").add("event.props", FieldType.STRING, ui_name="Props").add("event.props.k", FieldType.U64, ui_name="K")
    c.alias("event.number", ["event.user_id", "event.props.k"])
    return Layout(c.build(), {f: f for f in c.fields}, exhaustive=True)


def _one(value: Column) -> Column:
    """An array of the value; empty where it is null."""
    return F.array_compact(F.array(value))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("packet_id"),
        nanos("ts").alias("timestamp_ns"),
        F.array(F.lit("event"), F.col("event_type")).alias("protocols"),
        _one(F.col("event_type")).alias("event.type"),
        _one(F.col("user_id")).alias("event.user_id"),
        _one(F.col("value")).alias("event.value"),
        _one(F.col("props")).alias("event.props"),
        _one(F.get_json_object("props", "$.k").try_cast("bigint")).alias("event.props.k"),
    )


# C2: an order is a packet, its lines are containers inside it


def orders_layout() -> Layout:
    c = Catalog().protocol("order", "Order").protocol("line", "Line")
    c.add("order.key", FieldType.U64, ui_name="Key").add("order.price", FieldType.F64, ui_name="Total price").add("order.status", FieldType.STRING, ui_name="Status")
    c.add("line.qty", FieldType.F64, ui_name="Quantity").add("line.price", FieldType.F64, ui_name="Price").add("line.flag", FieldType.STRING, ui_name="Flag").add("line.shipdate", FieldType.TIMESTAMP, ui_name="Ship date").add("line.returned", FieldType.BOOL, ui_name="Returned")
    c.alias("any.price", ["order.price", "line.price"])
    members = {"line.qty": "l_quantity", "line.price": "l_extendedprice", "line.flag": "l_returnflag", "line.shipdate": "shipdate_ns", "line.returned": "returned"}
    return Layout(c.build(), {f: f for f in c.fields}, nodes="nodes", containers={"order": Container(None), "line": Container("lines", members)})


LINE_FIELDS = 5


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exchange of each table, on the order's key. Lines are ordered by all their columns, so that ties are identical."""
    line = F.struct(*[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")], F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, l_shipdate) * 1000").alias("shipdate_ns"), (F.col("l_returnflag") == "R").alias("returned"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), line.alias("line")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    o = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("lines", F.coalesce("lines", F.array()))
    n = F.size("lines")
    stop = 3 + n * (LINE_FIELDS + 1)
    head = F.array(
        node("order", F.lit(0), F.lit(-1), 1, stop),
        node("order.key", F.lit(1), F.lit(0), 2, F.lit(1), i64=F.col("o_orderkey")),
        node("order.price", F.lit(2), F.lit(0), 2, F.lit(2), f64=F.col("o_totalprice")),
        node("order.status", F.lit(3), F.lit(0), 2, F.lit(3), str=F.col("o_orderstatus")),
    )

    def of_line(x: Column, i: Column) -> Column:
        at = 4 + i * (LINE_FIELDS + 1)
        return F.array(
            node("line", at, F.lit(0), 2, at + LINE_FIELDS),
            node("line.qty", at + 1, at, 3, at + 1, f64=x["l_quantity"]),
            node("line.price", at + 2, at, 3, at + 2, f64=x["l_extendedprice"]),
            node("line.flag", at + 3, at, 3, at + 3, str=x["l_returnflag"]),
            node("line.shipdate", at + 4, at, 3, at + 4, i64=x["shipdate_ns"]),
            node("line.returned", at + 5, at, 3, at + 5, bool=x["returned"]),
        )

    return o.select(
        F.col("o_orderkey").alias("packet_id"),
        nanos("o_orderdate").alias("timestamp_ns"),
        F.when(n > 0, F.array(F.lit("order"), F.lit("line"))).otherwise(F.array(F.lit("order"))).alias("protocols"),
        F.array("o_orderkey").alias("order.key"),
        F.array("o_totalprice").alias("order.price"),
        F.array("o_orderstatus").alias("order.status"),
        F.col("lines.l_quantity").alias("line.qty"),
        F.col("lines.l_extendedprice").alias("line.price"),
        F.col("lines.l_returnflag").alias("line.flag"),
        F.col("lines.shipdate_ns").alias("line.shipdate"),
        F.col("lines.returned").alias("line.returned"),
        "lines",
        F.concat(head, F.flatten(F.transform("lines", of_line))).alias("nodes"),
    )


# C4: a turn is a segment of the connection conv_id


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conn_id"), F.col("turn").alias("seq"), "role", F.col("text").cast("binary").alias("payload"))


# C5: documents and pages have text fields


def documents_layout() -> Layout:
    c = Catalog().protocol("doc", "Document").add("doc.text", FieldType.STRING).add("doc.lang", FieldType.STRING).add("doc.source", FieldType.STRING)
    return Layout(c.build(), {f: f for f in c.fields}, protocols=None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("packet_id"), _one(F.col("text")).alias("doc.text"), _one(F.col("lang")).alias("doc.lang"), _one(F.col("source")).alias("doc.source"))


def pages_layout() -> Layout:
    c = Catalog().protocol("http", "HTTP").add("http.host", FieldType.STRING).add("http.uri", FieldType.STRING)
    return Layout(c.build(), {f: f for f in c.fields}, protocols=None)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)([^#]*)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://([^/?#]*)([^#]*)", 2).alias("uri"))
    return parts.select(F.col("page_id").alias("packet_id"), F.array("host").alias("http.host"), F.array("uri").alias("http.uri"))


# C3: events as Ethernet frames


def frames(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """(frame_id, timestamp_ns, data). A purchase is a TCP segment, the rest are UDP; every tenth frame has a VLAN tag, every thirtieth two.

    every: an event without a user has the addresses of user 0; otherwise its frame is null.
    """
    from framelake.dissect import wire

    user, eid = F.coalesce("user_id", F.lit(0)) if every else F.col("user_id"), F.col("event_id")
    port = F.lit(0)
    for name, number in zip(EVENT_TYPES, (53, 80, 443, 5000, 5353), strict=True):
        port = F.when(F.col("event_type") == name, number).otherwise(port)
    e = spread(read(spark, sf_dir, "events")).select("event_id", "user_id", "event_type", "ts", F.coalesce(F.col("props"), F.lit("")).cast("binary").alias("payload"), (1024 + user % 50000).alias("source"), port.alias("port"))
    payload, tcp = F.col("payload"), F.col("event_type") == "purchase"
    e = staged(e, segment=F.when(tcp, wire.tcp(F.col("source"), F.col("port"), eid * 100, F.lit(1), F.lit(0x18), payload)).otherwise(wire.udp(F.col("source"), F.col("port"), payload)))
    e = staged(e, packet=wire.ipv4(F.lit(0x0A000000) + user, F.lit(0xC0A80001), F.when(tcp, 6).otherwise(17), F.col("segment"), 64 - eid % 8, eid % 65536))
    ends = F.lit(0x020000000001), F.lit(0x020000000000) + user, F.lit(0x800), F.col("packet")
    framed = F.when(eid % 30 == 0, wire.ethernet(*ends, user % 4095, eid % 4095)).when(eid % 10 == 0, wire.ethernet(*ends, user % 4095)).otherwise(wire.ethernet(*ends))
    return staged(e, data=framed).select(eid.alias("frame_id"), nanos("ts").alias("timestamp_ns"), "data")
