"""Frames made by rule from a seed: no data moves, and any part of them can be made again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.dissect import wire
from framelake.functions import wire as W
from framelake.functions.stage import staged

MODES = ("random", "ethernet", "ipv4", "ipv6", "udp", "tcp", "udp6", "tcp6", "can", "canfd", "tcpstream", "tcpstream6", "mixed")
#: Frames of one connection of the stream modes: handshake, data to and fro, close.
STREAM = 16


def _rand(seed: int, salt: int, below: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("frame_id")), F.lit(below))


def _bytes(seed: int, salt: int, size: Column) -> Column:
    each = F.transform(F.sequence(F.lit(0), F.floor(size / 8).cast("int")), lambda i: F.lpad(F.hex(F.xxhash64(F.lit(seed), F.lit(salt), F.col("frame_id"), i)), 16, "0"))
    return F.unhex(F.substring(F.array_join(each, ""), F.lit(1), (size * 2).cast("int")))


def frames(spark: SparkSession, count: int, mode: str = "mixed", seed: int = 42, per_second: int = 1000, start_ns: int = 1_767_225_600_000_000_000) -> DataFrame:
    """(frame_id, timestamp_ns, link_type, data)."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    df = spark.range(count).withColumnRenamed("id", "frame_id")
    payload = _bytes(seed, 1, _rand(seed, 2, 180) + 20)
    df = staged(df, payload=payload)
    src, dst = F.lit(0x0A000000) + _rand(seed, 3, 65536), F.lit(0x0A010000) + _rand(seed, 4, 65536)
    sport, dport = 1024 + _rand(seed, 5, 60000), F.element_at(F.array(*[F.lit(p) for p in (53, 80, 443, 5000)]), (_rand(seed, 6, 4) + 1).cast("int"))
    macs = F.lit(0x020000000000) + _rand(seed, 7, 1 << 24), F.lit(0x020000000000) + _rand(seed, 8, 1 << 24)
    udp = wire.ipv4(src, dst, F.lit(17), wire.udp(sport, dport, F.col("payload")))
    tcp = wire.ipv4(src, dst, F.lit(6), wire.tcp(sport, dport, _rand(seed, 9, 1 << 31), F.lit(0), F.lit(0x10), F.col("payload")))
    arp = F.concat(wire.hexed("0001080006040001"), W.be_bytes(macs[1], 6), W.be_bytes(src, 4), wire.hexed("000000000000"), W.be_bytes(dst, 4))
    can = F.concat(W.be_bytes(_rand(seed, 10, 0x800), 4), wire.hexed("08000000"), _bytes(seed, 11, F.lit(8)))
    made = {
        "random": F.col("payload"),
        "ethernet": wire.ethernet(*macs, F.lit(0x88B5), F.col("payload")),
        "udp": wire.ethernet(*macs, F.lit(0x800), udp),
        "tcp": wire.ethernet(*macs, F.lit(0x800), tcp),
        "can": can,
    }
    six = lambda proto, body, a=src, b=dst: _six(proto, body, a, b)
    eth6 = lambda body: wire.ethernet(*macs, F.lit(0x86DD), body)
    made |= {
        "ipv4": wire.ethernet(*macs, F.lit(0x800), wire.ipv4(src, dst, F.lit(253), F.col("payload"))),
        "ipv6": eth6(six(253, F.col("payload"))),
        "udp6": eth6(six(17, wire.udp(sport, dport, F.col("payload")))),
        "tcp6": eth6(six(6, wire.tcp(sport, dport, _rand(seed, 9, 1 << 31), F.lit(0), F.lit(0x10), F.col("payload")))),
        "canfd": F.concat(W.be_bytes(_rand(seed, 10, 0x800), 4), wire.hexed("20040000"), _bytes(seed, 11, F.lit(32))),
    }
    if mode.startswith("tcpstream"):
        made[mode] = _stream_frame(mode.endswith("6"), macs, seed)
    made["mixed"] = F.when(F.col("frame_id") % 4 == 2, wire.ethernet(*macs, F.lit(0x806), arp)).when(F.col("frame_id") % 4 == 1, made["tcp"]).otherwise(made["udp"])
    link = 227 if mode in ("can", "canfd") else 1
    return df.select("frame_id", (F.lit(start_ns) + F.col("frame_id") * (1_000_000_000 // per_second)).alias("timestamp_ns"), F.lit(link).alias("link_type"), made[mode].alias("data"))


def _six(proto: int, body: Column, src: Column, dst: Column) -> Column:
    return F.concat(wire.hexed("60000000"), W.be_bytes(F.octet_length(body), 2), W.be_bytes(F.lit(proto), 1), wire.hexed("40"), wire.hexed("20010db8" + "00" * 8), W.be_bytes(src, 4), wire.hexed("20010db8" + "00" * 8), W.be_bytes(dst, 4), body)


def _stream_frame(six: bool, macs: tuple[Column, Column], seed: int) -> Column:
    """Every STREAM frames are a connection: three of a handshake, requests of 64 bytes and answers of 128 in turn, and three of a close."""
    conn, j = F.floor(F.col("frame_id") / STREAM), F.col("frame_id") % STREAM
    last = STREAM - 3
    draw = lambda salt, below: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), conn), F.lit(below))
    client, server = F.lit(0x0A000000) + draw(3, 65536), F.lit(0x0A010000) + draw(4, 65536)
    port, isn, peer = 1024 + draw(5, 60000), draw(6, 1 << 31), draw(7, 1 << 31)
    asked, told = F.greatest(F.least(F.floor((j - 2) / 2), F.lit((last - 3) // 2)), F.lit(0)), F.greatest(F.least(F.floor((j - 3) / 2), F.lit((last - 3) // 2)), F.lit(0))
    back = (j == 1) | ((j >= 3) & (j < last) & (j % 2 == 0)) | (j == last + 1)
    data = F.when((j >= 3) & (j < last), F.when(back, _bytes(seed, 12, F.lit(128))).otherwise(_bytes(seed, 13, F.lit(64)))).otherwise(wire.hexed(""))
    c_next = isn + F.when(j == 0, 0).otherwise(1) + 64 * F.when(back, asked).otherwise(told) + F.when(j > last, 1).otherwise(0)
    s_next = peer + F.when(j <= 1, 0).otherwise(1) + 128 * told + F.when(j > last + 1, 1).otherwise(0)
    flags = F.when(j == 0, 0x02).when(j == 1, 0x12).when((j == last) | (j == last + 1), 0x11).when((j >= 3) & (j < last), 0x18).otherwise(0x10)
    seq, ack = F.when(back, s_next).otherwise(c_next), F.when(j == 0, 0).when(back, c_next).otherwise(s_next + F.when(j == 2, 0).otherwise(0))
    ends = F.when(back, server).otherwise(client), F.when(back, client).otherwise(server)
    ports = F.when(back, F.lit(443).cast("bigint")).otherwise(port), F.when(back, port).otherwise(F.lit(443).cast("bigint"))
    segment = wire.tcp(*ports, seq % 4294967296, ack % 4294967296, flags, data)
    return wire.ethernet(*macs, F.lit(0x86DD), _six(6, segment, *ends)) if six else wire.ethernet(*macs, F.lit(0x800), wire.ipv4(*ends, F.lit(6), segment))
