"""Fragments, streams and request/response pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concat_stream(segments: DataFrame, key: str = "conn_id", seq: str = "seq", payload: str = "payload", first: int = 0) -> DataFrame:
    """(key, data, bytes, segments, state): payloads in order of seq, as far as seq has no gap; `pending` if it has one.

    Of segments with one seq the first in order of bytes counts. A key's segments make one row, as for messages of bounded
    length; tcp.stream_bytes() tells a connection in pieces.
    """
    part = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(payload).alias("p"))))
    g = segments.groupBy(key).agg(part.alias("a"))
    g = g.withColumn("a", F.filter("a", lambda x, i: (i == 0) | (F.get(F.col("a"), i - 1)["s"] != x["s"])))
    gapless = F.filter("a", lambda x, i: x["s"] == i + first)
    whole = F.aggregate(F.transform(gapless, lambda x: F.coalesce(x["p"], F.lit(bytearray()))), F.lit(bytearray()), lambda t, x: F.concat(t, x))
    return g.select(key, whole.alias("data"), F.size(gapless).cast("bigint").alias("segments"), F.when(F.size(gapless) == F.size("a"), "complete").otherwise("pending").alias("state")).withColumn("bytes", F.octet_length("data").cast("bigint"))


@dataclass(frozen=True)
class FragmentPolicy:
    """overlap: keep_first, keep_last or discard; unit: bytes that offsets and all fragments but the last are multiples of."""

    overlap: str = "keep_last"
    unit: int = 1
    most_bytes: int = 65_535
    most_fragments: int = 8_192
    restart_on_zero: bool = False


IPV4 = FragmentPolicy("keep_last", 8)
IPV6 = FragmentPolicy("discard", 8)
SEGMENTS = FragmentPolicy("keep_first", 16, 1 << 20)


class Datagram:
    """One key's fragments, in order of arrival."""

    def __init__(self, policy: FragmentPolicy) -> None:
        self.policy = policy
        self.clear()

    def clear(self) -> None:
        self.parts: dict[int, bytes] = {}
        self.end: int | None = None
        self.bad = False

    def add(self, offset: int, more: bool, data: bytes) -> tuple[str, bytes | None]:
        """(outcome, payload): pending, complete, or discarded with a reason."""
        p = self.policy
        if offset + len(data) > p.most_bytes:
            return "discarded:extent", None
        if offset % p.unit or more and len(data) % p.unit:
            return "discarded:alignment", None
        if offset == 0 and self.parts and p.restart_on_zero:
            self.clear()
        if len(self.parts) >= p.most_fragments:
            self.clear()
            return "discarded:fragments", None
        if not more:
            if self.end is not None and self.end != offset + len(data):
                self.clear()
                return "discarded:end", None
            self.end = offset + len(data)
        overlaps = [o for o, d in self.parts.items() if o < offset + len(data) and offset < o + len(d)]
        if overlaps:
            if p.overlap == "discard":
                self.clear()
                return "discarded:overlap", None
            if offset in self.parts:
                old = self.parts[offset]
                if p.overlap == "keep_last" and len(data) >= len(old):
                    self.parts[offset] = data
            elif data:
                self.parts[offset] = data
        elif data:
            self.parts[offset] = data
        if self.end is None:
            return "pending", None
        out, at = bytearray(self.end), 0
        for o in sorted(self.parts, reverse=p.overlap == "keep_first"):
            out[o : o + len(self.parts[o])] = self.parts[o]
        for o in sorted(self.parts):
            if o > at:
                return "pending", None
            at = max(at, o + len(self.parts[o]))
        if at < self.end:
            return "pending", None
        payload = bytes(out[: self.end])
        self.clear()
        return "complete", payload


def reassemble(fragments: DataFrame, keys: list[str], policy: FragmentPolicy = IPV4, order: str = "packet_id") -> DataFrame:
    """(packet_id, outcome, payload) for every fragment (keys, order, offset, more, data): the one that completes a datagram has its payload.

    Rows are dealt by key and sorted; a task holds the open datagram of one key at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, open_ = None, None
        for pdf in batches:
            rows = []
            for *key, pid, offset, more, data in pdf.itertuples(index=False):
                if key != here:
                    here, open_ = key, Datagram(policy)
                rows.append((pid, *open_.add(int(offset), bool(more), bytes(data))))
            yield pd.DataFrame(rows, columns=["packet_id", "outcome", "payload"])

    dealt = fragments.select(*keys, order, "offset", "more", "data").repartition(*keys).sortWithinPartitions(*keys, order)
    return dealt.mapInPandas(run, "packet_id bigint, outcome string, payload binary")


def messages(segments: DataFrame, key: str, boundary: Callable[[bytes], int | None], order: str = "seq", payload: str = "payload", missing: str | None = None, resync: Callable[[bytes], int] | None = None) -> DataFrame:
    """(key, n, data): the messages of each stream. boundary: the length of the first message of a buffer, None if it needs more, 0 if it can't tell.

    Where it can't tell, resync says at which later byte a message may start (its buffer's length if at none); a byte
    is skipped by default. missing: a column of bytes that are known to be lost before a segment: what was begun before
    them is dropped. Streams are dealt by key and sorted; a task holds the unfinished message of one stream.
    """
    kind = dict(segments.dtypes)[key]
    lost = F.col(missing) if missing else F.lit(0).cast("bigint")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, buffer, n = None, b"", 0
        for pdf in batches:
            rows = []
            for k, _, data, gap in pdf.itertuples(index=False):
                if k != here:
                    here, buffer, n = k, b"", 0
                buffer = bytes(data) if gap else buffer + bytes(data)
                at = 0
                while at < len(buffer):
                    rest = buffer[at:]
                    size = boundary(rest)
                    if size is None or size > len(rest):
                        break
                    if size == 0:
                        at += max(1, resync(rest)) if resync else 1
                        continue
                    rows.append((here, n, rest[:size]))
                    at, n = at + size, n + 1
                buffer = buffer[at:]
            yield pd.DataFrame(rows, columns=[key, "n", "data"])

    return segments.select(key, order, payload, lost.alias("__lost")).repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"{key} {kind}, n bigint, data binary")


def length_prefix(at: int, width: int, extra: int = 0, little: bool = False) -> Callable[[bytes], int | None]:
    """Messages that say their length in `width` bytes at an offset; extra: what the length doesn't count."""

    def boundary(buffer: bytes) -> int | None:
        return None if len(buffer) < at + width else int.from_bytes(buffer[at : at + width], "little" if little else "big") + extra

    return boundary


def pair_latest(df: DataFrame, keys: list[str], order: str, is_request, is_response) -> DataFrame:
    """(keys, request, response): a response takes the latest request of its key that is still pending.

    As with brackets, a request at depth d is taken by the next response that comes back to d, where
    depths are running sums that responses without a pending request don't lower.
    """
    step = F.when(is_request, 1).when(is_response, -1).otherwise(0)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = df.filter(is_request | is_response).select(*keys, order, step.alias("__step"))
    s = s.withColumn("__sum", F.sum("__step").over(w))
    # the floor: what the sum would be if responses with nothing pending were left out
    s = s.withColumn("__low", F.least(F.min("__sum").over(w), F.lit(0))).withColumn("__depth", F.col("__sum") - F.col("__low"))
    s = s.withColumn("__matched", (F.col("__step") == 1) | (F.col("__low") == F.coalesce(F.lag("__low").over(Window.partitionBy(*keys).orderBy(order)), F.lit(0))))
    s = s.filter("__matched").withColumn("__level", F.when(F.col("__step") == 1, F.col("__depth")).otherwise(F.col("__depth") + 1))
    level = Window.partitionBy(*keys, "__level").orderBy(order)
    # at one level requests and responses alternate, save for requests that nothing answered
    out = s.withColumn("__next", F.lead(F.struct(F.col(order).alias("o"), F.col("__step").alias("st"))).over(level))
    return out.filter("__step = 1").select(*keys, F.col(order).alias("request"), F.when(F.col("__next.st") == -1, F.col("__next.o")).alias("response"))


def stream_index(df: DataFrame, a: list[str], b: list[str], order: str = "packet_id") -> DataFrame:
    """df with `stream`, dense from 0 by the first packet of each unordered pair of endpoints.

    Streams are numbered over one row each.
    """
    left, right = F.struct(*[F.col(x).alias(f"e{i}") for i, x in enumerate(a)]), F.struct(*[F.col(x).alias(f"e{i}") for i, x in enumerate(b)])
    keyed = df.withColumn("__lo", F.least(left, right)).withColumn("__hi", F.greatest(left, right))
    firsts = keyed.groupBy("__lo", "__hi").agg(F.min(order).alias("__first"))
    from framelake.operators.presence import Presence

    numbers = Presence(firsts.select(F.col("__first").alias("packet_id")), "packet_id").numbered().withColumnRenamed("packet_id", "__f")
    named = firsts.join(numbers, F.col("__first") == F.col("__f")).select(F.col("__lo").alias("__l"), F.col("__hi").alias("__h"), F.col("rank").alias("stream"))
    return keyed.join(named, (F.col("__lo") == F.col("__l")) & (F.col("__hi") == F.col("__h"))).drop("__lo", "__hi", "__l", "__h")


def time_deltas(df: DataFrame, keys: list[str], order: str, time: str, name: str = "delta_ns") -> DataFrame:
    """df with the time since the row before of the same key; null for the first."""
    return df.withColumn(name, F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(order)))
