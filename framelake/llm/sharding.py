"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by the 128-bit key (hash of the text, hash of the doc_id). The bytes below
candidate boundaries are counted exactly, by one aggregation a round over all partitions; only the
intervals in which a splitter still lies are probed again, 256 times finer. When each splitter's
bytes are within the tolerance (or its interval is one key), the rows are exchanged once, to the
range they belong to, sorted there and numbered.

Equal texts have equal first keys and stay together, unless a splitter has to fall inside a group
that is larger than the tolerance: such a hot group is split by the second key.

Defined cases: a null text counts one byte, has crc 0 and sorts as one group; a null doc_id is a
key of its own; rows that agree in text and doc_id are never parted; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import cut

#: Rows that one task sorts, as far as MAX_RANGES allows.
RANGE_ROWS = 1_000_000
#: Ranges of a shard: at least so that the exchange has some parallelism, at most so that splitters stay few.
MIN_RANGES, MAX_RANGES = 8, 128


def find_splitters(rows: DataFrame, total: int, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """parts - 1 keys (k1, k2): a row belongs to the right of a splitter if its key isn't below it. rows: (k1, k2, size).

    State on the driver: at most parts open intervals and 4096 or 256 counters for each.
    """
    goals = [total * j / parts for j in range(1, parts)]
    found: dict[int, tuple[int, int]] = {}
    # an interval is the keys whose first `bits` bits are `prefix` (of k1, or of k2 below one k1)
    work: list[tuple[int | None, int, int, float, list[int]]] = [(None, 0, 0, 0.0, list(range(len(goals))))]
    while work:
        nxt = []
        for below_k1, level in sorted({(w[0] is not None, w[1]) for w in work}):
            batch = [w for w in work if (w[0] is not None, w[1]) == (below_k1, level)]
            step = 12 if level == 0 else min(8, 64 - level)
            key, shift = F.col("k2" if below_k1 else "k1"), 64 - level - step
            cond: Column = F.lit(True)
            if below_k1:
                cond = F.col("k1").isin(sorted({w[0] for w in batch}))
            if level:
                cond = cond & F.shiftright(key, 64 - level).isin(sorted({w[2] for w in batch}))
            groups = [F.col("k1").alias("outer") if below_k1 else F.lit(None).cast("long").alias("outer"), F.shiftright(key, shift).alias("bin")]
            counted: dict[tuple[int | None, int], list[tuple[int, int, int]]] = {}
            for r in rows.filter(cond).groupBy(*groups).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
                counted.setdefault((r["outer"], r["bin"] >> step if level else 0), []).append((r["bin"], r["bytes"], r["n"]))
            for outer, _, prefix, start, js in batch:
                bins = sorted(counted.get((outer, prefix), []))
                ends, at = [], start
                for _, size, _ in bins:
                    at += size
                    ends.append(at)
                inner: dict[int, list[int]] = {}
                for j in js:
                    i = min(bisect.bisect_left(ends, goals[j]), len(bins) - 1)
                    left, right = (ends[i - 1] if i else start), ends[i]
                    near_left = goals[j] - left <= right - goals[j]
                    leaf = below_k1 and shift == 0
                    if min(goals[j] - left, right - goals[j]) <= tolerance or bins[i][2] == 1 or leaf:
                        edge = bins[i][0] if near_left else bins[i][0] + 1
                        edge_key = edge << shift
                        if below_k1:
                            found[j] = (outer, edge_key) if edge_key < 1 << 63 else (outer + 1, -(1 << 63))
                        else:
                            found[j] = (edge_key, -(1 << 63))
                    else:
                        inner.setdefault(i, []).append(j)
                for i, more in inner.items():
                    left = ends[i - 1] if i else start
                    nxt.append((bins[i][0], 0, 0, left, more) if not below_k1 and shift == 0 else (outer, level + step, bins[i][0], left, more))
        work = nxt
    return [found[j] for j in range(len(goals))]


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters that aren't above the row's key, by binary search."""

    def at(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        k1, k2 = splitters[mid]
        if k1 >= 1 << 63:
            return at(lo, mid)
        below = (F.col("k1") < k1) if k2 == -(1 << 63) else (F.col("k1") < k1) | ((F.col("k1") == k1) & (F.col("k2") < k2))
        return F.when(below, at(lo, mid)).otherwise(at(mid + 1, hi))

    return at(0, len(splitters))


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard). tolerance: of a shard's bytes, for each splitter."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("k1"), F.xxhash64("doc_id").alias("k2")))
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    ranges = min(MAX_RANGES, max(MIN_RANGES, math.ceil(n / shards / RANGE_ROWS)))
    splitters = find_splitters(rows.select("k1", "k2", "size"), total, shards * ranges, tolerance * total / shards) if n else []
    placed = rows.withColumn("range", _range_of(splitters).cast("int"))
    counts = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect()}
    offsets, at = [], 0
    for p in range(shards * ranges):
        at = 0 if p % ranges == 0 else at
        offsets.append(at)
        at += counts.get(p, 0)
    first = F.element_at(F.array(*[F.lit(x) for x in offsets]), F.col("range") + 1).cast("long")
    rank = F.row_number().over(Window.partitionBy("range").orderBy("k1", "k2", "doc_id"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), (F.col("range") / ranges).cast("int").alias("shard"), (first + rank - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
