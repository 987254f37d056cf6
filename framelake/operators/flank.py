"""Edges between packets: the one operator of the filter language that looks across rows.

Pairwise modes compare a sample with the visible one before it, by a window over buckets of ids.
Armed modes are a latch of two slots. Its state is certainly empty wherever a `from` sample comes
later than the window after all `from` samples before it; the packets between two such places are a
run of their own, and runs are worked on in parallel, each in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.lang import nodes as N
from framelake.operators.running import carried
from framelake.plans.compiler import FlankCall, Layout, compare, constant
from framelake.types import FieldType


def _test(v: Column, call: FlankCall, end: tuple[str, N.Literal]) -> Column:
    return F.coalesce(compare(v, call.kind, *end), F.lit(False))


def _delta(now: Column, before: Column, by: tuple[str, int]) -> Column:
    """now - before op n; what doesn't fit 64 bits doesn't fire."""
    op, n = by
    return F.coalesce(compare(F.try_subtract(now.cast("bigint"), before.cast("bigint")), FieldType.I64, op, N.Literal("int", n)), F.lit(False))


def add_flank(df: DataFrame, call: FlankCall, layout: Layout, partition_by: list[str]) -> DataFrame:
    """df with the boolean column call.column."""
    f, pid, ts = call.flank, layout.packet_id, layout.timestamp
    seen = df.withColumn("__v", call.sample).withColumn("__seen", F.coalesce(call.gate, F.lit(False)) & F.col("__v").isNotNull())
    return (_armed if f.armed else _pairwise)(seen, call, pid, ts, partition_by).drop("__v", "__seen")


def _near(f: N.Flank, pid: Column, ts: Column, ref_pid: Column, ref_ts: Column) -> Column:
    gap, most = (pid - ref_pid, f.window.packets) if f.window.packets is not None else (ts - ref_ts, f.window.nanos)
    return (gap >= 0) & (gap <= most)


def _pairwise(df: DataFrame, call: FlankCall, pid: str, ts: str, partition_by: list[str]) -> DataFrame:
    f = call.flank
    state = F.when(F.col("__seen"), F.struct(F.col(pid).alias("p"), F.col(ts).alias("t"), F.col("__v").alias("v")))
    df = carried(df, "__prev", state, pid, partition_by)
    now, before = F.col("__v"), F.col("__prev.v")
    if f.to:
        edge = _test(now, call, f.to) & ~_test(before, call, f.to)
    elif f.from_:
        edge = _test(before, call, f.from_) & ~_test(now, call, f.from_)
    elif f.by:
        edge = _delta(now, before, f.by)
    else:
        edge = ~now.eqNullSafe(before)
    fired = F.col("__seen") & F.col("__prev").isNotNull() & _near(f, F.col(pid), F.col(ts), F.col("__prev.p"), F.col("__prev.t")) & edge
    return df.withColumn(call.column, F.coalesce(fired, F.lit(False))).drop("__prev")


class Latch:
    """Arm and Next, each (packet, time, value) or None."""

    def __init__(self, window: N.Window, by) -> None:
        self.window, self.by, self.arm, self.next = window, by, None, None

    def old(self, ref, p: int, t: int) -> bool:
        return p - ref[0] > self.window.packets if self.window.packets is not None else t - ref[1] > self.window.nanos

    def step(self, p: int, t: int, v, is_from: bool, is_to: bool) -> bool:
        promoted = False
        if self.next is not None and self.old(self.next, p, t):
            self.next = None
        while self.arm is not None and self.old(self.arm, p, t):
            self.arm, self.next, promoted = self.next, None, self.next is not None or promoted
        if self.arm is not None and is_to and (p >= self.arm[0] if self.window.packets is not None else t >= self.arm[1]) and (self.by is None or self.by(v, self.arm[2])):
            self.arm = self.next = None
            return True
        if is_from:
            self.offer((p, t, v), promoted)
        return False

    def offer(self, new, promoted: bool) -> None:
        if self.window.packets is not None:
            if self.arm is None:
                self.arm = new
            elif self.next is None and not promoted:
                self.next = new
            return
        both = sorted([x for x in (self.arm, self.next, new) if x is not None], key=lambda x: x[1])[:2]  # stable: the earlier offer wins ties
        self.arm, self.next = both[0], both[1] if len(both) > 1 else None


_BY = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def delta_test(by: tuple[str, int] | None):
    if by is None:
        return None
    op, n = by

    def test(now: int, before: int) -> bool:
        d = int(now) - int(before)
        return -(1 << 63) <= d < 1 << 63 and _BY[op](d, n)

    return test


def _armed(df: DataFrame, call: FlankCall, pid: str, ts: str, partition_by: list[str]) -> DataFrame:
    f = call.flank
    df = df.withColumn("__from", F.col("__seen") & _test(F.col("__v"), call, f.from_)).withColumn("__to", F.col("__seen") & (_test(F.col("__v"), call, f.to) if f.to else constant("==", 0)))
    rows = df.filter("__seen").select(*[F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(partition_by)], F.col(pid).alias("p"), F.col(ts).alias("t"), (F.col("__v").cast("bigint") if f.by else F.lit(None).cast("bigint")).alias("v"), F.col("__from").alias("f"), F.col("__to").alias("to"))
    keys = [f"__p{i}" for i in range(len(partition_by))]
    by_packets = f.window.packets is not None
    at, most = ("p", f.window.packets) if by_packets else ("t", f.window.nanos)
    rows = carried(rows, "__past", F.when(F.col("f"), F.col(at)), "p", keys, "max")
    rows = carried(rows, "run", F.when(F.col("f") & (F.col("__past").isNull() | (F.col(at) - F.col("__past") > most)), F.col("p")), "p", keys, "last", inclusive=True)
    rows = rows.filter(F.col("run").isNotNull()).drop("__past")
    window, by = f.window, f.by

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in the order of (keys, run, p); a run never spans two tasks, a state never two runs."""
        latch, here = None, None
        for pdf in batches:
            fired = []
            groups = list(zip(*[pdf[k] for k in keys], pdf["run"], strict=True))
            for g, p, t, v, is_from, is_to in zip(groups, pdf["p"].tolist(), pdf["t"].tolist(), pdf["v"].tolist(), pdf["f"].tolist(), pdf["to"].tolist(), strict=True):
                if g != here:
                    latch, here = Latch(window, delta_test(by)), g
                if latch.step(p, t, v, is_from, is_to):
                    fired.append(p)
            yield pd.DataFrame({"__fired": pd.Series(fired, dtype="int64")})

    ordered = rows.repartition(*keys, "run").sortWithinPartitions(*keys, "run", "p")
    hits = ordered.mapInPandas(run, "__fired bigint").withColumn(call.column, F.lit(True))
    return df.drop("__from", "__to").join(hits, F.col(pid) == F.col("__fired"), "left").drop("__fired").withColumn(call.column, F.coalesce(call.column, F.lit(False)))
