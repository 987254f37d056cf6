"""Sessions: packets that arrive are filtered and handed to listeners, in batches and in order."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.operators.flank import Latch, _test, delta_test
from framelake.plans.compiler import FlankCall, Layout, compile_filter

Listener = Callable[[DataFrame, int], None]


def listen(stream: DataFrame, listener: Listener, checkpoint: str, text: str = "", layout: Layout | None = None, available_now: bool = False) -> StreamingQuery:
    """Calls listener(matches, batch id) for each batch; a batch that is tried again has the same id. Stateless filters only, see listen_flank()."""
    df = stream
    if text.strip():
        f = compile_filter(text, layout)
        if f.stateful:
            raise ValueError("a filter with flank needs listen_flank()")
        df = df.filter(f.column)
    writer = df.writeStream.foreachBatch(listener).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def flank_stream(stream: DataFrame, text: str, layout: Layout, key: str) -> DataFrame:
    """(key, packet_id, timestamp_ns) of the packets at which the one flank of `text` fires, followed for each key by itself.

    State is a latch of two samples, or the last sample; packets of a key must come in the order of their ids, batch by batch.
    """
    f = compile_filter(text, layout)
    if len(f.flanks) != 1:
        raise ValueError("one flank is wanted")
    (call,) = f.flanks
    flank = call.flank
    rows = stream.withColumn("__v", call.sample).filter(F.coalesce(call.gate, F.lit(False)) & F.col("__v").isNotNull())
    is_from = _test(F.col("__v"), call, flank.from_) if flank.from_ else F.lit(False)
    is_to = _test(F.col("__v"), call, flank.to) if flank.to else F.lit(flank.armed)
    kind = dict(stream.dtypes)[key]
    value = "bigint" if flank.by else "string"  # a change is seen in the text of a value as well
    rows = rows.select(F.col(key).alias("k"), F.col(layout.packet_id).alias("p"), F.col(layout.timestamp).alias("t"), F.col("__v").cast(value).alias("v"), is_from.alias("f"), is_to.alias("to"))
    out = rows.groupBy("k").applyInPandasWithState(_runner(call), f"k {kind}, packet_id bigint, timestamp_ns bigint", "saved binary", "append", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("k", key)


def _runner(call: FlankCall):
    flank, by = call.flank, delta_test(call.flank.by)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved, last = pickle.loads(bytes(state.get[0])) if state.exists else (None, None)
        pdf = pd.concat(list(batches)).sort_values("p")
        fired = []
        if last is not None and len(pdf) and pdf["p"].iloc[0] <= last:
            raise ValueError(f"packet {pdf['p'].iloc[0]} came after packet {last}")
        last = int(pdf["p"].iloc[-1]) if len(pdf) else last
        if flank.armed:
            latch = Latch(flank.window, by)
            latch.arm, latch.next = saved or (None, None)
            for p, t, v, f, to in pdf[["p", "t", "v", "f", "to"]].itertuples(index=False):
                if latch.step(p, t, v, f, to):
                    fired.append((p, t))
            saved = latch.arm, latch.next
        else:
            for p, t, v, f, to in pdf[["p", "t", "v", "f", "to"]].itertuples(index=False):
                if saved is not None and _fires(flank, by, saved, (p, t, v, f, to)):
                    fired.append((p, t))
                saved = p, t, v, f, to
        state.update((pickle.dumps((saved, last)),))
        yield pd.DataFrame([(key[0], p, t) for p, t in fired], columns=["k", "packet_id", "timestamp_ns"])

    return run


def _fires(flank, by, last: tuple, now: tuple) -> bool:
    gap, most = (now[0] - last[0], flank.window.packets) if flank.window.packets is not None else (now[1] - last[1], flank.window.nanos)
    if not 0 <= gap <= most:
        return False
    if flank.to:
        return bool(now[4] and not last[4])
    if flank.from_:
        return bool(last[3] and not now[3])
    return by(now[2], last[2]) if by else now[2] != last[2]
