"""Sessions that are kept: a log of frames in the order of their ids, reads over it, series and verdicts that follow it.

A folder holds `frames` (a part a batch, immutable), and a generation of what was made of them. Every
step is named by its batch, so that a batch that is tried again puts the same rows in the same place.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from framelake.dissect import packet
from framelake.operators import series
from framelake.plans.compiler import compile_filter
from framelake.sinks import writers

FRAMES = "frame_id bigint, timestamp_ns bigint, link_type int, interface_id int, data binary"


class OutOfOrder(ValueError):
    pass


class Session:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        if not self._exists("state"):
            self._put("state", {"generation": 0, "batches": [], "next": 0, "series": {}})

    # state: a small file, put in place by a rename

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _put(self, path: str, value: object) -> None:
        temporary = f"{path}.{uuid.uuid4().hex}"
        fs, at = self._fs(temporary)
        out = fs.create(at)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        _, place = self._fs(path)
        if fs.exists(place):
            fs.delete(place, False)
        fs.rename(at, place)

    @property
    def state(self) -> dict:
        text = self.spark.read.text(f"{self.folder}/state", wholetext=True).first()
        return json.loads(text[0])

    # ingest

    def ingest(self, frames: DataFrame, batch: int | None = None) -> int:
        """Appends frames (data, timestamp_ns, perhaps frame_id, link_type, interface_id); returns the batch's number.

        Without frame_id the ids go on from the last one in the order of timestamps; with it they have to go on without a
        gap. A batch that is there already is left as it is.
        """
        state = self.state
        batch = len(state["batches"]) if batch is None else batch
        if batch < len(state["batches"]):
            return batch
        if batch > len(state["batches"]):
            raise OutOfOrder(f"batch {batch} before batch {len(state['batches'])}")
        cols = frames.columns
        defaults = {"link_type": F.lit(1), "interface_id": F.lit(0)}
        df = frames.withColumns({c: v for c, v in defaults.items() if c not in cols})
        if "frame_id" in cols:
            n, low, high, different = df.agg(F.count("*"), F.min("frame_id"), F.max("frame_id"), F.countDistinct("frame_id")).first()
            if n and (low != state["next"] or high != low + n - 1 or different != n):
                raise OutOfOrder(f"ids {low} to {high} ({n} frames) where {state['next']} is next")
        else:
            from framelake.operators.presence import Presence

            marked = df.withColumn("__at", F.monotonically_increasing_id())
            marked = marked.withColumn("__key", F.struct("timestamp_ns", "__at"))
            ranged = marked.repartitionByRange("__key").sortWithinPartitions("__key").drop("__key", "__at")
            kept = f"{self.folder}/.incoming-{uuid.uuid4().hex}"
            ranged.withColumn("__row", F.monotonically_increasing_id()).write.parquet(kept)
            stored = self.spark.read.parquet(kept)
            numbers = Presence(stored.select("__row"), "__row").numbered().withColumnRenamed("__row", "__r")
            df = stored.join(numbers, F.col("__row") == F.col("__r")).withColumn("frame_id", F.col("rank") + state["next"])
            n = stored.count()
        df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in FRAMES.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/frames/batch={batch}")
        state["batches"].append(n)
        state["next"] += n
        self._put("state", state)
        for name in state["series"]:
            self._fill(state, name, batch)
        return batch

    def follow(self, stream: DataFrame, checkpoint: str, available_now: bool = False):
        """Ingests a stream; a micro-batch that is tried again isn't ingested twice."""
        start = len(self.state["batches"])
        writer = stream.writeStream.foreachBatch(lambda df, i: self.ingest(df, start + i) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    # reads

    def frames(self, first: int = 0, count: int | None = None) -> DataFrame:
        df = self.spark.read.schema(FRAMES).parquet(*[f"{self.folder}/frames/batch={b}" for b in self._batches(first, count)]) if self._batches(first, count) else self.spark.createDataFrame([], FRAMES)
        return df.filter(F.col("frame_id") >= first) if count is None else df.filter(F.col("frame_id").between(first, first + count - 1))

    def _batches(self, first: int, count: int | None) -> list[int]:
        """The batches that hold a range of ids: others aren't opened."""
        out, at = [], 0
        for b, n in enumerate(self.state["batches"]):
            if n and at + n > first and (count is None or at < first + count):
                out.append(b)
            at += n
        return out

    def packets(self, first: int = 0, count: int | None = None, names: Iterable[str] = ()) -> DataFrame:
        """Contiguous: every packet of the range."""
        return packet.packets(self.frames(first, count), names)

    def matching(self, text: str, first: int = 0, count: int | None = None, show: Iterable[str] = ()) -> DataFrame:
        """Gapped: the packets of the range that match. Filters with a flank see the range alone."""
        return packet.find(self.frames(first, count), text, show)

    def visit(self, visitor: Callable[[Iterator[Row]], None], first: int = 0, count: int | None = None, text: str = "", show: Iterable[str] = ()) -> None:
        """Calls visitor once a partition, on the executors, with its packets in the order of their ids."""
        found = self.matching(text, first, count, show)
        found.repartitionByRange("packet_id").sortWithinPartitions("packet_id").foreachPartition(visitor)

    def export(self, target: str, text: str = "", first: int = 0, count: int | None = None, names: list[str] | None = None, overwrite: bool = False) -> None:
        """A dataset of the packets of the range that match."""
        layout = packet.layout()
        names = names or ["frame.len"]
        writers.write_dataset(self.matching(text, first, count, names), layout, target, names, overwrite=overwrite)

    # series that follow the log

    def record(self, name: str, field: str, capture: str = "all") -> None:
        """Records a field from the first frame on, and from now on with every batch."""
        state = self.state
        state["series"][name] = {"field": field, "capture": capture}
        self._put("state", state)
        for b in range(len(state["batches"])):
            self._fill(state, name, b)

    def _series_at(self, state: dict, name: str) -> str:
        return f"{self.folder}/generation={state['generation']}/series={name}"

    def _fill(self, state: dict, name: str, batch: int) -> None:
        spec = state["series"][name]
        df = packet.packets(self.spark.read.schema(FRAMES).parquet(f"{self.folder}/frames/batch={batch}"), [spec["field"]])
        series.series(df, packet.layout(), spec["field"], spec["capture"]).write.mode("overwrite").parquet(f"{self._series_at(state, name)}/batch={batch}")

    def series(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._series_at(self.state, name)).drop("batch")

    def snapshot(self, name: str) -> series.Snapshot:
        return series.Snapshot(self.series(name), self.state["next"])

    def restart(self) -> int:
        """Makes all that was made of the frames again, under a new generation, with the layers and post-parsers that are registered now; readers move over when it is whole."""
        state = self.state
        old = state["generation"]
        state["generation"] = old + 1
        for name in state["series"]:
            for b in range(len(state["batches"])):
                self._fill(state, name, b)
        self._put("state", state)
        fs, at = self._fs(f"generation={old}")
        fs.delete(at, True)
        return old + 1


class MatchCache:
    """Verdicts of filters over a session: ids that were evaluated, up to a watermark, and those of them that matched."""

    def __init__(self, session: Session) -> None:
        self.session = session

    def _at(self, text: str) -> str:
        return f"verdicts/{hashlib.sha256(text.encode()).hexdigest()[:32]}"

    def ids(self, text: str) -> DataFrame:
        """(packet_id) of the packets that match; only packets that came since the last call are evaluated."""
        if compile_filter(text, packet.layout()).stateful:
            raise ValueError("a filter with flank depends on what it has seen")
        s, at = self.session, self._at(text)
        mark = f"{at}/mark"
        done = json.loads(s.spark.read.text(f"{s.folder}/{mark}", wholetext=True).first()[0])["next"] if s._exists(mark) else 0
        upto = s.state["next"]
        if done < upto or not s._exists(f"{at}/ids"):
            s.matching(text, done, upto - done).select("packet_id").write.mode("overwrite").parquet(f"{s.folder}/{at}/ids/from={done}")
            s._put(mark, {"next": upto})
        return s.spark.read.parquet(f"{s.folder}/{at}/ids").select("packet_id")


def interleaved(df: DataFrame, source: str, order: str) -> DataFrame:
    """Numbers frames of several sources in the order of their times, ties by source: an order for ingest()."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(source).orderBy(order))).orderBy(order, source, "__n").drop("__n")
