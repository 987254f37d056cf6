"""Value series: (row, packet_id, timestamp_ns, value) of a field, and reads from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.catalog import Field
from framelake.operators.running import carried
from framelake.plans.compiler import Layout
from framelake.types import NODE_COLUMN, NODE_TYPES, default_text


def series(df: DataFrame, layout: Layout, name: str, capture: str = "all") -> DataFrame:
    """capture: all occurrences, or the first of each packet."""
    values = F.col(f"`{layout.columns[name]}`")
    if capture == "first":
        values = F.slice(values, 1, 1)
    return df.select(F.col(layout.packet_id).alias("packet_id"), F.col(layout.timestamp).alias("timestamp_ns"), F.posexplode(values).alias("occurrence", "value"))


def id_range(s: DataFrame, first: int, last: int) -> DataFrame:
    return s.filter(F.col("packet_id").between(first, last))


def id_span(s: DataFrame, first: int, last: int, order: str = "packet_id") -> DataFrame:
    """(found, first_row, rows): the rows of a range of ids, as a span of the series in its order; found is false, and the rest null, where ids don't ascend, for then there is no such span."""
    inside = F.col("packet_id").between(first, last)
    counts = s.agg(F.count_if(F.col("packet_id") < first).alias("first_row"), F.count_if(inside).alias("rows"))
    ok = F.col("ids_ascend")
    return monotone(s, order).crossJoin(counts).select(ok.alias("found"), F.when(ok, F.col("first_row")).alias("first_row"), F.when(ok, F.col("rows")).alias("rows"))


def time_range(s: DataFrame, first: int, last: int) -> DataFrame:
    return s.filter(F.col("timestamp_ns").between(first, last))


def tail(s: DataFrame, watermark: int) -> DataFrame:
    """What came from packet id `watermark` on."""
    return s.filter(F.col("packet_id") >= watermark)


def monotone(s: DataFrame, order: str = "packet_id") -> DataFrame:
    """(ids_ascend, times_ascend): whether ids and times never fall in the order in which rows arrived."""
    one = s.filter("occurrence = 0") if "occurrence" in s.columns else s
    here = F.struct(F.col("packet_id").alias("p"), F.col("timestamp_ns").alias("t"))
    seen = carried(one.select(*dict.fromkeys([order, "packet_id", "timestamp_ns"])), "prev", here, order, [])
    never = lambda a, b: F.coalesce(F.bool_and(F.col("prev").isNull() | (F.col(a) <= F.col(b))), F.lit(True))
    return seen.agg(never("prev.p", "packet_id").alias("ids_ascend"), never("prev.t", "timestamp_ns").alias("times_ascend"))


def packet_presence(df: DataFrame, layout: Layout, name: str) -> DataFrame:
    """(packet_id, timestamp_ns, present): a row a packet, whether it has the protocol or field or not."""
    has = F.array_contains(layout.protocols, name) if name in layout.catalog.protocols else F.size(F.col(f"`{layout.columns[name]}`")) > 0
    return df.select(F.col(layout.packet_id).alias("packet_id"), F.col(layout.timestamp).alias("timestamp_ns"), F.coalesce(has, F.lit(False)).alias("present"))


def text_series(df: DataFrame, layout: Layout, name: str, capture: str = "all") -> DataFrame:
    """series() with the text of each value instead of the value."""
    return series(df, layout, name, capture).withColumn("value", default_text(F.col("value"), layout.catalog.fields[name].type))


def record_all(df: DataFrame, layout: Layout, names: list[str] | None = None) -> DataFrame:
    """(field, packet_id, timestamp_ns, occurrence, i64, f64, str, bin, dec, bool): the series of all valued fields, in one pass."""
    fields = layout.catalog.select(names) if names is not None else [f for f in layout.catalog.fields.values() if f.type in NODE_COLUMN and f.name in layout.columns]

    def rows(f: Field) -> Column:
        def of(v: Column, i: Column) -> Column:
            return F.struct(F.lit(f.name).alias("field"), i.alias("occurrence"), *[(v if NODE_COLUMN[f.type] == k else F.lit(None)).cast(t).alias(k) for k, t in NODE_TYPES.items()])

        return F.transform(F.col(f"`{layout.columns[f.name]}`"), of)

    each = df.select(F.col(layout.packet_id).alias("packet_id"), F.col(layout.timestamp).alias("timestamp_ns"), F.explode(F.concat(*[rows(f) for f in fields])).alias("r"))
    return each.select("r.field", "packet_id", "timestamp_ns", "r.occurrence", *[f"r.{k}" for k in NODE_TYPES])


class Snapshot:
    """A series as it was up to a packet id: later rows of the table behind it don't show."""

    def __init__(self, s: DataFrame, watermark: int) -> None:
        self.rows, self.watermark = s.filter(F.col("packet_id") < watermark), watermark

    def tail(self, s: DataFrame) -> DataFrame:
        """What a newer series has beyond this one."""
        return tail(s, self.watermark)


def capped(s: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """The first rows by packet id, and (incomplete) whether there were more: the cap of a bounded cache."""
    return s.orderBy("packet_id", "occurrence").limit(rows), s.agg((F.count("*") > rows).alias("incomplete"))
