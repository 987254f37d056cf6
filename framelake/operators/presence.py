"""Presence sets: which ids have a protocol, a group or a field, and the algebra of such sets.

A set is a frame with one column of distinct ids. Nothing is collected; counts, ranks and bounds are
aggregations, and ranks need no single sorted partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.plans.compiler import Layout


class Presence:
    def __init__(self, ids: DataFrame, key: str = "packet_id") -> None:
        self.ids, self.key = ids.select(key), key

    @classmethod
    def of_protocol(cls, df: DataFrame, layout: Layout, name: str, key: str | None = None) -> Presence:
        key = key or layout.packet_id
        return cls(df.filter(F.array_contains(layout.protocols, name)).select(key).distinct(), key)

    @classmethod
    def of_field(cls, df: DataFrame, layout: Layout, name: str, key: str | None = None) -> Presence:
        key = key or layout.packet_id
        return cls(df.filter(F.size(F.col(f"`{layout.columns[name]}`")) > 0).select(key).distinct(), key)

    @classmethod
    def of_group(cls, df: DataFrame, layout: Layout, group: str, key: str | None = None) -> Presence:
        key = key or layout.packet_id
        some = F.lit(False)
        for f in layout.catalog.fields.values():
            if f.group == group:
                some = some | (F.size(F.col(f"`{layout.columns[f.name]}`")) > 0)
        return cls(df.filter(some).select(key).distinct(), key)

    def _like(self, ids: DataFrame) -> Presence:
        return Presence(ids, self.key)

    def and_(self, other: Presence) -> Presence:
        return self._like(self.ids.join(other.ids, self.key, "left_semi"))

    def or_(self, other: Presence) -> Presence:
        return self._like(self.ids.union(other.ids).distinct())

    def and_not(self, other: Presence) -> Presence:
        return self._like(self.ids.join(other.ids, self.key, "left_anti"))

    def xor(self, other: Presence) -> Presence:
        """One exchange: an id of a symmetric difference comes once from the two sets."""
        return self._like(self.ids.unionAll(other.ids).groupBy(self.key).agg(F.count("*").alias("n")).filter("n = 1"))

    def count(self) -> DataFrame:
        return self.ids.agg(F.count("*").alias("n"))

    def bounds(self) -> DataFrame:
        return self.ids.agg(F.min(self.key).alias("lo"), F.max(self.key).alias("hi"))

    def contains(self, value: int) -> DataFrame:
        """(there)"""
        return self.ids.filter(F.col(self.key) == value).agg((F.count("*") > 0).alias("there"))

    def rank(self, value: int) -> DataFrame:
        """How many ids are at most value."""
        return self.ids.filter(F.col(self.key) <= value).agg(F.count("*").alias("n"))

    def numbered(self, bucket: int = 1 << 18) -> DataFrame:
        """(id, rank from 0): counts by bucket of ids, then a window inside each."""
        rows = self.ids.withColumn("__b", F.floor(F.col(self.key) / bucket))
        counts = rows.groupBy("__b").agg(F.count("*").alias("__n"))
        before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inner = F.row_number().over(Window.partitionBy("__b").orderBy(self.key))
        return rows.join(counts.select("__b", before.alias("__before")), "__b").select(self.key, (F.col("__before") + inner - 1).cast("bigint").alias("rank"))

    def select(self, k: int) -> DataFrame:
        return self.numbered().filter(F.col("rank") == k).select(self.key)

    def bitmaps(self) -> DataFrame:
        """(bucket, bitmap): 32768 ids to a bitmap."""
        return self.ids.groupBy(F.bitmap_bucket_number(self.key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(self.key)).alias("bitmap"))


def cardinalities(df: DataFrame, layout: Layout) -> DataFrame:
    """(protocol, n): packets of each protocol."""
    return df.select(layout.packet_id, F.explode(F.array_distinct(layout.protocols)).alias("protocol")).groupBy("protocol").agg(F.count("*").alias("n"))
