"""Values carried along an order without a single-partition window.

Ids are cut into buckets. Inside a bucket a window does the work; what comes before it is folded to
one row a bucket, and only those rows are put in one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of a bucket: few enough that a small table is worked on by several tasks, so many that 10**12 ids have 15 million rows to put in one order.
BUCKET = 1 << 16


def summed(df: DataFrame, name: str, value: Column, order: str, bucket: int = BUCKET) -> DataFrame:
    """df with the sum of the values of the rows before each."""
    slot = F.floor(F.col(f"`{order}`") / bucket)
    rows = df.withColumn("__slot", slot).withColumn("__value", value)
    ends = rows.groupBy("__slot").agg(F.sum("__value").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(F.col("__slot").alias("__s"), before.alias("__before"))
    inner = F.coalesce(F.sum("__value").over(Window.partitionBy("__slot").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__inner", inner).join(ends, F.col("__slot") == F.col("__s")).withColumn(name, F.col("__before") + F.col("__inner")).drop("__slot", "__value", "__s", "__before", "__inner")


def carried(df: DataFrame, name: str, value: Column, order: str, partition_by: list[str], how: str = "last", inclusive: bool = False, bucket: int = BUCKET) -> DataFrame:
    """df with the last (or greatest) non-null value of the rows before each, or up to it."""
    slot = "__slot"
    rows = df.withColumn(slot, F.floor(F.col(f"`{order}`") / bucket)).withColumn("__value", value)
    keys = [F.col(f"`{c}`") for c in partition_by]
    inner = Window.partitionBy(*keys, slot).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = F.last("__value", True).over(inner) if how == "last" else F.max("__value").over(inner)
    folded = F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(f"`{order}`"))) if how == "last" else F.max("__value")
    ends = rows.groupBy(*keys, slot).agg(folded.alias("__end"))
    outer = Window.partitionBy(*[F.col(f"`{c}`") for c in partition_by]).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    before = (F.last("__end", True) if how == "last" else F.max("__end")).over(outer)
    ends = ends.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(partition_by)], F.col(slot).alias("__s"), before.alias("__before"))
    same = F.col(slot) == F.col("__s")
    for i, c in enumerate(partition_by):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"__k{i}"))
    joined = rows.withColumn("__local", local).join(ends, same, "left")
    value_out = F.coalesce("__local", "__before") if how == "last" else F.greatest("__local", "__before")
    return joined.withColumn(name, value_out).drop(slot, "__value", "__local", "__s", "__before", *[f"__k{i}" for i in range(len(partition_by))])
