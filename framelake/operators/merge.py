"""Packets of several sources in one order, and cuts of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 18
#: The sizes of no more sources are constants of the plan; more are counted round by round.
PLAN_SOURCES = 1_000


def round_robin(df: DataFrame, source: str, order: str, position: str | None = None) -> DataFrame:
    """df with `packet_id`, dense from 0: the first of every source, then the second of every source, and so on.

    The place of a row needs its number within its source and, for each source, only the number of
    rows: with n rows before it in its own source, it has min(n + 1, size) of each source before it in
    position, and min(n, size) of the others. Where sources are few (PLAN_SOURCES at most) their sizes
    are constants of the plan; else the rows of each round are counted and ranked by position. Numbers
    within a source come from bucket counts, so that no task sorts a source.
    """
    position = position or source
    rows = df.withColumn("__b", F.floor(F.col(order) / BUCKET))
    counts = rows.groupBy(source, "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(source).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(source).alias("__s"), F.col("__b").alias("__bb"), before.alias("__before"))
    inner = F.row_number().over(Window.partitionBy(source, "__b").orderBy(order)) - 1
    numbered = rows.withColumn("__inner", inner).join(counts, (F.col(source) == F.col("__s")) & (F.col("__b") == F.col("__bb"))).withColumn("__n", F.col("__before") + F.col("__inner"))
    sizes = df.groupBy(F.col(position).alias("p")).agg(F.count("*").alias("n")).limit(PLAN_SOURCES + 1).collect()
    if len(sizes) > PLAN_SOURCES:
        return _by_rounds(numbered, position).drop("__b", "__s", "__bb", "__before", "__inner", "__n")
    if not sizes:
        return df.withColumn("packet_id", F.lit(None).cast("bigint"))
    each = F.array(*[F.struct(F.lit(r["p"]).alias("p"), F.lit(r["n"]).cast("bigint").alias("n")) for r in sizes])
    place = F.aggregate(each, F.lit(0).cast("bigint"), lambda t, s: t + F.least(s["n"], F.col("__n") + F.when(s["p"] < F.col(position), 1).otherwise(0)))
    return numbered.withColumn("packet_id", place).drop("__b", "__s", "__bb", "__before", "__inner", "__n")


def _by_rounds(numbered: DataFrame, position: str) -> DataFrame:
    """numbered (.., __n: the number within its source) with packet_id. A round has a row a source at most."""
    rounds = numbered.groupBy("__n").agg(F.count("*").alias("__c")).withColumn("__rb", F.floor(F.col("__n") / BUCKET))
    blocks = rounds.groupBy("__rb").agg(F.sum("__c").alias("__block"))
    earlier = F.coalesce(F.sum("__block").over(Window.orderBy("__rb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("__rb").alias("__rb2"), earlier.alias("__earlier"))
    inside = F.coalesce(F.sum("__c").over(Window.partitionBy("__rb").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rounds.withColumn("__in", inside).join(blocks, F.col("__rb") == F.col("__rb2")).select(F.col("__n").alias("__round"), (F.col("__earlier") + F.col("__in")).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__n").orderBy(position)) - 1
    return numbered.withColumn("__rank", rank).join(starts, F.col("__n") == F.col("__round")).withColumn("packet_id", (F.col("__start") + F.col("__rank")).cast("bigint")).drop("__rank", "__round", "__start")


def parts(df: DataFrame, size: int, order: str = "packet_id") -> DataFrame:
    """df with `part`, from 1: part files of `size` packets of a dense order."""
    return df.withColumn("part", (F.floor(F.col(order) / size) + 1).cast("int"))


def parts_by_bytes(df: DataFrame, data: str, most_bytes: int, order: str = "packet_id") -> DataFrame:
    """df with `part`, from 1: a part is closed by the packet with which it reaches most_bytes of a running sum over all packets, so that parts differ by a packet at most."""
    from framelake.operators.running import summed

    return summed(df, "__upto", F.octet_length(data).cast("bigint"), order).withColumn("part", (F.floor(F.col("__upto") / most_bytes) + 1).cast("int")).drop("__upto")


def limit_matches(df: DataFrame, n: int, order: str = "packet_id") -> DataFrame:
    return df.orderBy(order).limit(n)


def by_ids(df: DataFrame, first: int, count: int, order: str = "packet_id") -> DataFrame:
    """Rows of a range of ids, one for each id: the other columns are null for ids that aren't there."""
    wanted = df.sparkSession.range(first, first + count).withColumnRenamed("id", "__wanted")
    found = df.filter(F.col(order).between(first, first + count - 1))
    return wanted.join(found, F.col("__wanted") == F.col(order), "left").select(F.col("__wanted").alias(order), *[c for c in df.columns if c != order])
