"""Mixing sources to target weights by entropy balancing.

A document i of source s with x words gets the rate min(cap, exp(lambda_s * x / mean_s)): the
rates nearest to one in relative entropy, none above the cap, for which the words of each source
meet its target. The convex dual separates by source; every Newton step is one distributed
aggregation over the (source, size) histogram, safeguarded by a bracket. Totals, targets and
multipliers are rows of a table of sources, of which there may be any number; the driver holds only
counts. The rates are then
rounded to whole copies: within a source, from the longest documents to the shortest, each size
class takes the number of copies that brings the running total nearest to the running target, so
that the short ones absorb what rounding the long ones left.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last;
documents of size 0 are taken 0 times; repeated rows are documents of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import WORD, cut

#: A table of sources of no more rows is broadcast; a larger one is joined by exchange.
BROADCAST_SOURCES = 20_000
#: Newton steps, each of which at least halves the bracket; a source that isn't solved by then is an error.
STEPS = 200
#: Rows of one (source, size) class that one task ranks; larger classes are split by a hash.
CLASS_ROWS = 2_000


def share_targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """The sum of sizes shared by weight; what lies above cap times a size is shared again among the others."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def numbered(totals: DataFrame) -> DataFrame:
    """totals (source, ..) with sid: 0, 1, .. by code points, null last. Each range is ranked by itself; the driver holds a count a range."""
    ranged = cut(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, pairs = 0, []
    for part, n in counts:
        pairs += [F.lit(part), F.lit(before)]
        before += n
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    start = F.element_at(F.create_map(*pairs), F.col("part")) if pairs else F.lit(0)
    return ranged.withColumn("sid", (rank + start - 1).cast("long")).drop("part")


def add_targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """sources (sid, words, ..) with target, as share_targets() gives it.

    A source is capped if the words that a unit of weight gets are more than cap times its size asks for. That unit only
    rises while capped sources give back, so that each step is one sum on either side of it.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = cut(sources.withColumn("weight", w))
    over = lambda unit: F.lit(unit) * F.col("weight") > F.col("words") * float(cap)
    total = s.agg(F.sum("words")).first()[0] or 0
    unit = 0.0
    while total:
        capped = over(unit) & (F.col("words") > 0) if unit else F.lit(False)
        r = s.filter("words > 0").agg(F.sum(F.when(~capped, F.col("weight"))).alias("w"), F.sum(F.when(capped, F.col("words") * float(cap)).otherwise(0.0)).alias("x")).first()
        if r["w"] is None:
            break
        new = (total - r["x"]) / r["w"]
        if new <= unit * (1 + 1e-15):
            break
        unit = new
    return s.withColumn("target", F.when(F.col("words") <= 0, 0.0).when(over(unit), F.col("words") * float(cap)).otherwise(F.lit(unit) * F.col("weight"))).drop("weight")


def _joined(big: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    return big.join(F.broadcast(sources) if n <= BROADCAST_SOURCES else sources, "sid")


def tilts(hist: DataFrame, sources: DataFrame, n: int, cap: float, tolerance: float = 1e-7) -> DataFrame:
    """(sid, lam, mean): the multiplier of each of n sources (sid, words, rows, target). hist: (sid, size, n). Infinite where every document is taken cap times."""
    nan, inf = F.lit(math.nan), F.lit(math.inf)
    full = F.col("target") >= F.col("words") * float(cap) * (1 - 1e-12)
    state = sources.select("sid", "target", (F.col("words") / F.greatest("rows", F.lit(1))).alias("mean"), F.when(full & (F.col("words") > 0), inf).otherwise(0.0).alias("lam"), (-inf).alias("lo"), inf.alias("hi"), ((F.col("words") <= 0) | full).alias("done"))
    state = cut(state)
    for _ in range(STEPS):
        if state.filter("not done").isEmpty():
            return state.select("sid", "lam", "mean")
        at = _joined(hist, state.filter("not done").select("sid", "lam", "mean"), n)
        z = F.col("size") / F.col("mean")
        tilt = F.col("lam") * z
        free = tilt < math.log(cap)
        rate = F.when(free, F.exp(F.least(tilt, F.lit(math.log(cap))))).otherwise(F.lit(float(cap)))
        words = F.col("n") * F.col("size")
        sums = at.groupBy("sid").agg(F.sum(words * rate).alias("g"), F.sum(F.when(free, words * z * rate).otherwise(0.0)).alias("d"))
        s = state.join(F.broadcast(sums) if n <= BROADCAST_SOURCES else sums, "sid", "left")
        met = F.col("done") | (F.abs(F.col("g") - F.col("target")) <= F.col("target") * tolerance)
        s = s.withColumns({"met": met, "lo": F.when(F.col("g") > F.col("target"), F.col("lo")).otherwise(F.greatest("lo", "lam")), "hi": F.when(F.col("g") > F.col("target"), F.least("hi", "lam")).otherwise(F.col("hi"))})
        # Newton on log g, whose slope is nearer to a constant than that of g
        newton = F.when((F.col("d") > 0) & (F.col("g") > 0), F.col("lam") + (F.log("target") - F.log("g")) * F.col("g") / F.col("d")).otherwise(nan)
        within = ~F.isnan(newton) & (newton > F.col("lo")) & (newton < F.col("hi"))
        below, above = F.col("lo") > -inf, F.col("hi") < inf
        halved = F.when(below & above, (F.col("lo") + F.col("hi")) / 2).when(below & (F.col("lo") >= 0), 2 * F.col("lo") + 1).when(above & (F.col("hi") <= 0), 2 * F.col("hi") - 1).otherwise(0.0)
        lam = F.when(F.col("met"), F.col("lam")).when(within, newton).otherwise(halved)
        state = cut(s.select("sid", "target", "mean", lam.alias("lam"), "lo", "hi", F.col("met").alias("done")))
    raise RuntimeError(f"{state.filter('not done').count()} sources aren't solved after {STEPS} steps")


def solve_tilts(hist: DataFrame, totals: list[int], rows: list[int], targets: list[float], cap: float) -> list[float]:
    """tilts() of a few sources, as lists by sid."""
    sources = hist.sparkSession.createDataFrame([(i, int(w), int(r), float(t)) for i, (w, r, t) in enumerate(zip(totals, rows, targets, strict=True))], "sid long, words long, rows long, target double")
    return [r["lam"] for r in tilts(hist, sources, len(totals), cap).orderBy("sid").collect()]


def _round_source(pdf: pd.DataFrame, cap: float) -> pd.DataFrame:
    """Copies for each size of one source (sid, size, n, lam, mean), by carrying the error from long to short documents.

    One row a distinct size: d of them need d * d / 2 words at least, so that a source of 10**13 words
    has under five million.
    """
    pdf = pdf.sort_values("size", ascending=False)
    want = got = 0.0
    low, extra = [], []
    for size, n, lam, mean in zip(pdf["size"], pdf["n"], pdf["lam"], pdf["mean"], strict=True):
        if size <= 0:
            low.append(0)
            extra.append(0)
            continue
        tilt = lam * size / (mean or 1.0)
        rate = cap if tilt >= math.log(cap) else math.exp(tilt)
        floor = math.floor(rate + 1e-12)
        ceil = min(math.floor(cap), math.ceil(rate - 1e-12))
        want += n * rate * size
        copies = min(max(round((want - got) / size), n * floor), n * max(floor, ceil))
        got += copies * size
        low.append(floor)
        extra.append(copies - n * floor)
    return pdf.assign(low=low, extra=extra)[["sid", "size", "n", "low", "extra"]]


def _spread(parts: DataFrame, plan: DataFrame) -> DataFrame:
    """(sid, size, b, low, extra): the extra copies of a size dealt to its parts (sid, size, b, here) by their rows."""
    upto = F.sum("here").over(Window.partitionBy("sid", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    dealt = parts.join(plan, ["sid", "size"]).withColumn("upto", upto)
    share = lambda rows: F.expr(f"cast(extra as decimal(19, 0)) * cast({rows} as decimal(19, 0)) div n")
    return dealt.select("sid", "size", "b", "low", (share("upto") - share("(upto - here)")).alias("extra"))


def _same(left: DataFrame, right: DataFrame, column: str, small: bool) -> DataFrame:
    """The rows of left with those of right that have the same value, null being one."""
    named = right.withColumnRenamed(column, "__same")
    condition: Column = left[column].eqNullSafe(named["__same"])
    return left.join(F.broadcast(named) if small else named, condition).drop("__same")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs."""
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id").alias("h")))
    hist = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = cut(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("rows"), F.max("n").alias("most")))
    n, most = totals.agg(F.count("*"), F.max("most")).first()
    small = n <= BROADCAST_SOURCES
    sources = cut(add_targets(numbered(totals.drop("most")), weights, cap))
    parts = max(1, math.ceil((most or 1) / CLASS_ROWS))
    named = cut(_same(hist, sources.select("source", "sid"), "source", small).select("sid", "size", "n"))
    lam = tilts(named, sources, n, cap)
    ids = sources.select("source", "sid", F.col("words").alias("source_size"), "target")
    keyed = _same(sized, ids, "source", small).select("doc_id", "source", "sid", "size", "source_size", "target", "h", F.pmod("h", F.lit(parts)).cast("int").alias("b"))
    rounded = _joined(named, lam, n).groupBy("sid").applyInPandas(lambda pdf: _round_source(pdf, cap), "sid long, size long, n long, low long, extra long")
    plan = _spread(keyed.groupBy("sid", "size", "b").agg(F.count("*").alias("here")), rounded)
    rank = F.row_number().over(Window.partitionBy("sid", "size", "b").orderBy("h", "doc_id"))
    copies = (F.col("low") + F.when(rank <= F.col("extra"), 1).otherwise(0)).cast("int")
    out = keyed.join(plan, ["sid", "size", "b"]).withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
