"""Embedding near-dedup by cross-polytope hashing.

A vector is turned by pseudo-random rotations (three rounds of random signs and a fast Hadamard
transform), and hashed to the coordinate of the greatest magnitude, with its sign. A table's key
joins several such hashes; their number grows with the logarithm of the number of distinct
vectors, so that buckets of unrelated vectors stay small. Every vector is stored under its own key
in each table, and looks under its own key and the next likely ones (multiprobe: the second
greatest coordinates where they come nearest to the first). The more hashes a key joins, the fewer
near pairs meet in a table; the number of tables grows with the hashes, so that the share of pairs at
the threshold that meet in none stays below MISSED at every size. Pairs that meet are verified by
their cosine in double precision, after each is scaled by a power of two, which changes no digit,
so that squares neither overflow nor vanish.

Equal vectors are one class: it is hashed once, its members link with each other, and count in the
links of the classes near it. Buckets are met by an equi-join, which Spark may split where one is
large; no task gathers a bucket.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing
and are their own component; vectors of different lengths don't link; repeated rows are vectors of
their own; a null vec_id takes part, and is the least only where there is no other; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import cut
from framelake.llm.components import components

#: Tables at least, further buckets that a vector looks into in each, and the seed of the rotations.
TABLES, PROBES, SEED = 8, 3, 11
#: The share of pairs at the threshold that may meet in no table.
MISSED = 2e-5


def hadamard(x: np.ndarray) -> np.ndarray:
    """Along the last axis, whose length is a power of two; scaled to keep lengths."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x / math.sqrt(n)


def keys(vectors: np.ndarray, hashes: int, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(vectors, tables, 1 + probes): the own key first. vectors: (vectors, length)."""
    n, d = vectors.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :d] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rng = np.random.default_rng([seed, width])
    rows = np.arange(n)
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        best, gap, second = (np.empty((n, hashes), k) for k in (np.int64, np.float64, np.int64))
        for j in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            first = size.argmax(1)
            top = size[rows, first]
            size[rows, first] = -1
            next_ = size.argmax(1)
            best[:, j] = 2 * first + (y[rows, first] < 0)
            second[:, j] = 2 * next_ + (y[rows, next_] < 0)
            gap[:, j] = top - size[rows, next_]
        base = (2 * width) ** np.arange(hashes, dtype=np.int64)
        own = best @ base
        change = (second - best) * base
        # the likeliest other keys: changes of the hashes with the least gaps, singly and together
        subsets = sorted(range(1, 1 << min(hashes, 4)), key=lambda m: (m.bit_count(), m))
        order = np.argsort(gap, axis=1, kind="stable")
        cost = np.stack([sum(np.take_along_axis(gap, order[:, i : i + 1], 1)[:, 0] ** 2 for i in range(4) if m >> i & 1) for m in subsets], axis=1)
        moved = np.stack([own + sum(np.take_along_axis(change, order[:, i : i + 1], 1)[:, 0] for i in range(4) if m >> i & 1) for m in subsets], axis=1)
        pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        near = np.take_along_axis(moved, pick, 1)
        out[:, t, 0] = own
        out[:, t, 1 : 1 + near.shape[1]] = near
        out[:, t, 1 + near.shape[1] :] = own[:, None]
    return out


def hashes_for(n: int, length: int) -> int:
    """So many that unrelated vectors rarely share a bucket, and that keys fit 63 bits."""
    width = 1 << max(1, (max(1, length) - 1).bit_length())
    return max(1, min(math.ceil(math.log(max(2, n)) / math.log(2 * width)), int(62 / math.log2(2 * width))))


def tables_for(hashes: int, length: int, threshold: float, probes: int = PROBES) -> int:
    """So many that of pairs with that cosine a share of MISSED at most meets in none; by drawn pairs, two deviations to the safe side."""
    width = 1 << max(1, (max(1, length) - 1).bit_length())
    n, tried = max(50, min(1000, 64_000 // width)), 8
    rng = np.random.default_rng([SEED, width, hashes])
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, n, width)))
    b -= (a * b).sum(1, keepdims=True) * a
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold * threshold)) * b / np.linalg.norm(b, axis=1, keepdims=True)
    ka, kb = keys(a, hashes, tried, probes, SEED + 1), keys(b, hashes, tried, probes, SEED + 1)
    met = ((ka == kb[:, :, :1]) | (kb == ka[:, :, :1])).any(2).mean()
    least = max(1 / (n * tried), met - 2 * math.sqrt(met * (1 - met) / (n * tried)))
    return 1 if least >= 1 else math.ceil(math.log(MISSED) / math.log(1 - least))


def close_pairs(classes: DataFrame, threshold: float, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(a, b) with a < b: classes (cid, v: array<double>, norm) found with at least that cosine."""
    n, length = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    hashes = hashes_for(n, length or 1)
    tables = max(tables, tables_for(hashes, length or 1, threshold, probes))

    @F.pandas_udf("array<array<long>>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list = [None] * len(batch)
            lengths = batch.map(len).to_numpy()
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                for i in range(0, len(at), 2048):
                    part = at[i : i + 2048]
                    for k, row in zip(part, keys(np.stack(batch.iloc[part].to_numpy()).astype(float), hashes, tables, probes), strict=True):
                        out[k] = row.tolist()
            yield pd.Series(out)

    made = cut(classes.select("cid", "v", "norm", F.size("v").alias("d"), hashed("v").alias("k")))
    looks = made.select("cid", "d", F.posexplode("k").alias("t", "ks")).select("cid", "d", "t", F.explode(F.array_distinct("ks")).alias("key"))
    stored = made.select(F.col("cid").alias("cid2"), "d", F.posexplode("k").alias("t", "ks")).select("cid2", "d", "t", F.col("ks")[0].alias("key"))
    met = looks.join(stored, ["d", "t", "key"]).filter("cid <> cid2").select(F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b")).distinct()
    left = made.select(F.col("cid").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na"))
    right = made.select(F.col("cid").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return met.join(left, "a").join(right, "b").filter(dot / (F.col("na") * F.col("nb")) >= threshold).select("a", "b")


def groups(vectors: DataFrame, threshold: float = 0.95, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    greatest = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    plain = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (greatest > 0), F.lit(False))
    marked = rows.withColumn("ok", plain)
    sound = marked.filter("ok")
    classes = cut(sound.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("size")))
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(greatest)), F.lit(-1022)).cast("double"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    scaled = classes.select("cid", "v", unit.alias("unit")).select("cid", F.transform("v", lambda x: x / F.col("unit")).alias("v")).withColumn("norm", norm)
    pairs = cut(close_pairs(scaled, threshold, tables, probes))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(classes.select(F.col("cid").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("others")).withColumnRenamed("a", "cid")
    found = components(pairs).withColumnRenamed("node", "cid")
    labelled = classes.select("cid", "v", "first", "size").join(near, "cid", "left").join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = labelled.join(least, "component").select("v", "component_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    linked = sound.select("vec_id", "v").join(of_class, "v").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = marked.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
