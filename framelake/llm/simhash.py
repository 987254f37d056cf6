"""SimHash near-dedup by a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most two bits
share at least six of them, and so, of the four pairs of neighbouring positions, at least two
whole pairs. The index posts each distinct fingerprint under the bytes of any two of the four
pairs (six postings of 32 bits each). For pairs that meet in a posting the shared positional bytes
are tallied, pairs with fewer than the guaranteed six are dropped, and the rest verified by their
bits. Only distinct fingerprints are indexed: documents with equal ones are one node.

A posting with more than LIGHT members isn't expanded into pairs: its members agree in 32 bits, so
those within two bits share a fingerprint at distance one at most in the other 32, and each is
posted under its 33. Groups under these have 33 members at most, all within two bits of each
other, so that a chain of links stands for them; none is lost and the work stays linear.

Defined cases: a null text has no word and the fingerprint zero, which links like any other; a
null doc_id takes part and is the least of its component only where there is no other; repeated
rows share a fingerprint; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import cut, release_memory
from framelake.llm.components import components

LIGHT = 32
#: near_copies(): words of a sketch's shingles, its bytes, the bits by which sketches of copies may differ, shared bytes that are
#: expected of copies at the threshold, and postings under which such a pair is expected to meet.
SKETCH_WORDS, SKETCH_BYTES, SKETCH_BITS, SHARED, MEETINGS = 2, 16, 32, 7, 9.0
#: Rows of a table that is broadcast; larger ones are joined by exchange.
BROADCAST_ROWS = 500_000
#: Words of a shingle, the seed of its hash, and the bits by which linked fingerprints may differ.
SHINGLE, SEED, BITS = 3, 42, 2


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """As an unsigned number. bytes.lower() and bytes.split() know ASCII only, as wanted here."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    grams = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))) if len(words) >= shingle else [b" ".join(words)]
    total = np.zeros(64, np.int64)
    for i in range(0, len(grams), 1 << 16):
        part = grams[i : i + (1 << 16)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(seed)), np.uint64, len(part))
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp: long, the 64 bits)."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([simhash(t, shingle) for t in batch], np.uint64).view(np.int64))
        release_memory()

    return docs.select("doc_id", run(F.col("text")).alias("fp"))


def _byte(fp: str, position: int) -> Column:
    return F.shiftright(F.col(fp), 8 * position).bitwiseAND(F.lit(255))


def _postings(fps: DataFrame) -> DataFrame:
    """(slot, key, fp): six for each fingerprint. key: the 32 bits at the slot's two pairs of positions."""
    pair = [F.shiftright("fp", 16 * i).bitwiseAND(F.lit(65535)) for i in range(4)]
    slots = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return fps.select("fp", F.explode(F.array(*[F.struct(F.lit(n).cast("tinyint").alias("slot"), F.shiftleft(pair[i], 16).bitwiseOR(pair[j]).alias("key")) for n, (i, j) in enumerate(slots)])).alias("p")).select("p.slot", "p.key", "fp")


def _other_bits() -> Column:
    """For the slot of a row: the 33 masks that flip at most one bit outside the slot's positions."""
    slots = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    masks = []
    for kept in slots:
        free = [b for i in range(4) if i not in kept for b in range(16 * i, 16 * i + 16)]
        masks.append(F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b) for b in free]))
    return F.element_at(F.array(*masks), F.col("slot").cast("int") + 1)


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links that join what is within `bits` (2 at most) of each other into the right components. fps: distinct (fp)."""
    if not 0 <= bits <= 2:
        raise ValueError("the postings guarantee pairs of two differing bits at most")
    postings = _postings(fps)
    counts = postings.groupBy("slot", "key").agg(F.count("*").alias("n")).filter("n > 1")
    light = postings.join(counts.filter(F.col("n") <= LIGHT).select("slot", "key"), ["slot", "key"])
    members = light.groupBy("slot", "key").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    first = members.select(F.posexplode("m").alias("at", "a"), "m")
    pairs = first.select("a", F.explode(F.slice("m", F.col("at") + 2, F.size("m"))).alias("b"))
    tally = sum((F.when(_byte("a", i) == _byte("b", i), 1).otherwise(0) for i in range(8)), F.lit(0))
    close = pairs.filter(tally >= 8 - bits).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    heavy = postings.join(counts.filter(F.col("n") > LIGHT).select("slot", "key"), ["slot", "key"])
    if bits == 2:
        near = heavy.select("slot", "fp", F.explode(_other_bits()).alias("mask")).select("slot", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("centre"))
        met = near.groupBy("slot", "centre").agg(F.sort_array(F.collect_list("fp")).alias("m")).filter(F.size("m") > 1)
        chain = met.select(F.col("m")[0].alias("a"), F.explode(F.slice("m", F.lit(2), F.size("m"))).alias("b"))
    else:  # within one bit: either of them is the other with one of its 64 bits flipped
        flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b) for b in range(64)][: 64 * bits])
        near = heavy.select("fp").distinct().select("fp", F.explode(flips).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("centre"))
        chain = near.join(fps.select(F.col("fp").alias("centre")), "centre").select(F.col("fp").alias("a"), F.col("centre").alias("b")).filter("a <> b")
    return close.unionAll(chain)


def groups(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for every row of docs."""
    marked = cut(fingerprints(docs, shingle))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes.select("fp"), bits))
    labelled = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = labelled.join(least, "component").select("fp", "component_id")
    out = marked.join(of_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The document with the least doc_id of each component, with the columns of docs; repeated rows of it all stay."""
    kept = cut(groups(docs, shingle, bits).filter("kept").select(F.col("doc_id").alias("__kept_id")).distinct())
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept_id"]), "left_semi")


# near copies by the similarity of their shingles, found through sketches


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _grams(words: list[bytes], n: int) -> set[bytes]:
    return set(map(b" ".join, zip(*[words[i:] for i in range(n)], strict=False))) if len(words) >= n else {b" ".join(words)} if words else set()


def sketch(words: list[bytes]) -> tuple[int, int]:
    """The 128 bits of a SimHash over the set of shingles of SKETCH_WORDS words, as two signed numbers. Few words of a copy differ, and so few of its short shingles."""
    grams = list(_grams(words, SKETCH_WORDS))
    total = np.zeros(8 * SKETCH_BYTES, np.int64)
    for i in range(0, len(grams), 1 << 15):
        part = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, grams[i : i + (1 << 15)])), np.uint8)
        total += np.unpackbits(part.reshape(-1, SKETCH_BYTES), axis=1).sum(0, dtype=np.int64)
    hi, lo = np.packbits(total * 2 > len(grams)).view(">i8")
    return int(hi), int(lo)


def posting_positions(n: int) -> list[tuple[int, ...]]:
    """The positions whose bytes make the keys of n sketches: so many that unrelated sketches rarely share one, and so many keys that a pair which shares SHARED bytes is expected to share MEETINGS of them."""
    width = max(3, math.ceil(math.log(max(2, n), 256)))
    if width > 6:
        raise ValueError("keys of more than six bytes and their number don't fit 63 bits")
    every = list(combinations(range(SKETCH_BYTES), width))
    wanted = min(len(every), math.ceil(MEETINGS * math.comb(SKETCH_BYTES, width) / math.comb(SHARED, width)))
    return [every[i] for i in sorted(np.random.default_rng(SEED).choice(len(every), wanted, replace=False))]


def _position(i: int, a: str = "hi", b: str = "lo") -> Column:
    return F.shiftright(a if i < 8 else b, 8 * (i % 8)).bitwiseAND(F.lit(255))


def _met(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose tally of shared positional bytes reaches a key's, and whose bits differ little enough."""
    left = nodes.select(F.col("nid").alias("a"), F.col("hi").alias("ha"), F.col("lo").alias("la"), F.col("th").alias("ta"))
    right = nodes.select(F.col("nid").alias("b"), F.col("hi").alias("hb"), F.col("lo").alias("lb"), F.col("th").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    tally = sum((F.when(_position(i, "ha", "la") == _position(i, "hb", "lb"), 1).otherwise(0) for i in range(SKETCH_BYTES)), F.lit(0))
    differ = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) + F.bit_count(F.col("la").bitwiseXOR(F.col("lb")))
    return both.filter((tally >= 3) & (differ <= SKETCH_BITS)).select("a", "b", "ta", "tb")


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast where its rows were counted and are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(met: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) of met (a, b, ta, tb) whose sets of shingles are that similar. texts: (th, text); only those of pairs are looked at."""

    @F.pandas_udf("array<long>")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, _grams(_words(t), shingle)), np.uint64)).view(np.int64) for t in batch])
        release_memory()

    wanted = _small(cut(met.select(F.explode(F.array("ta", "tb")).alias("th")).distinct()))
    sets = cut(texts.join(wanted, "th", "left_semi").groupBy("th").agg(F.first("text").alias("text")).select("th", shingles("text").alias("s")))
    one = lambda n: sets.select(F.col("th").alias(f"t{n}"), F.col("s").alias(f"s{n}"))
    both = met.join(one("a"), "ta").join(one("b"), "tb")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, th, component_id, kept): th is xxhash64 of the text; components join documents whose sets of shingles have that Jaccard similarity at least.

    Sketches are posted under keys of a few of their positional bytes. Pairs that meet in a posting are counted and
    verified: first each member with three members of its posting, which joins a group of copies by a number of
    pairs in proportion to it; then all members of a posting that are still in different components. Documents
    of equal words are one node. Found are pairs that share a key, which at the threshold are most, and
    nearly all above it; nothing that is found is less similar.
    """

    @F.pandas_udf("struct<sid: string, hi: long, lo: long>")
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [_words(t) for t in batch]
            yield pd.DataFrame([(xxhash.xxh3_128_hexdigest(b" ".join(w)), *sketch(w)) for w in words], columns=["sid", "hi", "lo"])
            del batch, words
        release_memory()

    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    marked = cut(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), mark("text").alias("m")).select("doc_id", "th", "m.*"))
    nodes = cut(marked.groupBy("sid").agg(F.first("hi").alias("hi"), F.first("lo").alias("lo"), F.min("th").alias("th")))
    nodes = cut(nodes.withColumn("nid", F.monotonically_increasing_id()))
    n = nodes.count()
    positions = posting_positions(n)
    keys = []
    for k, where in enumerate(positions):
        key = F.lit(k).cast("long")
        for i in where:
            key = F.shiftleft(key, 8).bitwiseOR(_position(i))
        keys.append(key)
    posted = nodes.select("nid", F.explode(F.array(*keys)).alias("key"))
    stars = posted.groupBy("key").agg(F.min("nid").alias("l0"), F.max("nid").alias("l1"), F.min_by("nid", F.xxhash64("nid")).alias("l2"), F.count("*").alias("n")).filter("n > 1").drop("n")
    star = posted.join(stars, "key").select(F.col("nid").alias("x"), F.explode(F.array("l0", "l1", "l2")).alias("y")).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    first = cut(_verified(cut(_met(star, nodes)), texts, shingle, similarity))
    found = components(first)
    placed = cut(nodes.select("nid").join(found.withColumnRenamed("node", "nid"), "nid", "left").select("nid", F.coalesce("component", "nid").alias("c")))
    of_key = posted.join(placed, "nid")
    open_ = of_key.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
    some = of_key.join(open_, "key", "left_semi")
    apart = some.join(some.select("key", F.col("nid").alias("nid2"), F.col("c").alias("c2")), "key").filter("c < c2").select(F.least("nid", "nid2").alias("a"), F.greatest("nid", "nid2").alias("b")).distinct()
    second = cut(_verified(cut(_met(apart, nodes)), texts, shingle, similarity))
    ends = components(second.join(_ids(placed, "a"), "a").join(_ids(placed, "b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    whole = placed.join(ends.select(F.col("node").alias("c"), F.col("component").alias("root")), "c", "left").select("nid", F.coalesce("root", "c").alias("c"))
    of_sid = nodes.select("sid", "nid").join(whole, "nid").select("sid", "c")
    labelled = cut(marked.join(of_sid, "sid").select("doc_id", "th", "c"))
    least = labelled.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(least, "c").select("doc_id", "th", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _ids(placed: DataFrame, name: str) -> DataFrame:
    return placed.select(F.col("nid").alias(name), F.col("c").alias(f"c{name}"))


def dedup_near(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The document with the least doc_id of each component of near copies, with the columns of docs; repeated rows of it all stay."""
    gone = _small(cut(near_copies(docs, shingle, similarity).filter("not kept").select(F.col("doc_id").alias("__gone"), F.col("th").alias("__th")).distinct()))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["__th"]), "left_anti")
