"""Exact dedup by content-defined chunk recipes.

A text's UTF-8 bytes are cut where a rolling hash of the last 16 bytes says so, which depends on
the content alone. Each distinct chunk is moved once, to be verified: chunks of one digest but
different bytes get different identifiers. Documents are then compared by their recipes, the
ordered lists of chunk identifiers, a few bytes for each KB of text; texts themselves aren't moved.

Defined cases: a null text is the empty text, whose recipe has no chunk; of rows that agree in text
and doc_id one stays; a null doc_id is below all others, and of rows that have no other one stays;
an empty table gives an empty result; other columns are ignored by groups() and kept by dedup().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import cut, release_memory

#: Bytes of a chunk: at least, about (a power of two), at most.
LEAST, ABOUT, MOST = 256, 1024, 4096
WINDOW = 16


def _gear() -> np.ndarray:
    """A random number for each byte value, from a fixed rule."""
    return np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), np.uint32)


GEAR = _gear()


def boundaries(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """The ends of the chunks of each text. data: all bytes; offsets: where each text begins, and the end of the last."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:  # the sum of the last `width` numbers, the i-th from the end shifted by i
        moved = np.zeros_like(h)
        moved[width:] = h[:-width] << np.uint32(width)
        h = h + moved
        width *= 2
    places = np.flatnonzero((h >> np.uint32(8) & np.uint32(ABOUT - 1)) == 0) + 1
    out = []
    lows = np.searchsorted(places, offsets[:-1] + LEAST, side="left").tolist()
    highs = np.searchsorted(places, offsets[1:], side="left").tolist()
    places = places.tolist()
    for start, stop, lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lows, highs, strict=True):
        ends, at = [], start
        for p in places[lo:hi]:
            while p - at > MOST:
                at += MOST
                ends.append(at)
            if p - at >= LEAST:
                ends.append(p)
                at = p
        while stop - at > MOST:
            at += MOST
            ends.append(at)
        if stop > at:
            ends.append(stop)
        out.append(ends)
    return out


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _chunks(column: pa.Array, digest: Callable[[bytes], bytes]) -> Iterator[tuple[list[bytes], bytes]]:
    """The digests of each text's chunks, and its bytes, with where they end in `ends`."""
    texts = [v.as_buffer() if v.is_valid else b"" for v in column.cast(pa.large_binary())]
    sizes = np.array([len(t) if isinstance(t, bytes) else t.size for t in texts], np.int64)
    i = 0
    while i < len(texts):  # some MB at a time
        j, size = i, 0
        while j < len(texts) and (j == i or size + sizes[j] <= 4_000_000):
            size += sizes[j]
            j += 1
        data = b"".join(texts[i:j])
        offsets = np.concatenate([[0], np.cumsum(sizes[i:j])])
        for start, ends in zip(offsets[:-1].tolist(), boundaries(np.frombuffer(data, np.uint8), offsets), strict=True):
            own = []
            for end in ends:
                own.append((digest(data[start:end]), data[start:end]))
                start = end
            yield own
        i = j


def recipes(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """(doc_id, text_sha256, recipe: array of chunk digests)."""
    schema = "doc_id " + dict(docs.dtypes)["doc_id"] + ", text_sha256 string, recipe array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[d for d, _ in own] for own in _chunks(batch.column(2), digest)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.binary()))], ["doc_id", "text_sha256", "recipe"])
            del batch, ids
        release_memory()

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), text.alias("text")).mapInArrow(run, schema)


def distinct_chunks(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """(digest, bytes) of each distinct chunk; repeats within a batch and then within a task are dropped before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {(d, c) for own in _chunks(batch.column(0), digest) for d, c in own}
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in seen], pa.binary()), pa.array([c for _, c in seen], pa.binary())], ["digest", "bytes"])
            del batch, seen
        release_memory()

    return docs.select("text").mapInArrow(run, "digest binary, bytes binary").distinct()


def _verified(docs: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """recipes() whose digests are verified identifiers: where chunks of one digest differ, the identifier has the chunk itself too."""
    made = recipes(docs, digest)
    clashes = distinct_chunks(docs, digest).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    if clashes.isEmpty():
        return made
    clashes = cut(clashes)
    schema = "doc_id " + dict(docs.dtypes)["doc_id"] + ", text_sha256 string, pos int, digest binary, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, p, d, c) for i, own in enumerate(_chunks(batch.column(2), digest)) for p, (d, c) in enumerate(own)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], ["doc_id", "text_sha256", "pos", "digest", "bytes"])

    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), text.alias("text")).mapInArrow(run, schema)
    # only for digests that clash does an identifier grow by its bytes; digests have one length, so that identifiers stay apart
    own = each.join(clashes.withColumn("clash", F.lit(True)), "digest", "left").select("doc_id", "text_sha256", "pos", F.when(F.col("clash"), F.concat("digest", "bytes")).otherwise(F.col("digest")).alias("id"))
    longer = own.groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("pos", "id"))).alias("r")).select("doc_id", "text_sha256", F.col("r.id").alias("verified"))
    return made.join(longer, made["doc_id"].eqNullSafe(longer["doc_id"]) & (made["text_sha256"] == longer["text_sha256"]), "left").select(made["doc_id"], made["text_sha256"], F.coalesce("verified", "recipe").alias("recipe"))


def groups(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, copies) for every row of docs; copies: rows that agree in text and doc_id."""
    found = _verified(docs, digest)
    # rows that agree in text and doc_id are interchangeable: they are counted, and told apart again at the end
    pairs = found.groupBy("recipe", "doc_id", "text_sha256").agg(F.count("*").alias("copies"))
    best = pairs.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    # nothing is written in between: both sides read one exchange of pairs. The hash makes another key than that of best's groups, so that
    # both sides of the join are plain exchanges, of which Spark splits a part that one recipe fills
    h = F.xxhash64("recipe")
    each = pairs.withColumn("h", h).join(best.withColumn("h", h), ["recipe", "h"])
    numbered = each.select("doc_id", "keep_id", "group_size", "text_sha256", "copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("i"))
    return numbered.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "text_sha256", "copies")


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs with a (doc_id, text_sha256) of kept; where kept has copies > 1, one of such rows. Columns of docs."""
    key = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    named = kept.select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha"), F.col("copies").alias("__kept_copies"))
    same = docs["doc_id"].eqNullSafe(named["__kept_id"]) & (key == named["__kept_sha"])
    single = docs.join(named.filter("__kept_copies = 1"), same, "left_semi")
    return single.unionByName(docs.join(named.filter("__kept_copies > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with the columns of docs."""
    return keep_rows(docs, cut(groups(docs).filter("kept")))
