"""The corpus pipeline: five of the training-data operators over documents, one after another.

Defined cases. Language: null, empty and letterless texts go, repeated rows are judged alike. Exact dedup: one row of each text
stays, also of repeated rows. Near dedup: repeated rows of the document that stays all stay. Mix: rows that agree in doc_id
and size share the copies that are planned for them, whole. Encoding: a row a copy. Columns besides doc_id, text, lang, source are carried
through, up to the last stage; an empty table stays empty.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm import bpe, exact_dedup, langid, mixing, simhash
from framelake.llm.common import cut, ensure_checkpoint_dir, remove
from framelake.llm.queries import tokenizer_path

#: Documents whose language has less than this mean posterior are in none of the languages, unless they are in several:
#: their words' own greatest posteriors then have this mean.
LEAST_SCORE, LEAST_SURE = 0.4, 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no letter, and what is in no language that was learned."""
    said = langid.predict(docs, langid.fit(docs))
    return docs.withColumn("__said", said).filter((F.col("__said.lang_pred") != langid.UNKNOWN) & ((F.col("__said.score") >= LEAST_SCORE) | (F.col("__said.sure") >= LEAST_SURE))).select(*[docs[c] for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest doc_id stays."""
    return simhash.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    plan = cut(mixing.mix(docs).groupBy("doc_id", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")))
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    named = plan.select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("copies").alias("__copies"), F.col("rows").alias("__rows"))
    joined = docs.withColumn("__words", size).join(named.filter("__copies > 0"), docs["doc_id"].eqNullSafe(named["__id"]) & (F.col("__words") == named["__size"]))
    # of rows that agree in doc_id and size, each takes its whole share and the first ones the rest; elsewhere rows is 1
    several = joined.filter("__rows > 1")
    nth = F.row_number().over(Window.partitionBy("__id", "__size").orderBy(*[docs[c] for c in docs.columns if c != "text"], F.xxhash64(docs["text"])))
    own = F.floor(F.col("__copies") / F.col("__rows")) + F.when(nth <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    shared = joined.filter("__rows = 1").withColumn("__n", F.col("__copies")).unionAll(several.withColumn("__n", own))
    return shared.filter("__n > 0").select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__i")).drop("__i")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what was encoded and decoded."""
    return bpe.encode_digests(docs, tokenizer_path())


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("encode", encode)]

#: SQL can express neither the language model nor the mix; tests/llm hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(ensure_checkpoint_dir(spark), f"pipeline-{uuid.uuid4()}")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = os.path.join(folder, f"{k}-{name}")
            docs.write.parquet(path)
            if k:
                remove(spark, os.path.join(folder, f"{k - 1}-{STAGES[k - 1][0]}"))
            docs = spark.read.parquet(path)
    return docs
