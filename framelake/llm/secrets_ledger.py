"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every text is addressed by its SHA-256 (its blob). A pair of blob and rule version is scanned once:
pairs that the ledger holds are taken from it, each other blob is scanned once whatever number of
paths hold it, and the findings are joined back to all paths.

Ledger keeps both as tables in a folder: commit() records a version of the corpus, scans what no
version before it had scanned by these rules, and reports the findings of all its paths out of the
tables.

Spans are code points, end exclusive. A match's start is the sum of the lengths of the gaps and the
matches before it, both of which the regular expression gives in one pass each.

Defined cases: a null text is the empty text; repeated rows and paths of equal text share findings;
an empty table gives an empty result; other columns are ignored. Two versions of a kind, and rules
beyond the base ones, add spans; base_sha256 is of the base kinds alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import cut


@dataclass(frozen=True)
class Rule:
    """group: the group whose length counts; least: code points it must have."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: In the order in which spans of one start are listed. The runs of access and hex can't overlap a
#: longer one, so that the least length may stand in their patterns; that of assign can't, since a
#: match that is too short still uses up its characters.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
BASE = tuple(r.kind for r in RULES)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rank, kind, version, start, stop) of blobs (blob, text, todo: the ranks of the rules to apply)."""

    def hits(rank: int, rule: Rule) -> Column:
        gaps = F.split("text", rule.pattern, -1)
        zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("gap"), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("match"), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)).alias("value"))
        lengths = F.transform(zipped, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("pos"), F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("match"), F.length(x["value"]).alias("value")))
        return F.when(F.array_contains("todo", rank) & F.col("text").rlike(rule.pattern), lengths).otherwise(F.array())

    lengths = blobs.select("blob", F.explode(F.concat(*[hits(i, r) for i, r in enumerate(rules)])).alias("hit")).select("blob", "hit.*")
    stop = F.sum(F.col("gap") + F.col("match")).over(Window.partitionBy("blob", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    of_rule = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rank") + 1)
    placed = lengths.withColumn("stop", stop).filter(F.col("value") >= of_rule([r.least for r in rules]))
    return placed.select("blob", "rank", of_rule([r.kind for r in rules]).alias("kind"), of_rule([r.version for r in rules]).alias("version"), (F.col("stop") - F.col("match")).alias("start"), "stop")


def wanted(findings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Those of the rules, at their versions."""
    own = F.lit(False)
    for rule in rules:
        own = own | ((F.col("kind") == rule.kind) & (F.col("version") == rule.version))
    return findings.filter(own)


def unseen(docs: DataFrame, rules: tuple[Rule, ...], seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Paths (doc_id, text, blob), and the blobs (blob, text, todo) that some rule hasn't scanned."""
    text = F.coalesce(F.col("text"), F.lit(""))
    paths = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("blob"))
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"))  # partial first: copies are dropped before the exchange
    every = F.array(*[F.lit(i) for i in range(len(rules))])
    if seen is None:
        return paths, blobs.withColumn("todo", every)
    ranks: Column = F.lit(None).cast("int")
    for i, rule in enumerate(rules):
        ranks = F.when((F.col("kind") == rule.kind) & (F.col("version") == rule.version), F.lit(i)).otherwise(ranks)
    done = seen.select("blob", ranks.alias("rank")).filter("rank is not null").groupBy("blob").agg(F.collect_set("rank").alias("done"))
    return paths, blobs.join(done, "blob", "left").select("blob", "text", F.array_except(every, F.coalesce("done", F.array().cast("array<int>"))).alias("todo")).filter(F.size("todo") > 0)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, seen: DataFrame | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths with their findings, findings of all blobs met, ledger rows to add), without tables of its own.

    seen: the ledger (blob, kind, version) of pairs that were scanned; known: their findings, as the
    second result of the scans before.
    """
    paths, todo = unseen(docs, rules, seen)
    findings = scan_blobs(todo, rules)
    added = todo.select("blob", F.explode("todo").alias("rank")).select("blob", F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1).alias("kind"), F.element_at(F.array(*[F.lit(r.version) for r in rules]), F.col("rank") + 1).alias("version"))
    if known is not None:
        findings = findings.unionByName(wanted(known, rules).join(paths.select("blob").distinct(), "blob", "left_semi"))
    return report(paths, findings, rules), findings, added


def report(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_<kind> of each rule, base_sha256, spans, blob) of paths (doc_id, blob)."""
    kinds = list(dict.fromkeys(r.kind for r in rules))
    order: Column = F.lit(len(kinds))
    for i, kind in enumerate(kinds):
        order = F.when(F.col("kind") == kind, F.lit(i)).otherwise(order)
    listed = F.array_sort(F.collect_set(F.struct("start", order.alias("rank"), "kind", "stop")))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    by_blob = findings.groupBy("blob").agg(listed.alias("found"))
    of_kind = lambda kind: F.filter("found", lambda x: x["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in kinds]
    by_blob = cut(by_blob.select("blob", *counts, joined(F.col("found")).alias("spans"), joined(F.filter("found", lambda x: x["kind"].isin(*BASE))).alias("base")))  # Spark can then split a blob that fills a partition of the paths
    every = paths.select("doc_id", "blob").join(by_blob, "blob", "left")
    return every.select("doc_id", *[F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in kinds], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "blob")


class Ledger:
    """Tables in a folder that all executors share: findings (blob, rank, kind, version, start, stop) and scanned (blob, kind, version).

    A commit appends the findings first and the pairs last, so that a commit that broke off is scanned again; findings are
    read as a set.
    """

    FINDINGS = "blob string, rank int, kind string, version int, start long, stop long"
    SCANNED = "blob string, kind string, version int"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.findings_at, self.scanned_at = spark, f"{folder}/findings", f"{folder}/scanned"
        spark.createDataFrame([], self.FINDINGS).write.mode("append").parquet(self.findings_at)
        spark.createDataFrame([], self.SCANNED).write.mode("append").parquet(self.scanned_at)

    @property
    def findings(self) -> DataFrame:
        return self.spark.read.schema(self.FINDINGS).parquet(self.findings_at)

    @property
    def scanned(self) -> DataFrame:
        return self.spark.read.schema(self.SCANNED).parquet(self.scanned_at)

    def commit(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """report() of docs; blobs that an earlier commit scanned by these rule versions aren't looked at again."""
        paths, todo = unseen(docs, rules, self.scanned)
        scan_blobs(todo, rules).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in self.FINDINGS.split(", ")]).write.mode("append").parquet(self.findings_at)
        pairs = self.spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
        scanned = self.scanned
        met = paths.select("blob").distinct().join(F.broadcast(pairs)).join(scanned, ["blob", "kind", "version"], "left_anti")
        met.write.mode("append").parquet(self.scanned_at)
        return report(paths, wanted(self.findings, rules), rules)
