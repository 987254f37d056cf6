"""The pipeline's stages against plain Python, each on the rows that the one before it kept."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from framelake.llm import langid, mixing
from framelake.llm.queries import tokenizer_path
from tests.llm.test_operators import brute_fingerprint, forward_backward, root_components, words

SF = "/root/testdata/sf0.001"


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "encode"]


def brute_language(rows, model):
    kept = []
    for r in rows:
        own = [w for w in langid.WORDS.findall((r["text"] or "").lower()) if any(map(str.isalpha, w))]
        if not own:
            continue
        means = forward_backward(langid.emissions(model.weights, own).astype(float), model.trans).mean(0)
        if means.max() >= corpus_pipeline.LEAST_SCORE:
            kept.append(r)
    return kept


def brute_exact(rows):
    best = {}
    for r in rows:
        if (r["text"] or "") not in best or r["doc_id"] > best[r["text"] or ""]["doc_id"]:
            best[r["text"] or ""] = r
    return list(best.values())


def brute_near(rows):
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    nodes = sorted(set(fps.values()))
    comp = root_components(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if (a ^ b).bit_count() <= 2])
    least = {}
    for d, f in fps.items():
        least[comp[f]] = min(least.get(comp[f], d), d)
    return [r for r in rows if least[comp[fps[r["doc_id"]]]] == r["doc_id"]]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """The rows after each stage, over a table with junk, copies, near copies, repeated rows and further columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, None, "en", "src0", 0), (9002, "123 456 !!", "de", "src1", 0), (9003, docs.first()["text"], "en", "src2", 0), (9004, docs.first()["text"] + " end", "en", None, 0), (9004, docs.first()["text"] + " end", "en", None, 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    folder, out = tmp_path_factory.mktemp("stages"), [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        docs = stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == before
        docs.write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs.collect())
    return out


def as_count(rows):
    return Counter(tuple(r) for r in rows)


def test_language(spark, staged):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.unionByName(spark.createDataFrame([tuple(r) for r in staged[0][-5:]], docs.schema)))
    assert as_count(staged[1]) == as_count(brute_language(staged[0], model))
    assert {9001, 9002} & {r["doc_id"] for r in staged[1]} == set()


def test_language_keeps_text_of_many_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = {}
    for r in docs.filter("n_chars > 2000").orderBy("doc_id").collect():
        long.setdefault(r["lang"], langid.WORDS.findall(r["text"].lower()))
    assert len(long) >= 4
    mixed = " ".join(" ".join(long[lang][i : i + 20]) for i in range(0, 80, 20) for lang in sorted(long))
    junk = " ".join("qxj zzv wkp vvq".split() * 40)
    extra = spark.createDataFrame([(9100, mixed, None, "src0", 0), (9101, junk, None, "src0", 0)], docs.schema)
    model = langid.fit(docs)
    score, sure = extra.select(langid.predict(extra, model).alias("r")).select("r.score", "r.sure").first()
    assert score < corpus_pipeline.LEAST_SCORE and sure >= corpus_pipeline.LEAST_SURE
    assert 9100 in {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(extra), SF).collect()}


def test_exact(staged):
    assert as_count(staged[2]) == as_count(brute_exact(staged[1]))


def test_near(staged):
    assert as_count(staged[3]) == as_count(brute_near(staged[2]))


def test_mix(staged):
    copies = as_count(staged[4])
    assert set(copies) <= set(as_count(staged[3])) and max(copies.values()) <= 3
    by, got = {}, Counter()
    for r in staged[3]:
        by.setdefault(r["source"], []).append(len(words(r["text"])))
    for r in staged[4]:
        got[r["source"]] += len(words(r["text"]))
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    targets = mixing.share_targets([sum(by[s]) for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))], 3)
    for s, target in zip(sources, targets, strict=True):
        assert abs(got[s] - target) <= max(by[s])


def test_encode(staged):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in staged[4]:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert as_count(staged[5]) == want


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and np.all([r["n_tokens"] > 0 for r in rows])


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
