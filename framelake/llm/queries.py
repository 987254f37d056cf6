"""The queries of the training-data operators, on whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import bpe, chat, exact_dedup, langid, licenses, mixing, near_embed, secrets_ledger, sharding, simhash
from framelake.llm.common import ensure_checkpoint_dir, read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_corpus(read(spark, sf_dir, "documents"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op5_near_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embed.groups(read(spark, sf_dir, "embeddings"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of its own, written beside the corpus; the report is read out of it."""
    ledger = secrets_ledger.Ledger(spark, f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4()}")
    return ledger.commit(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(read(spark, sf_dir, "conversations"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix, op2_license, op3_shard, op4_langid, op5_near_embed, op6_exact_dedup, op7_simhash, op8_secrets, op9_chat, op10_bpe)
}

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
    select doc_id, {rank} as r, '{kind}' as kind, m, v, sum(length(g) + length(m)) over (partition by doc_id order by i) as stop
    from (select doc_id, unnest(range(len(ms))) as i, unnest(ms) as m, unnest(vs) as v, unnest(gs[:len(ms)]) as g
          from (select doc_id, regexp_extract_all(t, '{pattern}') as ms, regexp_extract_all(t, '{pattern}', {group}) as vs, string_split_regex(t, '{pattern}') as gs from d where regexp_matches(t, '{pattern}')))
    qualify length(v) >= {least}"""


ORACLE: dict[str, str] = {
    "op6_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
    "op8_secrets": f"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
        found as ({_spans(0, "assign", _ASSIGN, 2, 6)} union all {_spans(1, "access", "AKIA[A-Z0-9]+", 0, 20)} union all {_spans(2, "hex", "[0-9a-f]{24,}", 0, 24)}),
        by_doc as (select doc_id, count(*) filter (r = 0) as a, count(*) filter (r = 1) as b, count(*) filter (r = 2) as c,
                   string_agg(kind || ':' || (stop - length(m))::bigint || ':' || stop::bigint, ',' order by stop - length(m), r) as s from found group by doc_id)
        select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex, sha256(coalesce(s, '')) as base_sha256, coalesce(s, '') as spans
        from d left join by_doc using (doc_id)""",
    "op9_chat": """
        with t as (select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations),
        v as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
        s as (select t.*, perspective, case when speaker = 'system' then speaker when speaker = perspective then 'assistant' else 'user' end as role from t join v on t.conv_id is not distinct from v.conv_id),
        h as (select *, case when role = 'user' then speaker end as name, '<|im_start|>' || role || case when role = 'user' then ' name=' || speaker else '' end || chr(10) as head from s),
        g as (select *, head || text || '<|im_end|>' || chr(10) as segment from h),
        p as (select *, row_number() over w - 1 as seq, sum(length(segment)) over (w rows unbounded preceding)::bigint as stop from g window w as (partition by conv_id, perspective order by turn nulls first, speaker, text))
        select conv_id, perspective, seq, turn, role, name, segment, (stop - length(segment))::bigint as start, stop,
               case when role = 'assistant' then (stop - length(segment) + length(head))::bigint end as mask_start, case when role = 'assistant' then stop - 1 end as mask_stop from p""",
}
