"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloomlm, chat, exact, language, mixing, pieces, repeats, shingles, spots, toxicity
from .session import table

#: The vocabulary file of op2; a parameter of pieces.encode.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), MODEL)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.label(docs, language.fit(docs)).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_key")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomlm.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_repeats, op2_pieces, op3_exact_dedup, op4_language, op5_shingle_join, op6_spots, op7_toxicity, op8_mixing, op9_chat, op10_bloom_lm)}

ORACLES = {
    "op3_exact_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as x from documents)
        select doc_id, min(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
               doc_id = min(doc_id) over (partition by x) as kept, sha256(x) as text_sha256
        from t""",
    "op9_chat": r"""
        with t as (
            select conv_id, turn // 256 as part, turn, coalesce(role, 'unknown') as role,
                   replace(replace(coalesce(text, ''), '\', '\\'), '<|', '<\|') || '<|end|>' || chr(10) as body
            from conversations),
        s as (select distinct conv_id, role as speaker from t where role <> 'system'),
        v as (
            select t.*, speaker,
                   case when role = speaker then '<|assistant|>' when role = 'system' then '<|system|>' else '<|user:' || replace(replace(role, '\', '\\'), '<|', '<\|') || '|>' end || chr(10) as head
            from t join s using (conv_id)),
        o as (select *, sum(length(head) + length(body)) over (partition by conv_id, speaker order by part, turn, role, body) as e from v)
        select conv_id, speaker, part, count(*) as n_turns, count(*) filter (where role = speaker) as n_own,
               string_agg(head || body, '' order by turn, role, body) as rendered, cast(min(e - length(head) - length(body)) as bigint) as "begin",
               cast(sum(length(head) + length(body)) as bigint) as n_chars,
               coalesce(string_agg((e - length(body)) || '-' || e, ',' order by turn, role, body) filter (where role = speaker), '') as mask
        from o group by conv_id, speaker, part""",
}
