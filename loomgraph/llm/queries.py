"""The registered queries of this subpackage and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import chat, common, decontaminate, encode, exact_dedup, html, near_dedup, quality, shards, token_counts, toxicity


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_exact_duplicates(common.table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), strict=False)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(common.table(spark, sf_dir, "conversations"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.token_shards(common.table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.find_toxic(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_near_duplicates(common.table(spark, sf_dir, "documents"))


def op8_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_documents(common.table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute_tokens(common.table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_decontaminate, op3_chat_format, op4_token_shards, op5_quality, op6_toxicity, op7_simhash_near_dedup, op8_bpe_encode, op9_token_counts, op10_html_extract)}

ORACLES = {
    "op1_exact_dedup": """
        SELECT doc_id,
               CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id,
               CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS copies,
               text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS keep
        FROM documents""",
    "op3_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   regexp_matches(coalesce(text, ''), '<\\*\|') OR regexp_matches(coalesce(role, ''), '<\\*\||\n|\\') AS hit
            FROM conversations),
        shown AS (
            SELECT conv_id, turn, role, text, hit,
                   CASE WHEN hit THEN regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') ELSE role END AS r,
                   CASE WHEN hit THEN regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') ELSE text END AS x
            FROM turns)
        SELECT conv_id, string_agg('<|im_start|>' || r || chr(10) || x || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
               count(*) AS n_turns, count(*) FILTER (WHERE hit) AS n_escaped, true AS identical
        FROM shown GROUP BY conv_id""",
}
