"""A training-data pipeline: five stages of the ``llm`` operators over documents.

A stage takes what its predecessor kept, with all of its columns and rows, and returns a DataFrame; all but the last
return the columns of documents.  Null texts, empty tables and extra columns pass as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import common, decontaminate, encode, exact_dedup, near_dedup, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text isn't toxic (operator 6, fitted on ``labels``); a null text stays."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def remove_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the least id (operator 1); null texts stay."""
    return exact_dedup.drop_exact_duplicates(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id (operator 7); texts without a word stay."""
    return near_dedup.drop_near_duplicates(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark`` (operator 2); null texts stay."""
    return decontaminate.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"), strict=False)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, n_bytes, round_trip) of each document (operator 8)."""
    return encode.encode_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_exact_duplicates),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_leaks),
    ("bpe_encode", encode_texts),
]
#: SQL can't express the stages; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet to the shared folder and read again as the next one's."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
