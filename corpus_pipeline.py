"""The corpus pipeline: quality, language, near copies, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from courtflow.llm import bpe, langid, mixing, quality, simhash
from courtflow.llm.shared import stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose posterior quality is under one half."""
    return quality.kept_rows(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, and those less than half in the one found."""
    return langid.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies (five-word shingles, similarity 0.8)."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some more than once, so that sources come near their targets."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document of the mix, repeats included."""
    return bpe.encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: SQL can't express the fingerprints and the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stash(docs, f"pipeline-{at}")
    return docs
