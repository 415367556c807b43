"""The corpus pipeline: filter, deduplicate, redact, mix and encode documents, one operator a stage.

Each stage takes what the one before it kept, written as Parquet and read
again, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import chunks, mixing, neardup, quality, secrets
from geoloom.llm.common import read_table, written
from geoloom.llm.queries import trusted_ids


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the score reject go."""
    weights = quality.bucket_weights(docs, trusted_ids(spark, sf_dir))
    labels = read_table(spark, sf_dir, "labels")
    columns = list(dict.fromkeys([*docs.columns, "score", "base_failed"]))
    return quality.judge_by_labels(docs, weights, labels, columns).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are cut out of the texts."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as token ids, with the text that they decode to."""
    return chunks.encode_table(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
    ("bpe_encoding", bpe_encoding),
]

#: Sampling by hash odds, MinHash and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; the last one's rows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
