"""Corpus pipeline over ``documents``: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from httploom.llm import base, bpe, decontaminate, lines, near, quality
from httploom.session import scratch

SIMILAR = {"shingle": 5, "similar": 0.8}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the weakly supervised rules judge good."""
    verdict, _ = base.free_names(docs, "_quality", "_quality_raw")
    return quality.judged(docs, into=verdict).where(F.col(f"{verdict}.kept")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of templates that recur across documents; every document stays, ``n_chars`` follows its text."""
    (into,) = base.free_names(docs, "_lines")
    stripped = lines.drop_recurring(docs, into=into)
    new = {"text": F.col(f"{into}.text"), "n_chars": F.length(f"{into}.text").cast("long")}
    return stripped.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group."""
    return near.keep_one(docs, **SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove documents that hold a window of a benchmark item."""
    (into,) = base.free_names(docs, "_found")
    found = decontaminate.marked(docs, base.table(spark, sf_dir, "benchmark"), with_matches=False, into=into)
    return found.where(F.col(f"{into}.n_hit") == 0).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)``: packed ids of each text, and what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("byte-level BPE", tokenize),
]

# Posterior probabilities, template trees and merge replay have no SQL form; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = base.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
