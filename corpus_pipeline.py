"""Corpus pipeline: quality, near duplicates, secrets, source mixture, tokens.

``STAGES`` lists (name, function) in order; each function takes (spark, docs,
sf_dir) and returns the documents that go on.  ``run`` writes every stage as
Parquet to the shared checkpoint folder and rereads it as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe_codec, jaccard_join, mixing, quality, secrets
from skein.llm.common import prepare, write_shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (operator 10)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    return quality.accepted(docs, model).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (operator 7).

    Five-word shingles, Jaccard similarity of 0.8 or more, groups by reachability.
    """
    return jaccard_join.representatives(docs).select(*COLUMNS)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret (operator 5)."""
    return secrets.redacted(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the raked source, language and topic targets (operator 1)."""
    return mixing.mixed(docs, mixing.POWERS, mixing.BUDGET).where("kept").select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded text (operator 9)."""
    return bpe_codec.encode(docs, keep=("source", "lang"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", remove_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]
ORACLE_SQL: str | None = None  # no SQL for the trained classifier; tests/llm check every stage by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    prepare(spark)
    sf_dir = sf_dir.rstrip("/")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
