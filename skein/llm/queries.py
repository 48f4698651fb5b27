"""Registered queries of this package: name → callable ``(spark, sf_dir) -> DataFrame``.

Every query reads its whole tables and returns its operator's full result.
``ORACLE_SQL`` has the DuckDB SQL where SQL can express the operator on whole
tables; the others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import (
    ann_forest,
    bpe_codec,
    exact_topk,
    jaccard_join,
    line_dedup,
    mixing,
    periodic_runs,
    quality,
    ranked_search,
    secrets,
    token_counts,
    toxicity,
    warc_audit,
)

QueryFn = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1_query(_table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.op2_query(_table(spark, sf_dir, "embeddings"))


def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_audit.op3_query(_table(spark, sf_dir, "pages"))


def op4_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.op4_query(_table(spark, sf_dir, "embeddings"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op5_query(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op6_query(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op7_query(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.op9_query(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op10_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.op11_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.op12_query(_table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op13_query(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, QueryFn] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_exact_topk,
        op3_warc_audit,
        op4_ann_forest,
        op5_secret_scan,
        op6_token_counts,
        op7_jaccard_join,
        op8_toxicity,
        op9_bpe_codec,
        op10_quality,
        op11_ranked_search,
        op12_periodic_runs,
        op13_line_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_warc_audit": warc_audit.OP3_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
    "op13_line_dedup": line_dedup.OP13_SQL,
}
