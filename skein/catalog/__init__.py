"""Registered queries: name → Spark callable ``(spark, sf_dir) -> DataFrame`` and,
where SQL can express it, the equivalent DuckDB SQL over the driver's tables.

Every query reads the given tables (or data Spark derives from them) in full.

Modules (fixtures.py maps the driver's tables onto parents/children):

* text_queries        — SC-1..8, TXT-1 (flagship ``log_odds_keywords``), FLT-9, AG-2
* relational_queries  — AG-1, WN-4, JN-1..9, SC-18/20, WN-7, SO-2, SRC-2/9, PRJ-1/2, PIPE-5
* stats_queries       — AG-8/9, STAT-1..6, SC-17
* analysis_queries    — TS-1..3, SO-1, AG-13..15, SET-4, PIPE-6, DQ-3..7, SNK-7
* model_queries       — TXT-3/4, ML-1..11, SC-15/16, DQ-8
* stream_queries      — STR-1..5, SRC-1/3 through real files
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Decorator: register a query and its oracle SQL (``None`` = rows-only check)."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name!r}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return wrap


def _load() -> None:
    # Importing the modules fills the registries.
    from skein.catalog import (  # noqa: F401
        analysis_queries,
        model_queries,
        relational_queries,
        stats_queries,
        stream_queries,
        text_queries,
    )


_load()
