"""Physical-plan properties the scale design relies on (checked on executed AQE plans)."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from skein.operators import relational as rel
from skein.operators import scoring as scr
from skein.operators import timeseries as ts

SF = "/root/testdata/sf0.01"


def _plan(df) -> str:
    execution = df._jdf.queryExecution()
    execution.toRdd().count()  # the very execution whose plan is read, so the adaptive plan is the final one
    plan = execution.executedPlan().toString()
    assert "isFinalPlan=false" not in plan
    return plan


@pytest.fixture()
def large_tables(spark):
    """Plans as for tables beyond the broadcast threshold."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "200k")
    yield
    spark.conf.set(key, before)


def _rows_shuffled_on(df, column: str) -> bool:
    """Whether an exchange on ``column`` alone gets rows that are neither counts nor limits."""
    final = _plan(df).split("+- == Initial Plan ==")[0]
    lines = final.splitlines()
    for i, line in enumerate(lines):
        if re.search(rf"Exchange hashpartitioning\({column}#\w+, \d+\)", line):
            below = " ".join(lines[i + 1 : i + 3])
            if not re.search("HashAggregate|SortAggregate|WindowGroupLimit|ObjectHashAggregate", below):
                return True
    return False


def test_rows_never_meet_by_topic_or_year(spark, large_tables):
    from skein.catalog import QUERIES

    for name, column in [
        ("topic_inherit", "topic_id"), ("topic_share_total", "topic_id"), ("topic_share_by_year", "topic_id"),
        ("topic_metadata", "topic_id"), ("daily_activity", "year"), ("log_odds_keywords", "topic"), ("cluster_topics", "cluster"),
    ]:
        assert not _rows_shuffled_on(QUERIES[name](spark, SF), column), name


def test_cap_limits_map_side(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id")
    plan = _plan(rel.cap_per_parent(ev, "user_id", "event_id", 50, 42))
    assert "WindowGroupLimit" in plan and "Partial" in plan  # top-N cut before the shuffle


def test_dedupe_is_partial_aggregate(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = _plan(rel.dedupe_keep_first(li, ["l_orderkey", "l_linenumber"]))
    assert "partial_min_by" in plan  # map-side partial aggregation: ≤ 1 row per key per task
    assert "Window" not in plan


def test_keyword_top_n_limits_map_side(spark):
    from skein.catalog.text_queries import _lang_docs
    from skein.operators import keywords as kw

    terms, _ = kw.log_odds_keywords(_lang_docs(spark, SF), "topic", "topic_text", 10)
    plan = _plan(terms)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_tokenizer_has_no_lambdas(spark):
    from skein.catalog.text_queries import _lang_docs
    from skein.operators import keywords as kw

    plan = _plan(kw.term_counts(_lang_docs(spark, SF), "topic", "topic_text"))
    assert "regexp_extract_all" in plan and "lambdafunction" not in plan  # codegen'd regex only
    assert "size(" not in plan  # no inferred explode pre-filter re-evaluating the arrays


def test_lexicon_scores_without_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = _plan(scr.lexicon_sentiment(docs, "text", {"the": 1.0, "and": -1.0}))
    assert "ArrowEvalPython" in plan and "Exchange" not in plan and "Join" not in plan


def test_top_parents_normalises_only_the_chosen_texts(spark):
    from skein.catalog import fixtures as fx

    df = ts.top_parents(fx.parents(spark, SF).select("id", "username", "create_time"), fx.children(spark, SF), 1996, 50)
    plan = _plan(df)
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan  # texts meet the 50 ids first


def test_filters_reach_the_scan(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    df = li.filter(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")).select("l_orderkey")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in plan
