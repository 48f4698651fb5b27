"""Collection planning and id preparation (PIPE-4, PIPE-5; JN-7, JN-9, SC-12..14).

The network fetch itself is out of scope; these plans decide *what* to fetch
and prepare ids from landed files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.constants import DEFAULT_MIN_COMMENT_COUNT, DEFAULT_SEED
from skein.functions.scalar import compact_date, date_sequence, date_window
from skein.operators import relational as rel


def collection_plan(
    spark: SparkSession,
    years: Sequence[int],
    start_mmdd: str,
    end_mmdd: str,
    runs: int = 1,
    done: DataFrame | None = None,
) -> DataFrame:
    """PIPE-5: (year, day, api_date, run_index) for every day of every year's window and
    every run, minus runs already present in ``done`` (year, day, run_index)."""
    windows = [(y, *date_window(y, start_mmdd, end_mmdd)) for y in years]  # validates each window
    spec = spark.createDataFrame(windows, "year INT, start STRING, end STRING")
    days = spec.select(
        "year", F.explode(date_sequence(F.to_date("start"), F.to_date("end"))).alias("day")
    )
    plan = days.select("year", "day", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run_index"))
    plan = plan.withColumn("api_date", compact_date("day"))
    if done is not None:
        plan = plan.join(done.select("year", "day", "run_index"), ["year", "day", "run_index"], "left_anti")
    return plan


def prepare_child_ids(
    parents: DataFrame,
    min_count: int = DEFAULT_MIN_COMMENT_COUNT,
    shuffle: bool = False,
    seed: int = DEFAULT_SEED,
) -> tuple[DataFrame, DataFrame]:
    """PIPE-4: dedupe parents (keep first in file order), keep eligible ones, distinct ids
    (optionally in seeded shuffle order) and a (measure, value) summary."""
    rel.require_columns(parents, ["id", "comment_count"], "parents")
    unique = rel.dedupe_keep_first(parents, ["id"], rel.file_order(parents))
    eligible = rel.eligible_parents(unique, "comment_count", min_count)
    ids = rel.distinct_ids(eligible.select(F.col("id").alias("video_id")), "video_id")
    if shuffle:
        ids = rel.dense_index(ids, [rel.seeded_order_key("video_id", seed), F.col("video_id")], "shuffle_pos")
    summary = collection_summary(parents, unique, eligible, ids, min_count)
    return ids, summary


def collection_summary(raw: DataFrame, unique: DataFrame, eligible: DataFrame, ids: DataFrame, min_count: int) -> DataFrame:
    """AG-13: (measure, value) for the id preparation; ``source_files`` only when known."""
    aggs = [F.count(F.lit(1)).alias("video_rows"), F.count_distinct("id").alias("unique_video_ids")]
    if "source_file" in raw.columns:
        aggs.append(F.count_distinct("source_file").alias("source_files"))
    a = raw.agg(*aggs)
    b = unique.agg(F.count(F.lit(1)).alias("videos_after_dedup"))
    c = eligible.agg(F.count(F.lit(1)).alias(f"videos_comment_count_ge_{min_count}"))
    d = ids.agg(F.count(F.lit(1)).alias("video_ids_for_comments"))
    from skein.plans.preprocess import measures_table

    parts = [a.select("video_rows", "unique_video_ids"), b, c, d]
    if "source_file" in raw.columns:
        parts.append(a.select("source_files"))
    return measures_table(parts)
