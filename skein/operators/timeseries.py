"""Daily series and topic shares (TS-1 … TS-3), top parents (SO-1 + JN-5)."""

from __future__ import annotations

import calendar
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.constants import DEFAULT_TOP_PARENTS, SERIES_WINDOW, SERIES_YEARS, TOP_PARENT_COLUMNS
from skein.functions.scalar import epoch_to_ts, to_number
from skein.functions.text import comment_text_key
from skein.operators.relational import valid_topic
from skein.session import cut_lineage


def _epoch_year_range(col: str, first_year: int, last_year: int):
    """FLT-7 on epoch seconds as a range predicate (pushes down to the Parquet scan)."""
    lo = calendar.timegm((first_year, 1, 1, 0, 0, 0))
    hi = calendar.timegm((last_year + 1, 1, 1, 0, 0, 0))
    return (F.col(col) >= F.lit(lo)) & (F.col(col) < F.lit(hi))


def _spine(spark, years: Sequence[int], window) -> DataFrame:
    (sm, sd), (em, ed) = window
    rows = [(y, f"{y:04d}-{sm:02d}-{sd:02d}", f"{y:04d}-{em:02d}-{ed:02d}") for y in years]
    spec = spark.createDataFrame(rows, "year INT, start STRING, end STRING")
    return spec.select(
        "year", F.explode(F.sequence(F.to_date("start"), F.to_date("end"), F.expr("INTERVAL 1 DAY"))).alias("date")
    )


def daily_activity(
    parents: DataFrame,
    children: DataFrame,
    years: Sequence[int] = SERIES_YEARS,
    window=SERIES_WINDOW,
) -> DataFrame:
    """TS-1: per year and UTC day of the window: distinct posts, distinct authors, distinct
    children.  A child counts in its **parent's** year and only inside the window
    (half-open at the end); days without activity are zero; ``username`` is optional.
    AG-5 distinct counts per day; FLT-6 half-open range; JN-11 spine fill.
    """
    spark = parents.sparkSession
    spine = _spine(spark, years, window)
    bounds = spine.groupBy("year").agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    has_user = "username" in parents.columns
    p = parents.select(
        F.col("id"),
        (F.col("username") if has_user else F.lit(None).cast("string")).alias("username"),
        epoch_to_ts("create_time").alias("ts"),
    ).withColumn("year", F.year("ts"))
    posts = (
        p.filter(F.col("year").isin(list(years)))
        .groupBy("year", F.to_date("ts").alias("date"))
        .agg(F.count_distinct("id").alias("unique_posts"), F.count_distinct("username").alias("unique_users_posts"))
    )
    parent_year = p.filter(F.col("year").isin(list(years))).select(F.col("id").alias("video_id"), "year")
    # children outside all windows never reach the join
    (sm, sd), (em, ed) = window
    first = calendar.timegm((min(years), sm, sd, 0, 0, 0))
    last = calendar.timegm((max(years), em, ed, 0, 0, 0)) + 86_400
    at = to_number("create_time")
    inside = children.filter((at >= first) & (at < last))
    c = inside.select("id", "video_id", epoch_to_ts("create_time").alias("ts")).join(parent_year, "video_id")  # JN-4
    c = c.join(F.broadcast(bounds), "year")  # years × 2 dates
    c = c.filter((F.col("ts") >= F.col("d0").cast("timestamp")) & (F.col("ts") < F.date_add("d1", 1).cast("timestamp")))
    comments = c.groupBy("year", F.to_date("ts").alias("date")).agg(F.count_distinct("id").alias("comments"))
    out = spine.join(posts, ["year", "date"], "left").join(comments, ["year", "date"], "left")
    return out.select(
        "year",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.coalesce("unique_posts", F.lit(0)).cast("bigint").alias("unique_posts"),
        F.coalesce("unique_users_posts", F.lit(0)).cast("bigint").alias("unique_users_posts"),
        F.coalesce("comments", F.lit(0)).cast("bigint").alias("comments"),
    )


def topic_share_by_year(parents_with_topics: DataFrame) -> DataFrame:
    """TS-2: (year, topic_num, count, fraction of the year's valid-topic posts); all years kept.

    AG-4 counts per (year, topic); WN-1 share of the year's total."""
    v = parents_with_topics.filter(valid_topic("topic_id")).select(
        F.year(epoch_to_ts("create_time")).alias("year"), (F.col("topic_id") + 1).alias("topic_num")
    )
    counts = v.groupBy("year", "topic_num").agg(F.count(F.lit(1)).alias("count"))
    # window over the aggregated (year × topic) table, not over rows
    total = F.sum("count").over(Window.partitionBy("year"))
    return counts.withColumn("fraction", F.col("count") / total)


def topic_share_total(children_with_topics: DataFrame) -> DataFrame:
    """TS-3: (topic_num, count, fraction of all valid-topic children) — AG-4 counts, WN-2 share of the grand total."""
    v = children_with_topics.filter(valid_topic("topic_id")).select((F.col("topic_id") + 1).alias("topic_num"))
    counts = v.groupBy("topic_num").agg(F.count(F.lit(1)).alias("count"))
    # window over the aggregated table (one row per topic), not over rows
    return counts.withColumn("fraction", F.col("count") / F.sum("count").over(Window.partitionBy()))


def top_parents(
    parents: DataFrame,
    children: DataFrame,
    year: int,
    n: int = DEFAULT_TOP_PARENTS,
    text_col: str | None = None,
) -> DataFrame:
    """SO-1 + JN-5: the year's top-n parents by collected children, with raw and text-deduped
    counts (missing → 0); ties broken by id.  PRJ-6: ``processed_text`` else ``text``."""
    if text_col is None:
        text_col = "processed_text" if "processed_text" in children.columns else "text"
    numeric = dict(parents.dtypes).get("create_time") in ("bigint", "int", "double")
    p = parents.filter(_epoch_year_range("create_time", year, year)) if numeric else parents
    p = p.filter(F.year(epoch_to_ts("create_time")) == year)
    # only the year's children are counted, and only the chosen parents' texts are normalised
    own = children.join(p.select(F.col("id").alias("video_id")), "video_id", "left_semi")
    raw = own.groupBy(F.col("video_id").alias("id")).agg(F.count(F.lit(1)).alias("collected_comments_raw_unique"))
    top = p.join(raw, "id", "left").na.fill({"collected_comments_raw_unique": 0})
    top = cut_lineage(top.orderBy(F.col("collected_comments_raw_unique").desc(), F.col("id")).limit(n))
    chosen = F.broadcast(top.select(F.col("id").alias("video_id")))  # n rows
    dedup = (
        children.join(chosen, "video_id", "left_semi")
        .select("video_id", comment_text_key(text_col).alias("_k"))
        .dropDuplicates(["video_id", "_k"])
        .groupBy(F.col("video_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("collected_comments_text_dedup"))
    )
    out = top.join(dedup, "id", "left").na.fill({"collected_comments_text_dedup": 0})
    out = out.orderBy(F.col("collected_comments_raw_unique").desc(), F.col("id"))
    return out.select(*(c for c in TOP_PARENT_COLUMNS if c in out.columns))
