"""Analysis plans: prepare-data (PIPE-1 + AG-15), the analysis run (PIPE-10) and the
audit table (PIPE-7).

The nine intermediate tables share ancestors (deduped parents and children);
callers that write all of them should ``persist`` those first (SNK-8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.constants import (
    DEFAULT_MAX_CHILDREN_PER_PARENT,
    DEFAULT_SEED,
    PAPER_COMMENT_COUNT,
    PAPER_VIDEO_COUNT,
    TEST_METRICS,
)
from skein.functions.text import comment_text_key
from skein.operators import keywords as kw
from skein.operators import relational as rel
from skein.operators import stats as st
from skein.operators import timeseries as ts
from skein.operators.quality import assert_unique
from skein.plans.preprocess import measures_table
from skein.session import cut_lineage
from skein.sources.sinks import write_tables


def prepare_data(
    videos_raw: DataFrame,
    comments_raw: DataFrame,
    topics: DataFrame,
    id2topics: DataFrame,
    max_comments: int = DEFAULT_MAX_CHILDREN_PER_PARENT,
    seed: int = DEFAULT_SEED,
) -> dict[str, DataFrame]:
    """PIPE-1: string keys → dedupe → content-dedupe count → cap → topic joins → valid-topic
    filters; returns the nine tables plus ``sanity`` (measure, value).

    The deduped and capped tables, which everything else is made from, are
    written to the shared folder once and read back."""
    assert_unique(topics, ["id"], "topics")  # D-17: a repeated key would multiply joined rows
    v = videos_raw.withColumn("id", F.col("id").cast("string"))
    c = comments_raw.withColumn("id", F.col("id").cast("string")).withColumn("video_id", F.col("video_id").cast("string"))
    comments_unique = cut_lineage(rel.dedupe_keep_first(c, ["id", "video_id"], rel.file_order(c)))
    comments_capped = cut_lineage(rel.cap_per_parent(comments_unique, "video_id", "id", max_comments, seed))
    videos_unique = cut_lineage(rel.dedupe_keep_first(v, ["id"], rel.file_order(v)))
    names = rel.topic_names(id2topics)
    videos_with_topics = rel.attach_parent_topics(videos_unique, topics, id2topics, names)
    comments_raw_with_topics = rel.attach_child_topics(comments_unique, topics, id2topics, names)
    comments_capped_with_topics = rel.attach_child_topics(comments_capped, topics, id2topics, names)
    out = {
        "videos_unique": videos_unique,
        "comments_unique": comments_unique,
        "comments_capped": comments_capped,
        "videos_with_topics": videos_with_topics,
        "comments_raw_with_topics": comments_raw_with_topics,
        "comments_capped_with_topics": comments_capped_with_topics,
        "videos_analysis": videos_with_topics.filter(rel.valid_topic()),
        "comments_raw_topic_valid": comments_raw_with_topics.filter(rel.valid_topic()),
        "comments_analysis": comments_capped_with_topics.filter(rel.valid_topic()),
    }
    out["sanity"] = sanity_counts(v, c, comments_unique, comments_capped, topics, videos_with_topics,
                                  comments_raw_with_topics, comments_capped_with_topics, max_comments)
    return out


def sanity_counts(
    videos_raw: DataFrame,
    comments_raw: DataFrame,
    comments_unique: DataFrame,
    comments_capped: DataFrame,
    topics: DataFrame,
    videos_with_topics: DataFrame,
    comments_raw_with_topics: DataFrame,
    comments_capped_with_topics: DataFrame,
    max_comments: int,
) -> DataFrame:
    """AG-15: the 14 sanity measures as (measure, value), one aggregate per input (AG-6 whole-table distinct counts)."""
    text_col = "processed_text" if "processed_text" in comments_unique.columns else "text"
    valid = rel.valid_topic()
    parts = [
        videos_raw.agg(F.count(F.lit(1)).alias("source_video_rows"), F.count_distinct("id").alias("unique_video_ids")),
        comments_raw.agg(F.count(F.lit(1)).alias("source_comment_rows")),
        comments_unique.agg(F.count(F.lit(1)).alias("unique_comment_id_video")),
        comments_unique.select("video_id", comment_text_key(text_col).alias("_k"))
        .dropDuplicates(["video_id", "_k"])
        .agg(F.count(F.lit(1)).alias("unique_comment_video_text")),
        comments_capped.agg(F.count(F.lit(1)).alias(f"comments_after_cap_{max_comments}_per_video")),
        topics.agg(F.count(F.lit(1)).alias("topic_rows")),
        videos_with_topics.agg(
            F.count("topic_id").alias("videos_with_any_topic"),
            F.count_if(valid).alias("videos_valid_non_outlier_topics"),
        ),
        comments_raw_with_topics.agg(
            F.count("topic_id").alias("comments_unique_with_any_topic"),
            F.count_if(valid).alias("comments_unique_valid_non_outlier_topics"),
        ),
        comments_capped_with_topics.agg(F.count_if(valid).alias(f"comments_capped_{max_comments}_valid_non_outlier_topics")),
    ]
    spark = videos_raw.sparkSession
    paper = spark.createDataFrame([(PAPER_VIDEO_COUNT, PAPER_COMMENT_COUNT)], "paper_video_count BIGINT, paper_comment_count BIGINT")
    return measures_table([paper, *parts])


def _with_names(tests: DataFrame, names: DataFrame) -> DataFrame:
    """Rank-test rows carry the topic's label (id + 1) and display name ("Outlier"-safe)."""
    out = tests.join(names, "topic_id", "left")
    return out.withColumn("topic_label", rel.topic_label("topic_id")).withColumn(
        "topic_name", F.coalesce("topic_name", F.lit("Outlier"))
    )


def run_analysis(
    tables: dict[str, DataFrame],
    year: int = 2024,
    metrics=TEST_METRICS,
    kind_capped: str = "comments_capped500",
    id2topics: DataFrame | None = None,
    max_comments: int = DEFAULT_MAX_CHILDREN_PER_PARENT,
    output: str | None = None,
) -> dict[str, DataFrame]:
    """PIPE-10: topic shares, topic table, top parents, daily series, rank tests, quantiles,
    density tables and the audit from the prepared tables.  ``id2topics`` sizes the
    topic-name list (SC-18); without it the valid topic ids of the parents do.

    Histograms and top parents are made eagerly.  With ``output`` every table is
    written below that folder and the written ones are returned."""
    va, ca = tables["videos_analysis"], tables["comments_analysis"]
    if id2topics is None:
        id2topics = va.select("topic_id").distinct()
    names = rel.topic_names(id2topics)
    out = {
        "daily_counts": ts.daily_activity(tables["videos_unique"], tables["comments_unique"]),
        "video_topic_fractions": ts.topic_share_by_year(tables["videos_with_topics"]),
        "comment_topic_fractions": ts.topic_share_total(tables["comments_raw_topic_valid"]),
        "top_videos": ts.top_parents(tables["videos_unique"], tables["comments_unique"], year),
    }
    # STAT-4: metric presence check, then videos and capped comments tested on every metric
    present = [m for m in metrics if m in va.columns and m in ca.columns]
    if len(present) != len(list(metrics)):
        missing = sorted(set(metrics) - set(present))
        raise ValueError(f"Missing test metrics: {missing}")
    out["tests_videos"] = _with_names(st.topic_vs_rest(va, "topic_id", list(metrics), kind="videos"), names)
    out["tests_comments"] = _with_names(st.topic_vs_rest(ca, "topic_id", list(metrics), kind=kind_capped), names)
    out["videos_vs_comments"] = st.two_sample_u(va, ca, "xlm_polarity", ("videos", kind_capped))
    spine = names.select("topic_id")  # tables completed to every named topic (AG-8)
    for kind, df in (("videos", va), ("comments", ca)):
        for m, wide in st.quantile_tables(df, "topic_id", list(metrics), spine=spine).items():
            out[f"quantiles_{kind}_{m}"] = wide
    out["sentiment_medians_videos"] = (
        st.group_medians(va, "topic_id", ["xlm_negative", "xlm_positive"]) if {"xlm_negative", "xlm_positive"} <= set(va.columns) else None
    )
    out = {k: v for k, v in out.items() if v is not None}
    out["kde_videos"] = st.kde_grid(va, "xlm_polarity")
    out["kde_comments"] = st.kde_grid(ca, "xlm_polarity")
    if "topic" in id2topics.columns:
        keywords = id2topics.select(F.col("topic_id").cast("int").alias("topic"), F.col("topic").alias("keywords"))
        out["topic_table"] = kw.topic_table(keywords, names)
    if "sanity" in tables:
        out["audit"] = audit_table(tables["sanity"], out["videos_vs_comments"], out["top_videos"], max_comments)
    if output is None:
        return out
    write_tables(out, output)
    return {name: va.sparkSession.read.parquet(f"{output.rstrip('/')}/{name}") for name in out}


def audit_table(sanity: DataFrame, vidcom: DataFrame, top: DataFrame, max_comments: int) -> DataFrame:
    """PIPE-7: audit numbers as (measure, value-as-text): sanity, the overall test's q, top-5 counts."""
    s = sanity.select("measure", F.col("value").cast("string").alias("value"))
    q = vidcom.select(F.lit("videos_vs_comments_q").alias("measure"), F.col("q_value_bh_fdr").cast("string").alias("value"))
    top5 = top.orderBy(F.col("collected_comments_raw_unique").desc(), "id").limit(5)

    def joined(col: str):
        key = F.struct((-F.col("collected_comments_raw_unique")).alias("k"), F.col("id"), F.col(col).alias("v"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["v"].cast("string")), ", ")

    agg = top5.agg(joined("collected_comments_raw_unique").alias("raw"), joined("collected_comments_text_dedup").alias("text"))
    tops = agg.select(F.lit("top5_raw").alias("measure"), F.col("raw").alias("value")).unionByName(
        agg.select(F.lit("top5_text_dedup").alias("measure"), F.col("text").alias("value"))
    )
    cap = sanity.sparkSession.createDataFrame([("max_comments_per_video", str(max_comments))], "measure STRING, value STRING")
    return s.unionByName(q).unionByName(tops).unionByName(cap)
