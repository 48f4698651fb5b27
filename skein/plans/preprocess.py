"""Preprocessing plans (PIPE-2, PIPE-3) and their summary table (AG-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.scalar import normalize_id_columns
from skein.functions.text import alnum_count, compose_text, normalize_social_text
from skein.operators import relational as rel


def preprocess_parents(videos: DataFrame, include_hashtags: bool = True, dedupe: bool = True) -> DataFrame:
    """PIPE-2: ids → composed ``text`` → ``processed_text`` → keep first per id."""
    rel.require_columns(videos, ["id"], "videos")
    v = normalize_id_columns(videos)
    tags = "hashtag_names" if "hashtag_names" in v.columns else None
    tags_are_array = tags is not None and isinstance(v.schema[tags].dataType, T.ArrayType)
    desc = "video_description" if "video_description" in v.columns else None
    speech = "voice_to_text" if "voice_to_text" in v.columns else None
    text = compose_text(
        F.col(desc) if desc else F.lit(None).cast("string"),
        F.col(speech) if speech else None,
        F.col(tags) if tags else None,
        include_hashtags,
        tags_are_array,
    )
    v = v.withColumn("text", text).withColumn("processed_text", normalize_social_text("text"))
    return rel.dedupe_keep_first(v, ["id"], rel.file_order(v)) if dedupe else v


def preprocess_children(comments: DataFrame, dedupe: bool = True, min_chars: int = 0) -> DataFrame:
    """PIPE-3: ids → ``processed_text`` → minimum signal (before dedupe, as published) → keep first
    per (id, video_id)."""
    rel.require_columns(comments, ["id", "video_id", "text"], "comments")
    c = normalize_id_columns(comments).withColumn("processed_text", normalize_social_text("text"))
    if min_chars > 0:
        c = c.filter(alnum_count("processed_text") >= min_chars)  # FLT-2
    return rel.dedupe_keep_first(c, ["id", "video_id"], rel.file_order(c)) if dedupe else c


def preprocess_summary(videos_in: DataFrame, videos_out: DataFrame, comments_in: DataFrame, comments_out: DataFrame) -> DataFrame:
    """AG-14: six (measure, value) rows."""
    a = videos_in.agg(F.count(F.lit(1)).alias("video_rows_in"))
    b = videos_out.agg(F.count(F.lit(1)).alias("video_rows_out"), F.count_distinct("id").alias("unique_video_ids_out"))
    c = comments_in.agg(F.count(F.lit(1)).alias("comment_rows_in"))
    d = comments_out.agg(F.count(F.lit(1)).alias("comment_rows_out"))
    e = comments_out.select("id", "video_id").distinct().agg(F.count(F.lit(1)).alias("unique_comment_id_video_out"))
    return measures_table([a, b, c, d, e])


def measures_table(parts: list[DataFrame]) -> DataFrame:
    """(measure, value) rows from one-row aggregates, in order (unpivot + union, no joins)."""
    out = None
    for i, part in enumerate(parts):
        cols = part.columns
        long = part.select(*[F.col(c).cast("bigint").alias(c) for c in cols]).unpivot([], cols, "measure", "value")
        long = long.withColumn("__part", F.lit(i))
        out = long if out is None else out.unionByName(long)
    return out.drop("__part")
