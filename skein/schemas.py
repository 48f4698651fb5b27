"""Explicit schemas for the parent/child record model (§1 of the survey).

Ids are strings in the read schema so 19-digit ids never pass through double.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D = T.StringType(), T.LongType(), T.DoubleType()

PARENT_SCHEMA = T.StructType(
    [
        T.StructField("id", S),
        T.StructField("video_description", S),
        T.StructField("create_time", L),
        T.StructField("region_code", S),
        T.StructField("share_count", L),
        T.StructField("view_count", L),
        T.StructField("like_count", L),
        T.StructField("comment_count", L),
        T.StructField("music_id", S),
        T.StructField("hashtag_names", S),  # raw JSON: records have a list or text; readers make it a list
        T.StructField("username", S),
        T.StructField("effect_ids", T.ArrayType(S)),
        T.StructField("playlist_id", S),
        T.StructField("voice_to_text", S),
        T.StructField("favorites_count", L),
    ]
)

CHILD_SCHEMA = T.StructType(
    [
        T.StructField("id", S),
        T.StructField("video_id", S),
        T.StructField("text", S),
        T.StructField("like_count", L),
        T.StructField("reply_count", L),
        T.StructField("parent_comment_id", S),
        T.StructField("create_time", L),
    ]
)

PARENT_FIELDS = PARENT_SCHEMA.fieldNames()
CHILD_FIELDS = CHILD_SCHEMA.fieldNames()
