"""Sinks (SNK-1 … SNK-8).  All writes go through Spark's commit protocol, which gives
the atomic temp-then-rename behaviour of the published writers (SNK-3)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.constants import REDACT_COLUMNS


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """SNK-1: columnar table (Parquet; the re-aim of Feather)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """SNK-2: CSV with header.  ``single_file`` only for small result tables."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-3: JSON lines, committed atomically by the output committer."""
    df.write.mode(mode).json(path)


def write_jsonl_batches(df: DataFrame, path: str, records_per_file: int = 1000, request_id: str | None = None) -> None:
    """SNK-4: append JSONL files of at most ``records_per_file`` rows; a missing or blank
    ``video_id`` is filled from the request id column/literal."""
    out = df
    if request_id is not None and "video_id" in df.columns:
        req = F.col(request_id) if request_id in df.columns else F.lit(request_id)
        out = out.withColumn("video_id", F.coalesce(F.nullif(F.col("video_id"), F.lit("")), req))
    out.write.mode("append").option("maxRecordsPerFile", records_per_file).json(path)


def write_split_by_status(df: DataFrame, ok_path: str, error_path: str, error_col: str = "error") -> None:
    """SNK-5: rows without an error to ``ok_path``, the rest to ``error_path``."""
    ok = F.col(error_col).isNull()
    df.filter(ok).write.mode("append").json(ok_path)
    df.filter(~ok).write.mode("append").json(error_path)


def has_columns(spark: SparkSession, path: str, needed: Iterable[str]) -> bool:
    """SNK-6: an existing output is reusable when it holds every needed column (schema only)."""
    from skein.sources.readers import path_exists

    if not path_exists(spark, path):
        return False
    return set(needed) <= set(spark.read.parquet(path).schema.names)


def fingerprint(df: DataFrame) -> DataFrame:
    """D-12: input fingerprint (row count, order-free sum of row hashes) to stamp next to a cache."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"))


def redact(df: DataFrame, columns: Sequence[str] = REDACT_COLUMNS) -> DataFrame:
    """SNK-7: drop identifying columns when present."""
    return df.drop(*[c for c in columns if c in df.columns])


def write_topic_table_csv(topic_table: DataFrame, path: str) -> None:
    """SNK-2 for TXT-3: one small CSV with the published headers, in topic order."""
    from skein.constants import TOPIC_TABLE_HEADERS

    cols = ["ID", "topic_id", "topic_label", "top_tags_first6", "top_tags_all"]
    renamed = topic_table.select(*[F.col(c).alias(h) for c, h in zip(cols, TOPIC_TABLE_HEADERS)])
    write_csv(renamed.orderBy("topic_id"), path, single_file=True)  # one row per topic: small


def write_tables(tables: dict[str, DataFrame], base: str, suffix: str = "") -> None:
    """SNK-8: write several analysis tables (their shared ancestors are written tables, see ``prepare_data``)."""
    for name, df in tables.items():
        write_table(df, f"{base.rstrip('/')}/{name}{suffix}")
