"""Streaming queries: the events table streamed from files, run to completion with
``availableNow``; results read back from the sink.  Each call uses a fresh folder
under the session's checkpoint directory (a shared folder on a cluster)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.catalog import register
from skein.session import ensure_checkpoint_dir, table
from skein.streaming import committed as sc
from skein.streaming import ingest as si


def _scratch(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{uuid.uuid4().hex}"


def _landed_twice(spark: SparkSession, sf: str, root: str) -> str:
    """Land the events as two batches, the second a full replay: every repetition is late, most by weeks."""
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    landing = f"{root}/landing"
    ev.write.parquet(f"{landing}/batch=1")
    ev.write.parquet(f"{landing}/batch=2")
    return landing


def _deduped_stream(spark: SparkSession, sf: str, root: str) -> DataFrame:
    landing = _landed_twice(spark, sf, root)
    schema = spark.read.parquet(f"{landing}/batch=1").schema
    return si.dedupe_stream(si.read_table_stream(spark, landing, schema, max_files=1), ["event_id"])


@register(
    "stream_ingest_dedupe",
    "SELECT event_id, user_id, event_type, value FROM events",
)
def q_stream_ingest_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    root = _scratch(spark, "ingest")
    df = _deduped_stream(spark, sf, root).select("event_id", "user_id", "event_type", "value")
    si.run_available_now(df, f"{root}/out", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out")


@register(
    "stream_daily_counts",
    "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def q_stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    root = _scratch(spark, "daily")
    counts = si.daily_counts_stream(_deduped_stream(spark, sf, root), "ts", ["event_type"])
    si.run_available_now(counts, "", f"{root}/ckpt", mode="complete", foreach_batch=si.overwrite_each_batch(f"{root}/out"))
    return spark.read.parquet(f"{root}/out")


def _taken_in(spark: SparkSession, sf: str, name: str) -> str:
    """Root of the tables that four micro-batches, the last two a full replay, have been committed to."""
    root = _scratch(spark, name)
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(4):
        ev.where(F.col("event_id") % 2 == i % 2).coalesce(1).write.parquet(f"{root}/landing/batch={i}")
    schema = ev.schema
    stream = si.read_table_stream(spark, f"{root}/landing", schema, max_files=1)
    take = sc.take_in(f"{root}/table", ["event_id"], "ts", ["event_type"])
    si.run_available_now(stream.select(*schema.names), "", f"{root}/ckpt", foreach_batch=take)
    return f"{root}/table"


@register("stream_keyed_ingest", "SELECT event_id, user_id, event_type, value FROM events")
def q_stream_keyed_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """STR-2 without stream state: replays are dropped against the committed keys of their buckets."""
    found = sc.read_rows(spark, _taken_in(spark, sf, "keyed"))
    return found.select("event_id", "user_id", "event_type", "value")


@register(
    "stream_daily_merge",
    "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def q_stream_daily_merge(spark: SparkSession, sf: str) -> DataFrame:
    """STR-5 without rewriting the table: each batch merges its counts into the days it touches."""
    found = sc.read_daily(spark, _taken_in(spark, sf, "merged"))
    return found.select(F.col("day").cast("string").alias("day"), "event_type", "n")


@register(
    "stream_latest_status",
    """
SELECT user_id, event_id, event_type FROM (
  SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1 AND event_type = 'error'
""",
)
def q_stream_latest_status(spark: SparkSession, sf: str) -> DataFrame:
    """STR-3 fed by JSONL batches that arrive in any order, over several micro-batches."""
    root = _scratch(spark, "status")
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    ev.repartition("event_id").select(F.to_json(F.struct("*"))).write.text(f"{root}/landing")
    record = T.StructType([*_EV_RECORD.fields[:3], T.StructField("at", T.LongType())])
    stream = si.read_child_stream(spark, f"{root}/landing", record, max_files=3, pattern="*.txt")
    latest = si.latest_status(stream, "user_id", ["at", "event_id"], ["event_type"])
    si.run_available_now(latest, "", f"{root}/ckpt", mode="update", foreach_batch=si.append_each_batch(f"{root}/changes"))
    current = si.fold_changes(spark.read.parquet(f"{root}/changes"), "user_id", ["at", "event_id"])
    return current.filter(F.col("event_type") == "error").select("user_id", "event_id", "event_type")


@register(
    "stream_topic_inherit",
    """
SELECT c.video_id, c.id, t.topic AS topic_id
FROM (SELECT CAST(l_orderkey AS VARCHAR) AS video_id, CAST(l_linenumber AS VARCHAR) AS id FROM lineitem) c
LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 2 AS topic
           FROM orders WHERE o_orderstatus <> 'P') t ON c.video_id = t.id
""",
)
def q_stream_topic_inherit(spark: SparkSession, sf: str) -> DataFrame:
    from skein.catalog import fixtures as fx

    root = _scratch(spark, "inherit")
    fx.children(spark, sf).select("id", "video_id").write.mode("overwrite").parquet(f"{root}/landing")
    schema = spark.read.parquet(f"{root}/landing").schema
    stream = si.read_table_stream(spark, f"{root}/landing", schema)
    joined = si.inherit_topics_stream(stream, fx.topics(spark, sf), fx.id2topics(spark, sf)).select("video_id", "id", "topic_id")
    si.run_available_now(joined, f"{root}/out", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out")


_EV_RECORD = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


_TAGGED = """SELECT event_id, user_id, event_type, value, event_type || ' b' AS tags FROM events"""


@register(
    "file_ingest",
    f"""
SELECT 'envelope' AS via, * FROM ({_TAGGED})
UNION ALL
SELECT 'batch', * FROM ({_TAGGED}) WHERE event_id % 3 > 0
UNION ALL
SELECT 'jsonl', * FROM ({_TAGGED}) WHERE event_id % 3 = 0
""",
)
def q_file_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-1 + SRC-3 + SET-1 through real files.

    Events land as JSON envelopes of at most 1,000 records (one file each, read
    whole) and as child batches, partly JSONL lines, partly JSON lists and
    ``comments`` envelopes.  Their tags are lists, text with commas, list
    literals in Python's quotes or JSON lists in text.  Between the lines stand
    blank ones, lists, numbers and malformed ones.
    """
    from skein.sources.readers import SKIP, read_child_batches, read_parent_envelopes

    root = _landed_files(spark, sf)
    record = T.StructType([*_EV_RECORD.fields, T.StructField("hashtag_names", T.StringType())])
    a = read_parent_envelopes(spark, f"{root}/envelopes", "*.txt", record)
    b = read_child_batches(spark, f"{root}/batches", record, "*.txt.gz", "*.txt", on_malformed=SKIP)
    cols = ["event_id", "user_id", "event_type", "value", F.array_join("hashtag_names", " ").alias("tags")]
    via = F.when(F.col("file_kind") == 0, "jsonl").otherwise("batch").alias("via")
    return a.select(F.lit("envelope").alias("via"), *cols).unionByName(b.select(via, *cols))


@register(
    "file_ingest_errors",
    """SELECT '{"event_id": ' || event_id || ', ' AS value FROM events WHERE event_id % 50 = 0
UNION ALL SELECT 'no JSON ' || event_id FROM events WHERE event_id % 50 = 1""",
)
def q_file_ingest_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Error output of the JSONL reader: every malformed line, and nothing else."""
    from skein.sources.readers import malformed_lines

    return malformed_lines(spark, f"{_landed_files(spark, sf)}/batches", "*.txt.gz").select("value")


@register(
    "split_ingest",
    """SELECT CAST(row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS pos, event_id, user_id, event_type, value
FROM events""",
)
def q_split_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-1/2: four large envelopes, each one JSON document over many lines, read by byte ranges."""
    from skein.sources.readers import read_payload_records

    root = _scratch(spark, "envelopes")
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    part = (F.col("event_id") % 4).alias("part")
    rows = ev.select(part, F.col("event_id").alias("at"), F.concat(F.lit(", "), F.to_json(F.struct(*ev.columns))).alias("value"))
    ends = ev.select(part).distinct()
    head = ends.select("part", F.lit(-1).cast("bigint").alias("at"), F.lit('{"error": null, "results": [17').alias("value"))
    foot = ends.select("part", F.lit((1 << 62)).alias("at"), F.lit("]}").alias("value"))
    lines = rows.unionByName(head).unionByName(foot).repartition("part").sortWithinPartitions("part", "at")
    lines.select("part", "value").write.partitionBy("part").text(root)
    found = read_payload_records(spark, root, _EV_RECORD, "*.txt", split_bytes=1)
    return found.select("pos", "event_id", "user_id", "event_type", "value")


def _landed_files(spark: SparkSession, sf: str) -> str:
    root = _scratch(spark, "files")
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    kind = F.col("event_id") % 4
    tags = F.array("event_type", F.lit("b"))
    own = [F.col(c) for c in ev.columns]
    text = (
        F.when(kind == 1, F.concat("event_type", F.lit(", #b")))
        .when(kind == 2, F.concat(F.lit("['"), "event_type", F.lit("', None, \"#b\"]")))
        .otherwise(F.to_json(tags))
    )
    as_list = F.to_json(F.struct(*own, tags.alias("hashtag_names")))
    ev = ev.withColumn("v", F.when(kind == 0, as_list).otherwise(F.to_json(F.struct(*own, text.alias("hashtag_names")))))
    grouped = ev.groupBy(F.floor(F.col("event_id") / 1000).alias("b"), (F.col("event_id") % 3).alias("part"))
    lists = grouped.agg(F.array_join(F.collect_list("v"), ",").alias("v"))
    one = {"maxRecordsPerFile": 1}
    envelopes = lists.select(F.concat(F.lit('{"error": null, "results": ['), "v", F.lit("]}")).alias("v"))
    envelopes.write.options(**one).text(f"{root}/envelopes")
    shape = F.when(F.col("part") == 1, F.concat(F.lit("[17, "), "v", F.lit("]"))).otherwise(
        F.concat(F.lit('{"comments": ['), "v", F.lit("]}"))
    )
    batches = lists.where("part > 0").select(shape.alias("v"))
    batches.write.options(**one).text(f"{root}/batches")
    odd = F.col("event_id") % 50
    line = (
        F.when(odd == 0, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(", ")))
        .when(odd == 1, F.concat(F.lit("no JSON "), F.col("event_id").cast("string")))
        .when(odd == 2, F.lit("  "))
        .when(odd == 3, F.lit("[1, 2]"))
        .when(odd == 4, F.lit("12"))
    )
    lines = ev.where("event_id % 3 = 0").select("v").unionByName(ev.select(line.alias("v")).where("v is not null"))
    lines.write.mode("append").option("compression", "gzip").text(f"{root}/batches")
    return root
