"""Stand-ins for the parent/child model built from the driver's tables.

* parents  = orders   (id = o_orderkey, create_time = epoch of o_orderdate,
                       topic = priority code − 2, so "1-URGENT" is the outlier −1)
* children = lineitem (id = l_linenumber, video_id = l_orderkey,
                       create_time = epoch of l_shipdate)
* topics   = (id, topic) for parents whose status is not 'P'
* id2topics = (topic_id, topic) keywords for topic ids 0..2 (3 has none)

Each Spark builder has a DuckDB twin so oracle SQL can start from the same rows.
Score columns for the statistics come from arithmetic on the source columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import table


def epoch(c: str):
    return F.unix_seconds(F.col(c).cast("timestamp"))


def parents(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        epoch("o_orderdate").alias("create_time"),
        F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("username"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
    )


PARENTS_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(epoch(o_orderdate) AS BIGINT) AS create_time,
       'user' || CAST(o_custkey AS VARCHAR) AS username, o_orderstatus AS status, o_orderpriority AS priority,
       o_totalprice AS price
FROM orders
"""


def children(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_linenumber").cast("string").alias("id"),
        F.col("l_orderkey").cast("string").alias("video_id"),
        epoch("l_shipdate").alias("create_time"),
        F.col("l_partkey"),
        F.col("l_quantity"),
        F.col("l_extendedprice"),
        F.col("l_discount"),
        F.col("l_tax"),
        F.col("l_returnflag"),
        F.col("l_linestatus"),
        F.concat(F.col("l_returnflag"), F.lit("  "), F.lower("l_linestatus")).alias("text"),
    )


CHILDREN_SQL = """
SELECT CAST(l_linenumber AS VARCHAR) AS id, CAST(l_orderkey AS VARCHAR) AS video_id,
       CAST(epoch(l_shipdate) AS BIGINT) AS create_time, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, l_returnflag || '  ' || lower(l_linestatus) AS text
FROM lineitem
"""


def topics(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 2).alias("topic"),
    )


TOPICS_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 2 AS topic
FROM orders WHERE o_orderstatus <> 'P'
"""


def id2topics(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("topic_id", F.substring("o_orderpriority", 1, 1).cast("int") - 2)
    o = o.filter((F.col("topic_id") >= 0) & (F.col("topic_id") <= 2))
    return o.groupBy("topic_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.lower("o_orderstatus"))), ", ").alias("topic")
    )


ID2TOPICS_SQL = """
SELECT topic_id, string_agg(DISTINCT lower(o_orderstatus), ', ' ORDER BY lower(o_orderstatus)) AS topic
FROM (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 2 AS topic_id, o_orderstatus FROM orders)
WHERE topic_id BETWEEN 0 AND 2 GROUP BY topic_id
"""

# Topic display names for ids 0..2 (max id in id2topics is 2); 3 → "Outlier".
NAMES_SQL = "SELECT * FROM (VALUES (0, 'Sunset'), (1, 'Depression'), (2, 'Mental Health Month')) AS t(topic_id, topic_name)"


def export_scores(df: DataFrame, base: str) -> DataFrame:
    """Seven toxicity and five sentiment columns from arithmetic on one numeric column."""
    from skein.functions.scalar import argmax_label

    x = F.col(base)
    neg, pos = (x % 5) / 10, (x % 4) / 10
    neu = F.lit(1.0) - neg - pos
    return df.select(
        "*",
        ((x % 1000) / 1000).alias("detoxify_toxicity"),
        ((x % 7) / 7).alias("detoxify_severe_toxicity"),
        ((x % 13) / 13).alias("detoxify_obscene"),
        ((x % 17) / 17).alias("detoxify_identity_attack"),
        ((x % 97) / 97).alias("detoxify_insult"),
        ((x % 3) / 3).alias("detoxify_threat"),
        ((x % 11) / 11).alias("detoxify_sexual_explicit"),
        argmax_label(F.array(neg, neu, pos)).alias("xlm_sentiment"),
        (pos - neg).alias("xlm_polarity"),
        neg.alias("xlm_negative"),
        neu.alias("xlm_neutral"),
        pos.alias("xlm_positive"),
    )


def export_scores_sql(x: str) -> str:
    neg, pos = f"(({x}) % 5) / 10", f"(({x}) % 4) / 10"
    neu = f"(1.0 - {neg} - {pos})"
    return f"""(({x}) % 1000) / 1000 AS detoxify_toxicity, (({x}) % 7) / 7 AS detoxify_severe_toxicity,
  (({x}) % 13) / 13 AS detoxify_obscene, (({x}) % 17) / 17 AS detoxify_identity_attack,
  (({x}) % 97) / 97 AS detoxify_insult, (({x}) % 3) / 3 AS detoxify_threat, (({x}) % 11) / 11 AS detoxify_sexual_explicit,
  CASE WHEN {neg} >= {neu} AND {neg} >= {pos} THEN 'xlm_negative' WHEN {neu} >= {pos} THEN 'xlm_neutral' ELSE 'xlm_positive' END AS xlm_sentiment,
  {pos} - {neg} AS xlm_polarity, {neg} AS xlm_negative, {neu} AS xlm_neutral, {pos} AS xlm_positive"""


def scored(df: DataFrame, kind: str) -> DataFrame:
    """Add score columns in [0, 1] / [−1, 1] derived from source columns (stand-ins for model scores)."""
    if kind == "children":
        base = F.col("l_discount") * 10  # 0.0 .. 1.0
        return df.select(
            "*",
            (F.col("l_discount") * 10).alias("detoxify_toxicity"),
            (F.col("l_tax") * 12.5).alias("detoxify_insult"),
            (F.col("l_quantity") / 50).alias("detoxify_obscene"),
            (base - F.col("l_tax") * 12.5).alias("xlm_polarity"),
        )
    return df.select(
        "*",
        (F.col("price") % 1000 / 1000).alias("detoxify_toxicity"),
        (F.col("price") % 97 / 97).alias("detoxify_insult"),
        (F.col("price") % 13 / 13).alias("detoxify_obscene"),
        (F.col("price") % 200 / 100 - 1).alias("xlm_polarity"),
    )
