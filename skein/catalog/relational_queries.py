"""Relational queries: dedupe, cap, topic joins, membership, indices, ids, JSON, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.catalog import register
from skein.catalog import fixtures as fx
from skein.functions import scalar as sc
from skein.operators import relational as rel
from skein.session import table
from skein.sources.readers import explode_records

_LI_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
_LI_ORDER_SQL = ", ".join(f"{c} ASC NULLS FIRST" for c in _LI_COLS if c not in ("l_orderkey", "l_linenumber"))


@register(
    "dedupe_keep_first",
    f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS ship_day
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LI_ORDER_SQL}) AS rn FROM lineitem)
WHERE rn = 1
""",
)
def q_dedupe_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    kept = rel.dedupe_keep_first(li, ["l_orderkey", "l_linenumber"])
    return kept.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day"),
    )


@register(
    "cap_per_parent",
    """
SELECT user_id, event_id FROM (
  SELECT user_id, event_id, row_number() OVER (
    PARTITION BY user_id ORDER BY md5('42|' || CAST(event_id AS VARCHAR)), CAST(event_id AS VARCHAR)) AS rn
  FROM events)
WHERE rn <= 50
""",
)
def q_cap_per_parent(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("user_id", "event_id")
    return rel.cap_per_parent(ev, parent_col="user_id", id_col="event_id", max_rows=50, seed=42)


def _meta_sql(base: str, key: str) -> str:
    return f"""
WITH t AS ({fx.TOPICS_SQL}), k AS ({fx.ID2TOPICS_SQL}), nm AS ({fx.NAMES_SQL}),
b AS ({base})
SELECT b.*, t.topic AS topic_id, coalesce(k.topic, 'Outlier') AS topic_keywords,
       coalesce(CAST(t.topic + 1 AS VARCHAR), '') AS topic_label, coalesce(nm.topic_name, 'Outlier') AS topic_name
FROM b LEFT JOIN t ON b.{key} = t.id LEFT JOIN k ON t.topic = k.topic_id LEFT JOIN nm ON t.topic = nm.topic_id
"""


@register(
    "topic_metadata",
    _meta_sql(f"SELECT id, create_time FROM ({fx.PARENTS_SQL})", "id"),
)
def q_topic_metadata(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.parents(spark, sf).select("id", "create_time")
    out = rel.attach_parent_topics(p, fx.topics(spark, sf), fx.id2topics(spark, sf))
    return out.select("id", "create_time", "topic_id", "topic_keywords", "topic_label", "topic_name")


@register(
    "topic_inherit",
    _meta_sql(f"SELECT id, video_id, l_partkey FROM ({fx.CHILDREN_SQL})", "video_id"),
)
def q_topic_inherit(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.children(spark, sf).select("id", "video_id", "l_partkey")
    out = rel.attach_child_topics(c, fx.topics(spark, sf), fx.id2topics(spark, sf))
    return out.select("id", "video_id", "l_partkey", "topic_id", "topic_keywords", "topic_label", "topic_name")


@register(
    "topic_names",
    """
SELECT CAST(topic_id AS INTEGER) AS topic_id,
  CASE WHEN topic_id < 15 THEN NULL ELSE 'Topic ' || CAST(topic_id + 1 AS VARCHAR) END AS extra_name
FROM (SELECT unnest(range(0, CAST(max(p_size) AS BIGINT) + 1)) AS topic_id FROM part)
""",
)
def q_topic_names(spark: SparkSession, sf: str) -> DataFrame:
    # SC-18 sized by data: part sizes (1..50) play the fitted topic ids.
    ids = table(spark, sf, "part").select(F.col("p_size").alias("topic_id"))
    names = rel.topic_names(ids)
    return names.select(
        "topic_id", F.when(F.col("topic_id") >= 15, F.col("topic_name")).alias("extra_name")
    )


@register(
    "semi_parent",
    """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
""",
)
def q_semi_parent(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("video_id"), "l_linenumber", "l_partkey")
    par = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("id"))
    return rel.children_of(li, par).withColumnRenamed("video_id", "l_orderkey")


@register(
    "anti_done",
    """
SELECT o_orderkey FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')
""",
)
def q_anti_done(spark: SparkSession, sf: str) -> DataFrame:
    todo = table(spark, sf, "orders").select("o_orderkey")
    done = table(spark, sf, "lineitem").filter(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")).select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    return rel.not_done(todo, done, "o_orderkey")


@register(
    "orphan_check",
    """
SELECT 'all' AS parents, CAST(count(*) AS BIGINT) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL
SELECT 'status_f', CAST(count(*) AS BIGINT) FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
""",
)
def q_orphan_check(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey")
    o = table(spark, sf, "orders")
    a = rel.count_orphans(li, o, "l_orderkey", "o_orderkey").select(F.lit("all").alias("parents"), "orphans")
    f = rel.count_orphans(li, o.filter(F.col("o_orderstatus") == "F"), "l_orderkey", "o_orderkey").select(
        F.lit("status_f").alias("parents"), "orphans"
    )
    return a.unionByName(f)


_ELIGIBLE_SQL = """
SELECT DISTINCT CAST(c.c_custkey AS VARCHAR) AS id
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
WHERE coalesce(o.n, 0) >= 10
"""


def _eligible(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("comment_count"))
    cust = table(spark, sf, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rel.distinct_ids(rel.eligible_parents(cust, "comment_count", 10).select(F.col("c_custkey").alias("id")), "id")


@register("eligible_ids", _ELIGIBLE_SQL)
def q_eligible_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _eligible(spark, sf)


@register(
    "seeded_shuffle",
    f"""
SELECT id, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS shuffle_pos FROM ({_ELIGIBLE_SQL})
""",
)
def q_seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    ids = _eligible(spark, sf)
    return rel.dense_index(ids, [rel.seeded_order_key("id", 42), F.col("id")], "shuffle_pos")


@register(
    "first_n",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
)
def q_first_n(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rel.first_n(o, "o_orderkey", 100)


@register(
    "id_normalise",
    """
SELECT event_id,
  CAST(CAST(CAST(event_id AS DOUBLE) AS BIGINT) AS VARCHAR) AS id_from_double,
  regexp_replace(json_extract_string(props, '$.k') || '.0', '^(-?[0-9]+)\\.0+$', '\\1') AS id_from_json,
  CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) END AS value_id
FROM events
""",
)
def q_id_normalise(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    as_json = F.concat(F.get_json_object("props", "$.k"), F.lit(".0"))
    whole = sc.normalize_id(F.col("value"), T.DoubleType())
    return ev.select(
        "event_id",
        sc.normalize_id(F.col("event_id").cast("double"), T.DoubleType()).alias("id_from_double"),
        sc.normalize_id(as_json, T.StringType()).alias("id_from_json"),
        F.when(F.col("value") == F.floor("value"), whole).alias("value_id"),
    )


@register(
    "numeric_coerce",
    """
SELECT event_type, CAST(count(k) AS BIGINT) AS n_numeric, CAST(count(*) - count(k) AS BIGINT) AS n_bad,
  CAST(sum(CAST(k AS BIGINT)) AS BIGINT) AS k_sum
FROM (SELECT event_type,
        TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'x' || json_extract_string(props, '$.k') ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS k
      FROM events)
GROUP BY event_type
""",
)
def q_numeric_coerce(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    raw = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), raw)).otherwise(raw)
    k = sc.to_number(raw)
    return ev.select("event_type", k.alias("k")).groupBy("event_type").agg(
        F.count("k").alias("n_numeric"),
        (F.count(F.lit(1)) - F.count("k")).alias("n_bad"),
        F.sum(F.col("k").cast("bigint")).alias("k_sum"),
    )


_EVENT_RECORD = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())]
)


@register(
    "json_records",
    """
SELECT event_id // 10 AS bucket, CAST(row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id) - 1 AS BIGINT) AS pos,
       event_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events
""",
)
def q_json_records(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-2 / SC-25: envelopes of ≤ 10 records (bounded by construction) in all three shapes,
    serialised to JSON and parsed back by the generic payload reader."""
    ev = table(spark, sf, "events").withColumn("bucket", F.floor(F.col("event_id") / 10).cast("bigint"))
    recs = ev.groupBy("bucket").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("recs")
    )
    shape = F.col("bucket") % 3
    payload = (
        F.when(shape == 0, F.to_json(F.struct(F.col("recs").alias("results"), F.lit(None).cast("string").alias("error"))))
        .when(shape == 1, F.to_json("recs"))
        .otherwise(F.to_json(F.struct(F.lit(None).cast("string").alias("results"), F.col("recs").alias("comments"))))
    )
    parsed = explode_records(recs.select("bucket", payload.alias("payload")), "payload", _EVENT_RECORD)
    props = ev.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return parsed.join(props, "event_id").select("bucket", "pos", "event_id", "event_type", "value", "k")


@register(
    "collection_plan",
    """
WITH plan AS (
  SELECT y AS year, d::DATE AS day, r AS run_index
  FROM (SELECT unnest([2023, 2024]) AS y) ys,
       LATERAL (SELECT unnest(generate_series(make_date(y, 1, 1), make_date(y, 2, 15), INTERVAL 1 DAY)) AS d) ds,
       (SELECT unnest([1, 2]) AS r) rs
),
done AS (SELECT DISTINCT year(ts) AS year, CAST(ts AS DATE) AS day, 1 AS run_index FROM events)
SELECT year, strftime(day, '%Y-%m-%d') AS day, strftime(day, '%Y%m%d') AS api_date, run_index
FROM plan ANTI JOIN done USING (year, day, run_index)
""",
)
def q_collection_plan(spark: SparkSession, sf: str) -> DataFrame:
    from skein.plans.collection import collection_plan

    done = table(spark, sf, "events").select(
        F.year("ts").alias("year"), F.to_date("ts").alias("day"), F.lit(1).alias("run_index")
    )
    plan = collection_plan(spark, [2023, 2024], "01-01", "02-15", runs=2, done=done)
    return plan.select("year", F.date_format("day", "yyyy-MM-dd").alias("day"), "api_date", "run_index")
