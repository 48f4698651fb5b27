"""Analysis and export queries on the orders (parents) / lineitem (children) stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalog import register
from skein.catalog import fixtures as fx
from skein.constants import CHILD_EXPORT_COLUMNS, PARENT_EXPORT_COLUMNS, REDACT_COLUMNS
from skein.operators import export as ex
from skein.operators import relational as rel
from skein.operators import timeseries as ts
from skein.plans.analysis import prepare_data
from skein.plans.collection import prepare_child_ids
from skein.plans.preprocess import preprocess_children, preprocess_parents, preprocess_summary
from skein.session import table
from skein.sources.sinks import redact

_TS = "make_timestamp(create_time * 1000000)"

_DAILY_SQL = f"""
WITH p AS ({fx.PARENTS_SQL}), c AS ({fx.CHILDREN_SQL}),
pt AS (SELECT id, username, {_TS} AS ts, year({_TS}) AS year FROM p),
spine AS (SELECT y AS year, unnest(generate_series(make_date(y, 4, 15), make_date(y, 10, 15), INTERVAL 1 DAY))::DATE AS date
          FROM (SELECT unnest([1996, 1997]) AS y)),
posts AS (SELECT year, CAST(ts AS DATE) AS date, count(DISTINCT id) AS unique_posts, count(DISTINCT username) AS unique_users_posts
          FROM pt WHERE year IN (1996, 1997) GROUP BY ALL),
ct AS (SELECT c.id, {_TS.replace('create_time', 'c.create_time')} AS ts, pt.year FROM c JOIN pt ON c.video_id = pt.id),
com AS (SELECT ct.year, CAST(ts AS DATE) AS date, count(DISTINCT ct.id) AS comments FROM ct
        WHERE ts >= make_timestamp(ct.year, 4, 15, 0, 0, 0) AND ts < make_timestamp(ct.year, 10, 16, 0, 0, 0) GROUP BY ALL)
SELECT spine.year, strftime(spine.date, '%Y-%m-%d') AS date, CAST(coalesce(unique_posts, 0) AS BIGINT) AS unique_posts,
  CAST(coalesce(unique_users_posts, 0) AS BIGINT) AS unique_users_posts, CAST(coalesce(comments, 0) AS BIGINT) AS comments
FROM spine LEFT JOIN posts USING (year, date) LEFT JOIN com USING (year, date)
"""


@register("daily_activity", _DAILY_SQL)
def q_daily_activity(spark: SparkSession, sf: str) -> DataFrame:
    return ts.daily_activity(fx.parents(spark, sf), fx.children(spark, sf), years=[1996, 1997])


_TOPIC_OF_PARENT_SQL = f"""
SELECT p.id, p.create_time, t.topic AS topic_id FROM ({fx.PARENTS_SQL}) p LEFT JOIN ({fx.TOPICS_SQL}) t ON p.id = t.id
"""


@register(
    "topic_share_by_year",
    f"""
WITH v AS (SELECT year({_TS}) AS year, topic_id + 1 AS topic_num FROM ({_TOPIC_OF_PARENT_SQL}) WHERE topic_id >= 0),
c AS (SELECT year, topic_num, count(*) AS n FROM v GROUP BY ALL)
SELECT CAST(year AS INTEGER) AS year, topic_num, CAST(n AS BIGINT) AS count, round(n / sum(n) OVER (PARTITION BY year), 9) AS fraction FROM c
""",
)
def q_topic_share_by_year(spark: SparkSession, sf: str) -> DataFrame:
    p = rel.attach_parent_topics(fx.parents(spark, sf).select("id", "create_time"), fx.topics(spark, sf), fx.id2topics(spark, sf))
    out = ts.topic_share_by_year(p)
    return out.select("year", "topic_num", "count", F.round("fraction", 9).alias("fraction"))


@register(
    "topic_share_total",
    f"""
WITH c AS (SELECT t.topic + 1 AS topic_num FROM ({fx.CHILDREN_SQL}) c JOIN ({fx.TOPICS_SQL}) t ON c.video_id = t.id WHERE t.topic >= 0),
n AS (SELECT topic_num, count(*) AS n FROM c GROUP BY topic_num)
SELECT topic_num, CAST(n AS BIGINT) AS count, round(n / sum(n) OVER (), 9) AS fraction FROM n
""",
)
def q_topic_share_total(spark: SparkSession, sf: str) -> DataFrame:
    c = rel.attach_child_topics(fx.children(spark, sf).select("id", "video_id"), fx.topics(spark, sf), fx.id2topics(spark, sf))
    out = ts.topic_share_total(c)
    return out.select("topic_num", "count", F.round("fraction", 9).alias("fraction"))


@register(
    "top_parents",
    f"""
WITH p AS ({fx.PARENTS_SQL}), c AS ({fx.CHILDREN_SQL}),
raw AS (SELECT video_id AS id, count(*) AS n FROM c GROUP BY video_id),
dd AS (SELECT video_id AS id, count(DISTINCT lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS n FROM c GROUP BY video_id)
SELECT p.id, p.username, CAST(coalesce(raw.n, 0) AS BIGINT) AS collected_comments_raw_unique,
  CAST(coalesce(dd.n, 0) AS BIGINT) AS collected_comments_text_dedup
FROM p LEFT JOIN raw USING (id) LEFT JOIN dd USING (id)
WHERE year({_TS.replace('create_time', 'p.create_time')}) = 1996
ORDER BY collected_comments_raw_unique DESC, p.id LIMIT 50
""",
)
def q_top_parents(spark: SparkSession, sf: str) -> DataFrame:
    return ts.top_parents(fx.parents(spark, sf).select("id", "username", "create_time"), fx.children(spark, sf), 1996, 50)


def _prepared(spark: SparkSession, sf: str, cap: int = 3) -> dict[str, DataFrame]:
    return prepare_data(fx.parents(spark, sf), fx.children(spark, sf), fx.topics(spark, sf), fx.id2topics(spark, sf), cap, 42)


_SANITY_SQL = f"""
WITH p AS ({fx.PARENTS_SQL}), c AS ({fx.CHILDREN_SQL}), t AS ({fx.TOPICS_SQL}),
cu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, video_id ORDER BY create_time, l_partkey, l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, text) AS rn FROM c) WHERE rn = 1),
cc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY md5('42|' || id), id) AS rk FROM cu) WHERE rk <= 3),
vt AS (SELECT p.id, t.topic FROM (SELECT DISTINCT id FROM p) p LEFT JOIN t USING (id)),
ct AS (SELECT cu.id, t.topic FROM cu LEFT JOIN t ON cu.video_id = t.id),
cct AS (SELECT cc.id, t.topic FROM cc LEFT JOIN t ON cc.video_id = t.id)
SELECT * FROM (VALUES ('paper_video_count', 28341), ('paper_comment_count', 80130)) AS x(measure, value)
UNION ALL SELECT 'source_video_rows', count(*) FROM p
UNION ALL SELECT 'unique_video_ids', count(DISTINCT id) FROM p
UNION ALL SELECT 'source_comment_rows', count(*) FROM c
UNION ALL SELECT 'unique_comment_id_video', count(*) FROM cu
UNION ALL SELECT 'unique_comment_video_text', count(*) FROM (SELECT DISTINCT video_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) FROM cu)
UNION ALL SELECT 'comments_after_cap_3_per_video', count(*) FROM cc
UNION ALL SELECT 'topic_rows', count(*) FROM t
UNION ALL SELECT 'videos_with_any_topic', count(topic) FROM vt
UNION ALL SELECT 'videos_valid_non_outlier_topics', count(*) FILTER (WHERE topic >= 0) FROM vt
UNION ALL SELECT 'comments_unique_with_any_topic', count(topic) FROM ct
UNION ALL SELECT 'comments_unique_valid_non_outlier_topics', count(*) FILTER (WHERE topic >= 0) FROM ct
UNION ALL SELECT 'comments_capped_3_valid_non_outlier_topics', count(*) FILTER (WHERE topic >= 0) FROM cct
"""


@register("sanity_counts", f"SELECT measure, CAST(value AS BIGINT) AS value FROM ({_SANITY_SQL})")
def q_sanity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _prepared(spark, sf)["sanity"]


@register(
    "preprocess_summary",
    f"""
WITH c AS ({fx.CHILDREN_SQL}),
k AS (SELECT * FROM c WHERE length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 2),
cu AS (SELECT DISTINCT id, video_id FROM k)
SELECT * FROM (VALUES ('video_rows_in', (SELECT count(*) FROM orders)), ('video_rows_out', (SELECT count(*) FROM orders)),
  ('unique_video_ids_out', (SELECT count(DISTINCT o_orderkey) FROM orders)), ('comment_rows_in', (SELECT count(*) FROM c)),
  ('comment_rows_out', (SELECT count(*) FROM cu)), ('unique_comment_id_video_out', (SELECT count(*) FROM cu))) AS x(measure, value)
""",
)
def q_preprocess_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.parents(spark, sf).select("id", F.col("priority").alias("video_description"), "create_time")
    c = fx.children(spark, sf).select("id", "video_id", "text", "create_time", "l_partkey")
    po = preprocess_parents(p)
    co = preprocess_children(c, dedupe=True, min_chars=2)
    out = preprocess_summary(p, po, c, co)
    return out.select("measure", F.col("value").cast("bigint").alias("value"))


@register(
    "collection_summary",
    """
WITH c AS (SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS comment_count FROM customer)
SELECT * FROM (VALUES ('video_rows', (SELECT count(*) FROM c)), ('unique_video_ids', (SELECT count(DISTINCT id) FROM c)),
  ('videos_after_dedup', (SELECT count(DISTINCT id) FROM c)),
  ('videos_comment_count_ge_10', (SELECT count(*) FROM c WHERE comment_count >= 10)),
  ('video_ids_for_comments', (SELECT count(DISTINCT id) FROM c WHERE comment_count >= 10))) AS x(measure, value)
""",
)
def q_collection_summary(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("comment_count"))
    cust = table(spark, sf, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    parents = cust.select(F.col("c_custkey").cast("string").alias("id"), "comment_count", "c_name")
    _, summary = prepare_child_ids(parents, min_count=10)
    return summary.select("measure", F.col("value").cast("bigint").alias("value"))


def _unrolled_sparse_sql(v: str, c: str, k: int, passes: int = 8) -> str:
    """SET-4 unrolled: each pass filters dates (< k rows over both) then children of lost parents."""
    ctes = [f"v0 AS ({v})", f"c0 AS ({c})"]
    for i in range(1, passes + 1):
        ctes.append(
            f"d{i} AS (SELECT date FROM (SELECT date FROM v{i-1} UNION ALL SELECT date FROM c{i-1}) "
            f"WHERE date IS NOT NULL GROUP BY date HAVING count(*) >= {k})"
        )
        ctes.append(f"v{i} AS (SELECT * FROM v{i-1} WHERE date IN (SELECT date FROM d{i}))")
        ctes.append(
            f"c{i} AS (SELECT * FROM c{i-1} WHERE date IN (SELECT date FROM d{i}) AND video_id IN (SELECT id FROM v{i}))"
        )
    return "WITH " + ",\n".join(ctes)


_DATE = "strftime(make_timestamp(create_time * 1000000), '%Y-%m-%d')"


@register(
    "sparse_date_filter",
    _unrolled_sparse_sql(
        f"SELECT id, {_DATE} AS date FROM ({fx.PARENTS_SQL})",
        f"SELECT id, video_id, {_DATE} AS date FROM ({fx.CHILDREN_SQL})",
        20,
    )
    + "\nSELECT 'parent' AS kind, id, NULL AS video_id, date FROM v8 UNION ALL SELECT 'child', id, video_id, date FROM c8",
)
def q_sparse_date_filter(spark: SparkSession, sf: str) -> DataFrame:
    from skein.functions.scalar import epoch_to_date_str

    v = fx.parents(spark, sf).select("id", epoch_to_date_str("create_time").alias("date"))
    c = fx.children(spark, sf).select("id", "video_id", epoch_to_date_str("create_time").alias("date"))
    v2, c2, _ = ex.filter_sparse_dates(v, c, 20)
    return v2.select(F.lit("parent").alias("kind"), "id", F.lit(None).cast("string").alias("video_id"), "date").unionByName(
        c2.select(F.lit("child").alias("kind"), "id", "video_id", "date")
    )


def _export_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = rel.attach_parent_topics(fx.parents(spark, sf), fx.topics(spark, sf), fx.id2topics(spark, sf))
    v = fx.export_scores(p.select("id", "create_time", "topic_name", "price"), "price")
    c = fx.export_scores(fx.children(spark, sf).select("id", "video_id", "create_time", "l_extendedprice", "l_partkey"), "l_extendedprice")
    return v, c


_EXPORT_K = 10  # the published default minimum entries per date

_EXPORT_BASE_SQL = _unrolled_sparse_sql(
    f"""SELECT p.id, p.create_time, coalesce(nm.topic_name, 'Outlier') AS topic_name, {_DATE.replace('create_time', 'p.create_time')} AS date,
        {fx.export_scores_sql('p.price')}
        FROM ({fx.PARENTS_SQL}) p LEFT JOIN ({fx.TOPICS_SQL}) t ON p.id = t.id LEFT JOIN ({fx.NAMES_SQL}) nm ON t.topic = nm.topic_id""",
    f"""SELECT id, video_id, create_time, {_DATE} AS date, {fx.export_scores_sql('l_extendedprice')}
        FROM (SELECT *, row_number() OVER (PARTITION BY id, video_id ORDER BY create_time, l_extendedprice, l_partkey) AS rn
              FROM ({fx.CHILDREN_SQL})) WHERE rn = 1""",
    _EXPORT_K,
) + """,
vi AS (SELECT *, row_number() OVER (ORDER BY create_time, id) - 1 AS video_index FROM v8),
ci AS (SELECT c8.*, row_number() OVER (ORDER BY c8.video_id, c8.id) - 1 AS comment_index, vi.video_index
       FROM c8 JOIN vi ON c8.video_id = vi.id)
"""

_SCORE_OUT = ", ".join(
    f"round({c}, 9) AS {c}" if c != "xlm_sentiment" else c for c in PARENT_EXPORT_COLUMNS[3:]
)


def _rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c.startswith(("detoxify_", "xlm_")) and c != "xlm_sentiment" else F.col(c) for c in cols])


@register(
    "indexed_export_parents",
    _EXPORT_BASE_SQL + f"SELECT topic_name AS topic, CAST(video_index AS BIGINT) AS video_index, date, {_SCORE_OUT} FROM vi",
)
def q_indexed_export_parents(spark: SparkSession, sf: str) -> DataFrame:
    v, c = _export_inputs(spark, sf)
    ve, _, _ = ex.build_exports(v, c, _EXPORT_K, video_order=("create_time", "id"), comment_order=("video_id", "id"))
    return _rounded(ve, PARENT_EXPORT_COLUMNS)


@register(
    "indexed_export_children",
    _EXPORT_BASE_SQL
    + f"SELECT CAST(video_index AS BIGINT) AS video_index, CAST(comment_index AS BIGINT) AS comment_index, date, {_SCORE_OUT} FROM ci",
)
def q_indexed_export_children(spark: SparkSession, sf: str) -> DataFrame:
    v, c = _export_inputs(spark, sf)
    _, ce, _ = ex.build_exports(v, c, _EXPORT_K, video_order=("create_time", "id"), comment_order=("video_id", "id"))
    return _rounded(ce, CHILD_EXPORT_COLUMNS)


_VIDEO_SQL = """SELECT o_orderkey % 500 AS i, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day FROM orders"""
_COMMENT_SQL = """SELECT l_orderkey % 700 AS i, l_orderkey % 500 + (CASE WHEN l_linenumber = 7 THEN 400 ELSE 0 END) AS v,
  strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS day FROM lineitem"""


@register(
    "export_checks",
    f"""
WITH v AS ({_VIDEO_SQL}), c AS ({_COMMENT_SQL})
SELECT 'disallowed_columns' AS "check", CAST(2 AS BIGINT) AS failures
UNION ALL SELECT 'video_columns', 1 UNION ALL SELECT 'comment_columns', 1
UNION ALL SELECT 'video_index_unique', count(*) FROM (SELECT i FROM v GROUP BY i HAVING count(*) > 1)
UNION ALL SELECT 'comment_index_unique', count(*) FROM (SELECT i FROM c GROUP BY i HAVING count(*) > 1)
UNION ALL SELECT 'comment_parent_exists', count(*) FROM c WHERE v NOT IN (SELECT i FROM v)
UNION ALL SELECT 'dates_above_threshold', count(*) FROM (
  SELECT day FROM (SELECT day FROM v UNION ALL SELECT day FROM c) WHERE day IS NOT NULL GROUP BY day HAVING count(*) < 30)
""",
)
def q_export_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The checks on tables with planted faults of every kind; SQL counts them."""
    day = lambda c: F.date_format(F.col(c).cast("date"), "yyyy-MM-dd").alias("date")
    v = table(spark, sf, "orders").select((F.col("o_orderkey") % 500).alias("video_index"), day("o_orderdate"), F.lit("u").alias("username"))
    far = F.when(F.col("l_linenumber") == 7, 400).otherwise(0)
    c = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 700).alias("comment_index"),
        (F.col("l_orderkey") % 500 + far).alias("video_index"),
        day("l_shipdate"),
        F.lit("u").alias("username"),
    )
    return ex.validate_exports(v, c, 30).select("check", F.col("failures").cast("bigint").alias("failures"))


@register(
    "export_checks_pass",
    """
SELECT "check", CAST(n AS BIGINT) AS failures FROM (VALUES ('disallowed_columns', 0), ('video_columns', 0), ('comment_columns', 0), ('video_index_unique', 0),
  ('comment_index_unique', 0), ('comment_parent_exists', 0), ('dates_above_threshold', 0)) AS x("check", n)
WHERE (SELECT count(*) FROM orders) >= 0
""",
)
def q_export_checks_pass(spark: SparkSession, sf: str) -> DataFrame:
    """The built exports pass every check."""
    v, c = _export_inputs(spark, sf)
    ve, ce, _ = ex.build_exports(v, c, _EXPORT_K)
    return ex.validate_exports(ve, ce, _EXPORT_K).select("check", F.col("failures").cast("bigint").alias("failures"))


@register(
    "redact",
    f"SELECT * EXCLUDE (id, username) FROM ({fx.PARENTS_SQL})",
)
def q_redact(spark: SparkSession, sf: str) -> DataFrame:
    return redact(fx.parents(spark, sf), REDACT_COLUMNS)
