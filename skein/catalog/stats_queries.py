"""Statistics queries on ``events`` (topic = event_type; metrics = value and props.k)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalog import register
from skein.functions.scalar import significance
from skein.operators import stats as st
from skein.session import table

_PROBS = [0.01, 0.05, 0.10, 0.50, 0.90, 0.95, 0.99]
_QNAMES = ["q01", "q05", "q10", "q50", "q90", "q95", "q99"]


def _events(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


_LONG_SQL = """
long AS (
  SELECT event_type AS topic, metric, v AS value FROM (
    SELECT event_type, 'value' AS metric, value AS v FROM events
    UNION ALL
    SELECT event_type, 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events
    UNION ALL
    SELECT event_type, 'partial', value FROM events WHERE event_type <> 'error')
  WHERE v IS NOT NULL AND isfinite(v)
), spine AS (SELECT topic, metric FROM (SELECT DISTINCT event_type AS topic FROM events WHERE event_type IS NOT NULL)
             CROSS JOIN (VALUES ('value'), ('k'), ('partial')) AS m(metric))"""


@register(
    "quantiles_by_topic",
    "SELECT event_type, "
    + ", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for p, n in zip(_PROBS, _QNAMES))
    + " FROM events WHERE value IS NOT NULL GROUP BY event_type",
)
def q_quantiles_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    long = st.long_metrics(_events(spark, sf), ["event_type"], ["value"])
    wide = st.quantile_table(long, "event_type", _PROBS)
    return wide.select("event_type", *[F.round(n, 6).alias(n) for n in _QNAMES])


@register(
    "medians_by_topic",
    """
SELECT event_type, round(median(value), 6) AS median_value, round(median(k), 6) AS median_k
FROM (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
WHERE value IS NOT NULL AND k IS NOT NULL GROUP BY event_type
""",
)
def q_medians_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    med = st.group_medians(_events(spark, sf), "event_type", ["value", "k"])
    return med.select("event_type", F.round("value", 6).alias("median_value"), F.round("k", 6).alias("median_k"))


_MWU_SQL = f"""
WITH {_LONG_SQL},
hist AS (SELECT metric, value, count(*) AS c FROM long GROUP BY metric, value),
ranks AS (SELECT metric, value, c,
            coalesce(sum(c) OVER (PARTITION BY metric ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
          FROM hist),
tot AS (SELECT metric, sum(c) AS n, sum(CAST(c AS DOUBLE) * c * c - c) AS tie_term FROM hist GROUP BY metric),
sall AS (SELECT metric, sum(value) AS sum_all FROM long GROUP BY metric),
pt AS (SELECT l.metric, l.topic, count(*) AS n_topic, sum(l.value) AS sum_topic,
              sum(r.below + (r.c + 1) / 2.0) AS rank_sum, median(l.value) AS median_topic
       FROM long l JOIN ranks r ON l.metric = r.metric AND l.value = r.value GROUP BY l.metric, l.topic),
rm AS (SELECT t.metric, t.topic, median(l.value) AS median_rest
       FROM spine t JOIN long l ON l.metric = t.metric AND l.topic <> t.topic
       GROUP BY t.metric, t.topic),
s AS (SELECT spine.topic, spine.metric, coalesce(pt.n_topic, 0) AS n_topic, pt.sum_topic, pt.median_topic,
             tot.n - coalesce(pt.n_topic, 0) AS n_rest, tot.tie_term, sall.sum_all, rm.median_rest,
             pt.rank_sum - pt.n_topic * (pt.n_topic + 1) / 2.0 AS u1
      FROM spine LEFT JOIN pt USING (metric, topic) JOIN tot USING (metric) JOIN sall USING (metric)
        LEFT JOIN rm USING (metric, topic))
SELECT 'events' AS kind, topic AS event_type, metric, CAST(n_topic AS BIGINT) AS n_topic, CAST(n_rest AS BIGINT) AS n_rest,
  round(median_topic, 6) AS median_topic, round(median_rest, 6) AS median_rest,
  round(sum_topic / n_topic, 6) AS mean_topic, round((sum_all - coalesce(sum_topic, 0)) / n_rest, 6) AS mean_rest,
  round(u1, 6) AS u_stat, round(tie_term, 6) AS tie_term,
  round((greatest(u1, n_topic * n_rest - u1) - n_topic * n_rest / 2.0 - 0.5)
        / nullif(sqrt(n_topic * n_rest / 12.0 * ((n_topic + n_rest + 1) - tie_term / ((n_topic + n_rest) * (n_topic + n_rest - 1)))), 0), 6) AS z
FROM s
"""


def _mwu(spark: SparkSession, sf: str, with_p: bool) -> DataFrame:
    ev = _events(spark, sf).withColumn("partial", F.when(F.col("event_type") != "error", F.col("value")))
    return st.topic_vs_rest(ev, "event_type", ["value", "k", "partial"], kind="events", with_p=with_p)


@register("mann_whitney_u", _MWU_SQL)
def q_mann_whitney_u(spark: SparkSession, sf: str) -> DataFrame:
    r = _mwu(spark, sf, with_p=False)
    dbl = ["median_topic", "median_rest", "mean_topic", "mean_rest", "u_stat", "tie_term", "z"]
    return r.select("kind", "event_type", "metric", "n_topic", "n_rest", *[F.round(c, 6).alias(c) for c in dbl])


@register("mann_whitney_p")
def q_mann_whitney_p(spark: SparkSession, sf: str) -> DataFrame:
    """STAT-2 + STAT-5 + SC-17 (no erfc in SQL: rows-only check; pytest compares with a numpy reference)."""
    r = _mwu(spark, sf, with_p=True)
    return r.select("kind", "event_type", "metric", "u_stat", "z", "p_value", "q_value_bh_fdr", "significance")


@register(
    "two_sample_u",
    """
WITH a AS (SELECT value FROM events WHERE event_type = 'view' AND value IS NOT NULL),
b AS (SELECT value FROM events WHERE event_type <> 'view' AND value IS NOT NULL),
l AS (SELECT 'a' AS side, value FROM a UNION ALL SELECT 'b', value FROM b),
r AS (SELECT side, value, avg(rk) OVER (PARTITION BY value) AS mr FROM (SELECT side, value, row_number() OVER (ORDER BY value) AS rk FROM l)),
ties AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS tt FROM (SELECT count(*) AS c FROM l GROUP BY value)),
n AS (SELECT (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2),
u AS (SELECT sum(mr) - n1 * (n1 + 1) / 2.0 AS u1 FROM r, n WHERE side = 'a' GROUP BY n1)
SELECT 'value' AS metric, CAST(n1 AS BIGINT) AS n_videos, CAST(n2 AS BIGINT) AS n_comments,
  round((SELECT median(value) FROM a), 6) AS median_videos, round((SELECT median(value) FROM b), 6) AS median_comments,
  round((SELECT avg(value) FROM a), 6) AS mean_videos, round((SELECT avg(value) FROM b), 6) AS mean_comments,
  round(u1, 6) AS u_stat,
  round((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z
FROM n, u, ties
""",
)
def q_two_sample_u(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events(spark, sf)
    res = st.two_sample_u(ev.filter(F.col("event_type") == "view"), ev.filter(F.col("event_type") != "view"), "value")
    dbl = ["median_videos", "median_comments", "mean_videos", "mean_comments", "u_stat", "z"]
    return res.select("metric", "n_videos", "n_comments", *[F.round(c, 6).alias(c) for c in dbl])


_P_SQL = """
SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day,
  CASE WHEN dayofmonth(ts) = 5 THEN NULL
       ELSE ((CAST(round(sum(value) * 100) AS BIGINT) % 997) + 0.5) / 997.0 END AS p
FROM events GROUP BY event_type, CAST(ts AS DATE), dayofmonth(ts)
"""


@register(
    "bh_fdr",
    f"""
WITH p AS ({_P_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p) AS rk, count(*) OVER (PARTITION BY event_type) AS m
      FROM p WHERE p IS NOT NULL),
q AS (SELECT event_type, day, p,
        least(1.0, min(p * m / rk) OVER (PARTITION BY event_type ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q
      FROM r)
SELECT event_type, day, round(p, 9) AS p, round(q, 9) AS q,
  CASE WHEN q < 0.001 THEN '***' WHEN q < 0.01 THEN '**' WHEN q < 0.05 THEN '*' ELSE '' END AS significance
FROM q
UNION ALL
SELECT event_type, day, NULL, NULL, '' FROM p WHERE p IS NULL
""",
)
def q_bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    day = F.to_date("ts")
    p = ev.groupBy("event_type", day.alias("d")).agg(F.sum("value").alias("s")).select(
        "event_type",
        F.date_format("d", "yyyy-MM-dd").alias("day"),
        F.when(F.dayofmonth("d") == 5, F.lit(None).cast("double"))
        .otherwise(((F.round(F.col("s") * 100).cast("bigint") % 997) + 0.5) / 997.0)
        .alias("p"),
    )
    q = st.bh_fdr(p, "p", ["event_type"], "q")
    return q.select("event_type", "day", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"), significance("q").alias("significance"))


@register(
    "kde_grid",
    """
WITH v AS (SELECT value / 245.0 - 1 AS x FROM events WHERE value IS NOT NULL),
s AS (SELECT count(*) AS n, stddev_samp(x) AS sd, stddev_samp(x) * pow(count(*), -0.2) AS h FROM v),
g AS (SELECT unnest(range(0, 500)) AS idx)
SELECT CAST(idx AS INTEGER) AS idx, round(-1.2 + idx * ((1.1 - (-1.2)) / 499.0), 9) AS x,
  round(sum(exp(-pow(((-1.2 + idx * ((1.1 - (-1.2)) / 499.0)) - x) / h, 2) / 2.0)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM g, v, s WHERE s.n >= 3 AND s.sd > 0 GROUP BY idx
""",
)
def q_kde_grid(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select((F.col("value") / 245.0 - 1).alias("x"))
    d = st.kde_grid(ev, "x")
    return d.select("idx", F.round("x", 9).alias("x"), F.round("density", 6).alias("density"))
