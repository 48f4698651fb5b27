"""Edge rows from FIXTURES.md §3 for statistics, series and scalar helpers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from skein.functions import scalar as sc
from skein.operators import stats as st
from skein.operators import timeseries as ts


def _two_topics(spark, a, b):
    rows = [(0, v) for v in a] + [(1, v) for v in b]
    return spark.createDataFrame(rows, "topic INT, m DOUBLE")


def test_all_tied_gives_nan_p(spark):
    r = {x.topic: x for x in st.topic_vs_rest(_two_topics(spark, [1.0] * 5, [1.0] * 6), "topic", ["m"]).collect()}
    assert r[0].u_stat == pytest.approx(15.0)  # n1·n2 / 2
    assert r[0].p_value is None or math.isnan(r[0].p_value)  # zero variance: no test


def test_small_side_gives_null(spark):
    r = {x.topic: x for x in st.topic_vs_rest(_two_topics(spark, [1.0], [2.0, 3.0, 4.0]), "topic", ["m"]).collect()}
    assert r[0].n_topic == 1 and r[0].u_stat is None and r[0].p_value is None
    assert r[0].median_topic == 1.0 and r[0].median_rest == 3.0


def test_non_finite_values_dropped(spark):
    a = [1.0, float("nan"), float("inf"), 2.0, 3.0]
    b = [float("-inf"), 4.0, 5.0, 6.0]
    r = {x.topic: x for x in st.topic_vs_rest(_two_topics(spark, a, b), "topic", ["m"]).collect()}
    assert (r[0].n_topic, r[0].n_rest) == (3, 3)
    assert r[0].u_stat == 0.0  # disjoint samples
    # exact branch (≤ 8 per side, no ties): p = 2 / C(6, 3)
    assert r[0].p_value == pytest.approx(2 / 20)


def test_bh_edges(spark):
    df = spark.createDataFrame([("a", 0.02), ("a", 0.02), ("b", 1.0), ("c", None)], "k STRING, p DOUBLE")
    got = {(r.k, r.p): r.q for r in st.bh_fdr(df, "p", ["k"], "q").collect()}
    assert got[("a", 0.02)] == pytest.approx(0.02)
    assert got[("b", 1.0)] == 1.0
    assert got[("c", None)] is None


def test_significance_labels(spark):
    vals = [0.0005, 0.005, 0.03, 0.05, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i INT, q DOUBLE")
    got = [r.s for r in df.select("i", sc.significance("q").alias("s")).orderBy("i").collect()]
    assert got == ["***", "**", "*", "", "", "", ""]


def test_daily_activity_edges(spark):
    def epoch(s):
        import calendar
        import datetime as dt

        return calendar.timegm(dt.datetime.fromisoformat(s).timetuple())

    parents = spark.createDataFrame(
        [("p1", epoch("2023-10-15 23:59:59")), ("p2", epoch("2023-05-01 10:00:00"))], "id STRING, create_time BIGINT"
    )
    children = spark.createDataFrame(
        [
            ("c1", "p2", epoch("2023-10-15 23:59:59")),  # last second of the window
            ("c2", "p2", epoch("2023-10-16 00:00:00")),  # outside (half-open end)
            ("c3", "p2", epoch("2024-05-01 00:00:00")),  # a year after its parent: parent's year only
            ("c4", "nobody", epoch("2023-05-01 00:00:00")),  # orphan
        ],
        "id STRING, video_id STRING, create_time BIGINT",
    )
    out = {(r.year, r.date): r for r in ts.daily_activity(parents, children).collect()}
    assert len(out) == 2 * 184
    assert out[(2023, "2023-10-15")].unique_posts == 1 and out[(2023, "2023-10-15")].comments == 1
    assert out[(2023, "2023-10-15")].unique_users_posts == 0  # no username column
    assert sum(r.comments for r in out.values()) == 1


def test_softmax_and_label(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0, 0.0],), ([1000.0, 0.0, 0.0],)], "l ARRAY<DOUBLE>")
    rows = df.select(sc.softmax3("l").alias("p")).select("p", sc.argmax_label("p").alias("lab"), sc.max_probability("p").alias("m")).collect()
    e = [math.exp(x - 3) for x in (1, 2, 3)]
    assert rows[0].p == pytest.approx([v / sum(e) for v in e])
    assert rows[1].lab == "xlm_negative"  # first on ties
    assert rows[2].m == pytest.approx(1.0)


def test_ids_and_numbers(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1234567890123456789.0, "7.0", "abc"), (7.5, "12", None), (None, None, "3")], "d DOUBLE, s STRING, x STRING")
    rows = df.select(
        sc.normalize_id("d", T.DoubleType()).alias("a"), sc.normalize_id("s", T.StringType()).alias("b"), sc.to_number("x").alias("n")
    ).collect()
    assert rows[0].a == "1234567890123456768" and rows[0].b == "7"
    assert rows[1].a == "7.5" and rows[1].b == "12"
    assert rows[2].a is None and rows[2].n == 3.0 and rows[0].n is None


def test_collection_plan_window_check(spark):
    from skein.plans.collection import collection_plan

    plan = collection_plan(spark, [2024], "04-15", "04-17", runs=2)
    assert plan.count() == 6
    assert sorted(r.api_date for r in plan.select("api_date").distinct().collect()) == ["20240415", "20240416", "20240417"]
    with pytest.raises(ValueError):
        collection_plan(spark, [2024], "06-15", "04-15")


def test_quantile_table_spine(spark):
    df = spark.createDataFrame([(0, float(v)) for v in range(11)], "topic_id INT, m DOUBLE")
    spine = spark.createDataFrame([(0,), (1,)], "topic_id INT")
    rows = {r.topic_id: r for r in st.quantile_table(st.long_metrics(df, ["topic_id"], ["m"]), "topic_id", spine=spine).collect()}
    assert rows[0].q50 == 5.0 and rows[0].q10 == pytest.approx(1.0) and rows[0].q99 == pytest.approx(9.9)
    assert rows[1].q50 is None  # topic without values completes the table
    assert F is not None
