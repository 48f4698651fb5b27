"""Statistics against numpy brute force (scipy is not installed)."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import stats as st


def midranks(values):
    order = np.argsort(values, kind="mergesort")
    ranks = np.empty(len(values))
    sorted_v = np.asarray(values)[order]
    i = 0
    while i < len(values):
        j = i
        while j + 1 < len(values) and sorted_v[j + 1] == sorted_v[i]:
            j += 1
        ranks[order[i : j + 1]] = (i + j) / 2 + 1
        i = j + 1
    return ranks


def brute_u(x, y):
    r = midranks(np.concatenate([x, y]))
    return r[: len(x)].sum() - len(x) * (len(x) + 1) / 2


def exact_p_bruteforce(x, y):
    """Two-sided exact p by enumerating all splits (tiny samples, no ties)."""
    both = np.concatenate([x, y])
    n1 = len(x)
    u_obs = brute_u(x, y)
    u_big = max(u_obs, n1 * len(y) - u_obs)
    us = []
    for idx in itertools.combinations(range(len(both)), n1):
        mask = np.zeros(len(both), bool)
        mask[list(idx)] = True
        us.append(brute_u(both[mask], both[~mask]))
    us = np.array(us)
    return min(1.0, 2 * np.mean(us >= u_big))


def test_exact_p_matches_enumeration():
    rng = np.random.default_rng(1)
    for n1, n2 in [(3, 4), (5, 6), (2, 7)]:
        v = rng.permutation(n1 + n2).astype(float)
        x, y = v[:n1], v[n1:]
        u = brute_u(x, y)
        assert st.mwu_p_value(u, n1, n2, 0.0) == pytest.approx(exact_p_bruteforce(x, y), abs=1e-12)


def test_asymptotic_p_formula():
    u, n1, n2, ties = 120.0, 20, 15, 24.0
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    assert st.mwu_p_value(u, n1, n2, ties) == pytest.approx(math.erfc(z / math.sqrt(2)))


def _events_like(spark, n=3000, seed=5):
    rng = np.random.default_rng(seed)
    topics = rng.integers(0, 5, n)
    vals = np.round(rng.gamma(2.0, 1.0, n) + topics * 0.1, 1)  # many ties
    vals[::97] = np.nan
    rows = [(int(t), float(v) if not np.isnan(v) else None) for t, v in zip(topics, vals)]
    return spark.createDataFrame(rows, "topic INT, m DOUBLE"), topics, vals


def test_topic_vs_rest_matches_brute_force(spark):
    df, topics, vals = _events_like(spark)
    res = {r.topic: r for r in st.topic_vs_rest(df, "topic", ["m"], kind="t").collect()}
    ok = ~np.isnan(vals)
    for t in range(5):
        x = vals[ok & (topics == t)]
        y = vals[ok & (topics != t)]
        r = res[t]
        assert r.n_topic == len(x) and r.n_rest == len(y)
        assert r.u_stat == pytest.approx(brute_u(x, y))
        assert r.median_topic == pytest.approx(np.median(x))
        assert r.median_rest == pytest.approx(np.median(y))
        assert r.mean_rest == pytest.approx(np.mean(y))
        assert 0.0 <= r.p_value <= 1.0
        assert r.q_value_bh_fdr >= r.p_value - 1e-15
    assert sum(res[t].u_stat + (res[t].n_topic * res[t].n_rest - res[t].u_stat) for t in range(5)) == pytest.approx(
        sum(res[t].n_topic * res[t].n_rest for t in range(5))
    )


def test_ranked_histogram_many_partitions(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 400, 5000).astype(float)
    grp = rng.integers(0, 3, 5000)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(grp, vals)], "g INT, value DOUBLE")
    h = st.ranked_histogram(df, ["g"], partitions=7).collect()
    for r in h:
        sel = vals[grp == r.g]
        assert r.below == int((sel < r.value).sum())
        assert r.c == int((sel == r.value).sum())


def test_exact_quantiles_match_numpy(spark):
    df, topics, vals = _events_like(spark, 2000, 9)
    long = st.long_metrics(df, ["topic"], ["m"])
    q = st.exact_quantiles(long, ["topic"], [0.01, 0.1, 0.5, 0.9, 0.99]).collect()
    ok = ~np.isnan(vals)
    for r in q:
        assert r.value == pytest.approx(np.quantile(vals[ok & (topics == r.topic)], r.q))


def test_bh_fdr_matches_numpy(spark):
    p = [0.01, 0.04, 0.04, None, float("nan"), 0.5, 0.03, 1.0, 0.001]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i INT, p DOUBLE").withColumn("k", F.lit("a"))
    got = {r.i: r.q for r in st.bh_fdr(df, "p", ["k"], "q").collect()}
    arr = np.array([np.nan if v is None else v for v in p])
    ok = np.isfinite(arr)
    ps = arr[ok]
    order = np.argsort(ps)
    ranks = np.arange(1, len(ps) + 1)
    qs = np.minimum.accumulate((ps[order] * len(ps) / ranks)[::-1])[::-1].clip(0, 1)
    expect = np.full(len(arr), np.nan)
    tmp = np.empty(len(ps))
    tmp[order] = qs
    expect[ok] = tmp
    for i, e in enumerate(expect):
        if np.isnan(e):
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(e)


def test_kde_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 0.4, 3000), 3)
    df = spark.createDataFrame([(float(v),) for v in x], "x DOUBLE")
    got = np.array([r.density for r in st.kde_grid(df, "x").orderBy("idx").collect()])
    grid = np.linspace(-1.2, 1.1, 500)
    h = x.std(ddof=1) * len(x) ** (-0.2)
    expect = np.exp(-((grid[:, None] - x[None, :]) / h) ** 2 / 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert np.allclose(got, expect, rtol=1e-9, atol=1e-12)


def test_kde_skipped_for_constant(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "x DOUBLE")
    assert st.kde_grid(df, "x").count() == 0


def test_two_sample(spark):
    a = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 10]], "m DOUBLE")
    b = spark.createDataFrame([(float(v),) for v in [5, 6, 7, 8, 9, 11]], "m DOUBLE")
    r = st.two_sample_u(a, b, "m").first()
    assert r.u_stat == pytest.approx(brute_u(np.array([1, 2, 3, 4, 10.0]), np.array([5, 6, 7, 8, 9, 11.0])))
    assert r.median_videos == 3 and r.median_comments == 7.5
    assert r.q_value_bh_fdr == r.p_value


def test_ranked_histogram_hot_group_across_small_batches(spark):
    """A group with a third of all rows spans many Arrow batches and partitions."""
    rng = np.random.default_rng(8)
    n = 6000
    grp = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 4, n))
    vals = rng.integers(0, 2500, n).astype(float)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(grp, vals)], "g INT, value DOUBLE")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rows = st.ranked_histogram(df, ["g"], partitions=5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for r in rows:
        sel = vals[grp == r.g]
        assert r.below == int((sel < r.value).sum()), (r.g, r.value)
        assert r.c == int((sel == r.value).sum())


@pytest.mark.parametrize(
    "values",
    [
        [0.5] * 2_000 + [-0.3, 0.1, 0.7, None, float("nan")],  # nearly all rows hold one value
        [1e200, -1e200, 0.0],  # a bandwidth far wider than the grid
        [50.0 + i * 1e-3 for i in range(40)],  # everything lies beyond the grid's reach
        [-1.2, 1.1, -1.2, 1.1, 0.0],  # on the grid's ends
        [float(v) for v in np.random.default_rng(4).normal(-0.1, 0.4, 3_000)] + [900.0],
    ],
)
def test_kde_cells_equal_the_direct_sum(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    got = np.array([r.density for r in st.kde_grid(df, "x").orderBy("idx").collect()])
    x = np.array([v for v in values if v is not None and np.isfinite(v)])
    h = np.sqrt(np.mean((x / np.abs(x).max() - (x / np.abs(x).max()).mean()) ** 2) * len(x) / (len(x) - 1)) * np.abs(x).max() * len(x) ** -0.2
    grid = np.linspace(-1.2, 1.1, 500)
    want = np.exp(-(((grid[:, None] - x) / h) ** 2) / 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.abs(got - want).max() <= 1e-9 * max(1.0, 1 / h)
    if h < 1e100:
        assert got.sum() == pytest.approx(want.sum(), rel=1e-9, abs=1e-12)
