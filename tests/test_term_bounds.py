"""Best terms by bounds against scores of all terms."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import keywords as kw
from skein.operators import term_bounds as tb


def _docs(spark, seed: int):
    """Three topics of unequal size: shared frequent words, own words, rare words."""
    rng = random.Random(seed)
    letters = "abcdefghij"
    own = {t: ["".join(rng.choices(letters, k=4)) for _ in range(12)] for t in range(3)}
    shared = ["".join(rng.choices(letters, k=3)) for _ in range(20)]
    rows = []
    for i in range(150):
        t = rng.choices((0, 1, 2), (8, 3, 1))[0]
        words = [rng.choice(rng.choice((own[t], shared, ["".join(rng.choices(letters, k=6))]))) for _ in range(25)]
        rows.append((t, " ".join(words)))
    rows += [(None, "null topic here"), (-1, "outlier words"), (0, None), (1, ""), (2, "x")]
    return spark.createDataFrame(rows, "topic int, body string").repartition(3)


def _rows(df):
    return sorted((r["topic"], r["rank"], r["term"], round(r["z_score"], 9)) for r in df.collect())


@pytest.mark.parametrize("buckets", [64, 1 << 16])
@pytest.mark.parametrize("share", [0.5, 50.0])  # 50: far too few buckets in the first round, so the second one must mend it
def test_equal_to_all_scores(spark, monkeypatch, buckets, share):
    monkeypatch.setattr(tb, "GUESS_SHARE", share)
    df = _docs(spark, 1)
    want = kw.top_terms(kw.log_odds_scores(df, "topic", "body"), 7).select("topic", "rank", "term", "z_score")
    words = kw._topic_words(df, "topic", "body", "words").cache()
    got = tb.bounded_top_terms(words, 7, kw.log_odds_z, kw.top_terms, buckets)
    assert _rows(got) == _rows(want)


def test_fewer_terms_than_asked_and_empty(spark):
    df = spark.createDataFrame([("a", "one two one"), ("b", "three")], "topic string, body string")
    want = kw.top_terms(kw.log_odds_scores(df, "topic", "body"), 50).select("topic", "rank", "term", "z_score")
    terms, keywords = kw.log_odds_keywords(df, "topic", "body", 50)
    assert _rows(terms) == _rows(want)
    assert {r["topic"]: len(r["keywords"].split(", ")) for r in keywords.collect()} == {"a": 5, "b": 1}
    assert kw.log_odds_keywords(df.where("false"), "topic", "body", 5)[0].isEmpty()


def test_bound_holds(spark):
    """No (f, F) below a bucket's counts has a score above its bound."""
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        n_i = rng.choice((5, 200, 40_000))
        big_n = n_i + rng.choice((1, 300, 90_000))
        c = min(n_i, rng.choice((1, 3, 50, 9_000)))
        total = c + min(big_n - n_i, rng.choice((0, 2, 100, 20_000)))
        f = rng.randint(1, c)
        rows.append((c, total, n_i, big_n, f, f + rng.randint(0, total - c)))
    df = spark.createDataFrame(rows, "c long, total long, n_i long, big_n long, f long, big_f long")
    bound = tb.score_bound(*map(F.col, ("c", "total", "n_i", "big_n")))
    z = kw.log_odds_z(*map(F.col, ("f", "big_f", "n_i", "big_n")))
    found = df.select(bound.alias("bound"), z.alias("z")).collect()
    assert all(math.isfinite(r["bound"]) and r["bound"] >= r["z"] - 1e-9 for r in found)
    assert any(r["bound"] < 1.5 * r["z"] for r in found)  # and is no empty promise


def test_rare_terms_are_not_counted_as_strings(spark, monkeypatch):
    counted = []
    exact = tb._exact
    monkeypatch.setattr(tb, "_exact", lambda *a: counted.append(exact(*a)) or counted[-1])
    df = _docs(spark, 2)
    terms, _ = kw.log_odds_keywords(df, "topic", "body", 3)
    every = kw.term_counts(df, "topic", "body").select("term").distinct().count()
    assert terms.count() == 9
    assert sum(c.select("term").distinct().count() for c in counted) < every / 2


def test_no_row_per_ngram(spark, monkeypatch):
    """Tasks count n-grams in arrays: no count explodes its text into a row per n-gram."""
    plans = []
    cut = tb.cut_lineage
    monkeypatch.setattr(tb, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    kw.log_odds_keywords(_docs(spark, 4), "topic", "body", 3)[0].collect()
    assert plans and not any("Generate" in p for p in plans)


@pytest.mark.parametrize("held", [1, 64])
def test_odd_spaces_and_many_topics(spark, monkeypatch, held):
    """Words are those between single spaces, as the published n-grams have them; held counts are flushed without loss."""
    monkeypatch.setattr(tb, "HELD", held)
    rows = [("a", "one two  three one"), ("b", ""), ("b", None), ("c", " one two three "), ("d", "é one é"), ("a", "one two")]
    df = spark.createDataFrame(rows, "topic string, words string").coalesce(1)
    every = tx.explode_tokens(df, ["topic"], tx.spaced_ngrams("words")).groupBy("topic", "term").count()
    want = sorted(tuple(r) for r in every.collect())
    got = tb._exact(df, spark.range(32).select(F.col("id").cast("int").alias("bucket")), 32)
    assert sorted(tuple(r) for r in got.collect()) == want
    counts = tb._bucket_counts(df, 32).groupBy("topic").agg(F.sum("c")).collect()
    totals: dict[str, int] = {}
    for topic, _, n in want:
        totals[topic] = totals.get(topic, 0) + n
    assert dict(map(tuple, counts)) == totals
