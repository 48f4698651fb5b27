"""End-to-end plans on the sf0.001 tables: prepare → analysis → audit, topic run,
scoring with reuse, quality checks."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.catalog import fixtures as fx
from skein.operators import quality as dq
from skein.operators.relational import count_orphans

SF = "/root/testdata/sf0.001"


def test_prepare_and_analysis(spark, tmpdir_path):
    from skein.plans.analysis import prepare_data, run_analysis

    parents = fx.scored(fx.parents(spark, SF), "parents")
    children = fx.scored(fx.children(spark, SF), "children")
    tables = prepare_data(parents, children, fx.topics(spark, SF), fx.id2topics(spark, SF), max_comments=3)
    sanity = {r.measure: r.value for r in tables["sanity"].collect()}
    assert sanity["unique_comment_id_video"] <= sanity["source_comment_rows"]
    assert sanity["comments_after_cap_3_per_video"] <= sanity["unique_comment_id_video"]
    assert sanity["videos_valid_non_outlier_topics"] <= sanity["videos_with_any_topic"] <= sanity["source_video_rows"]
    written = os.path.join(tmpdir_path, "analysis")
    out = run_analysis(
        tables, year=1996, kind_capped="comments_capped3", id2topics=fx.id2topics(spark, SF), max_comments=3, output=written
    )
    assert set(os.listdir(written)) == set(out) >= {"audit", "topic_table", "top_videos", "quantiles_videos_xlm_polarity"}
    shares = out["video_topic_fractions"].groupBy("year").agg(F.sum("fraction").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-9 for r in shares)
    tests = out["tests_videos"].collect()
    assert tests and all(r.q_value_bh_fdr is None or r.q_value_bh_fdr >= r.p_value - 1e-15 for r in tests)
    assert {(r.topic_id, r.topic_label, r.topic_name) for r in tests} >= {(0, "1", "Sunset")}
    assert out["kde_videos"].count() == 500
    q = out["quantiles_videos_xlm_polarity"].collect()
    assert all(r.q01 <= r.q50 <= r.q99 for r in q if r.q01 is not None)
    audit = {r.measure: r.value for r in out["audit"].collect()}
    assert "top5_raw" in audit and audit["max_comments_per_video"] == "3"


def test_duplicate_topic_key_raises(spark):
    from skein.plans.analysis import prepare_data

    topics = fx.topics(spark, SF)
    dup = topics.unionByName(topics.limit(1))
    with pytest.raises(ValueError):
        prepare_data(fx.parents(spark, SF), fx.children(spark, SF), dup, fx.id2topics(spark, SF))


def test_quality_checks(spark):
    empty = spark.createDataFrame([], "id STRING")
    with pytest.raises(ValueError):
        dq.require_not_empty(empty, "empty")
    with pytest.raises(ValueError):
        dq.require_columns(empty, ["id", "missing"], "t")
    kids = spark.createDataFrame([("1", "a"), ("2", "zz")], "id STRING, video_id STRING")
    par = spark.createDataFrame([("a",)], "id STRING")
    assert count_orphans(kids, par, "video_id", "id").first().orphans == 1
    with pytest.raises(ValueError):
        dq.assert_no_orphans(kids, par, "video_id", "id")


def test_topic_run(spark):
    from skein.plans.topic_run import run_topics

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text")
    out = run_topics(docs, n_topics=4, embed_dim=16, reduce_k=4, min_cluster=2, top_n=5)
    assign = out["topic_assignments"].collect()
    assert len(assign) == out["topic_docs"].count()
    sizes = {}
    for r in assign:
        sizes[r.topic_id] = sizes.get(r.topic_id, 0) + 1
    valid = sorted((k for k in sizes if k >= 0))
    assert valid == list(range(len(valid)))
    assert all(sizes[valid[i]] >= sizes[valid[i + 1]] for i in range(len(valid) - 1))  # ids by size
    assert out["keyword_scores"].filter("rank > 5").count() == 0


def test_scoring_plan_reuse(spark, tmpdir_path):
    from skein.operators.scoring import hashed_linear_model
    from skein.plans.scoring import process_table

    src = os.path.join(tmpdir_path, "in.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("processed_text"), F.lit("u").alias("username")
    ).write.parquet(src)
    out_p, red_p = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "red")
    lex = {"the": 1.0, "and": -1.0}
    a = process_table(spark, src, out_p, red_p, sentiment_factory=hashed_linear_model(3, seed=1), lexicon=lex)
    assert {"xlm_polarity", "vader_compound"} <= set(a.columns)
    assert "username" not in spark.read.parquet(red_p).columns
    mtime = os.path.getmtime(out_p)
    b = process_table(spark, src, out_p, red_p, reuse=True, sentiment_factory=hashed_linear_model(3, seed=1), lexicon=lex)
    assert os.path.getmtime(out_p) == mtime and b.count() == a.count()


def test_only_unseen_texts_are_scored(spark, tmpdir_path):
    from skein.operators.scoring import score_frame
    from skein.plans.scoring import score_unseen

    calls = spark.sparkContext.accumulator(0)

    def counting():
        def predict(texts):
            calls.add(len(texts))
            return np.array([[len(t), 1.0, 0.0] for t in texts], np.float32)

        return predict

    def run(rows, model="m/1"):
        before = calls.value
        df = spark.createDataFrame(rows, "id INT, processed_text STRING, vader_pos DOUBLE, __scores2 INT")
        out = score_unseen(df, "processed_text", store, model, sentiment_factory=counting, lexicon={"good": 1.0})
        got = sorted(map(tuple, out.collect()), key=repr)
        want = score_frame(df, "processed_text", sentiment_factory=lambda: lambda texts: np.array(
            [[len(t), 1.0, 0.0] for t in texts], np.float32), lexicon={"good": 1.0}).select(*out.columns)
        assert got == sorted(map(tuple, want.collect()), key=repr)
        return calls.value - before

    store = os.path.join(tmpdir_path, "scores")
    rows = [(i, f"text {i % 10} good", 9.0, i) for i in range(30)] + [(None, None, None, None), (1, "", 1.0, 1), (1, "", 1.0, 1)]
    assert run(rows) == 11  # ten texts and the empty one, once each
    assert run(rows) == 0
    assert run([*rows, (5, "new", 0.0, 0), (6, "new", 0.0, 0)]) == 1
    assert run(rows, "m/2") == 11  # another model shares nothing
    assert run([]) == 0
    # a text that two runs have stored gives no row twice
    spark.read.parquet(os.path.join(store, "model=m%2F1")).limit(5).write.mode("append").parquet(os.path.join(store, "model=m%2F1"))
    assert run(rows) == 0


def test_density_topics_separates_planted_blobs(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    from skein.operators.topics import density_topics

    rng = np.random.default_rng(0)
    a = rng.normal(0, 0.05, size=(150, 3))
    b = rng.normal(5, 0.05, size=(150, 3))
    noise = np.array([[20.0, -20.0, 20.0]])
    pts = np.vstack([a, b, noise])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id INT, v ARRAY<DOUBLE>")
    feats = df.select("id", array_to_vector("v").alias("features"))
    got = {r.id: r.topic_id for r in density_topics(feats, "id", micro_k=12, min_points=3, min_size=20).collect()}
    ta = {got[i] for i in range(150)}
    tb = {got[i] for i in range(150, 300)}
    assert len(ta) == 1 and len(tb) == 1 and ta != tb and -1 not in ta | tb
    assert got[300] == -1  # isolated point: outlier
