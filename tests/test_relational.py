"""Dedupe, cap, topic joins, membership, dense index, sparse-date fixed point."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from skein.operators import export as ex
from skein.operators import relational as rel


def test_dedupe_keep_first_uses_file_order(spark):
    rows = [
        ("a", "v1", "f1.json", 0, "first"),
        ("a", "v1", "f1.json", 1, "second"),
        ("a", "v1", "f0.json", 5, "earliest-file"),
        (None, "v1", "f1.json", 2, "null-key-1"),
        (None, "v1", "f1.json", 3, "null-key-2"),
        ("b", "v2", "f2.json", 0, "only"),
    ]
    df = spark.createDataFrame(rows, "id STRING, video_id STRING, source_file STRING, pos LONG, text STRING")
    out = {(r.id, r.video_id): r.text for r in rel.dedupe_keep_first(df, ["id", "video_id"], ["source_file", "pos"]).collect()}
    assert out == {("a", "v1"): "earliest-file", (None, "v1"): "null-key-1", ("b", "v2"): "only"}


def test_min_signal_before_dedupe_keeps_later_duplicate(spark):
    from skein.plans.preprocess import preprocess_children

    rows = [("1", "v", "a", "f", 0), ("1", "v", "long enough", "f", 1)]
    df = spark.createDataFrame(rows, "id STRING, video_id STRING, text STRING, source_file STRING, pos LONG")
    out = preprocess_children(df, dedupe=True, min_chars=3).collect()
    assert [r.text for r in out] == ["long enough"]


def _md5_order(seed, ids):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), str(i)))


@pytest.mark.parametrize("cap", [0, -1, 4, 5, 6])
def test_cap_per_parent(spark, cap):
    sizes = {"p0": 0, "p4": 4, "p5": 5, "p6": 6, "hot": 60}
    rows = [(p, f"{p}-{i}") for p, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "video_id STRING, id STRING")
    got = rel.cap_per_parent(df, "video_id", "id", cap, 42, salts=4)
    again = rel.cap_per_parent(df.repartition(5), "video_id", "id", cap, 42, salts=7)
    g1 = sorted((r.video_id, r.id) for r in got.collect())
    g2 = sorted((r.video_id, r.id) for r in again.collect())
    assert g1 == g2
    for p, n in sizes.items():
        ids = [f"{p}-{i}" for i in range(n)]
        expect = ids if cap <= 0 else _md5_order(42, ids)[:cap]
        assert sorted(i for v, i in g1 if v == p) == sorted(expect)


def test_topic_metadata_and_names(spark):
    id2 = spark.createDataFrame([(0, "a, b"), (1, "c"), (16, "z")], "topic_id INT, topic STRING")
    topics = spark.createDataFrame([("p1", 0), ("p2", -1), ("p3", 16), ("p4", 20), ("p5", None)], "id STRING, topic INT")
    parents = spark.createDataFrame([(x,) for x in ["p1", "p2", "p3", "p4", "p5", "p6"]], "id STRING")
    out = {r.id: r for r in rel.attach_parent_topics(parents, topics, id2).collect()}
    assert (out["p1"].topic_keywords, out["p1"].topic_label, out["p1"].topic_name) == ("a, b", "1", "Sunset")
    assert (out["p2"].topic_keywords, out["p2"].topic_label, out["p2"].topic_name) == ("Outlier", "0", "Outlier")
    assert (out["p3"].topic_name, out["p3"].topic_keywords) == ("Topic 17", "z")
    assert out["p4"].topic_name == "Outlier"  # beyond the name list (D-11)
    assert (out["p5"].topic_label, out["p6"].topic_label, out["p6"].topic_name) == ("", "", "Outlier")
    names = rel.topic_names(spark.createDataFrame([(-1, "x")], "topic_id INT, topic STRING"))
    assert names.count() == 15


def test_child_inherits_parent_topic(spark):
    id2 = spark.createDataFrame([(0, "a")], "topic_id INT, topic STRING")
    topics = spark.createDataFrame([("p1", 0)], "id STRING, topic INT")
    kids = spark.createDataFrame([("c1", "p1"), ("c2", "missing")], "id STRING, video_id STRING")
    out = {r.id: r.topic_id for r in rel.attach_child_topics(kids, topics, id2).collect()}
    assert out == {"c1": 0, "c2": None}


def test_dense_index_is_consecutive(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k"))
    idx = rel.dense_index(df, ["k", "id"], "row_index", partitions=6).collect()
    got = sorted((r.k, r.id, r.row_index) for r in idx)
    assert [r[2] for r in got] == list(range(1000))


def test_search_filter(spark):
    rows = [("Stress at work", ["x"], "US"), ("nostress", ["Anxiety"], "US"), ("stress", [], "DE"), ("none", None, "US")]
    df = spark.createDataFrame(rows, "video_description STRING, hashtag_names ARRAY<STRING>, region_code STRING")
    out = rel.search_filter(df, ["stress", "anxiety"], regions=["US"]).collect()
    assert sorted(r.video_description for r in out) == ["Stress at work", "nostress"]
    with pytest.raises(ValueError):
        rel.search_filter(df, ["x"], include_keyword=False, include_hashtag=False)


def _sparse_py(videos, comments, k):
    v, c = list(videos), list(comments)
    passes = 0
    while True:
        passes += 1
        counts = {}
        for _, d in v:
            counts[d] = counts.get(d, 0) + 1
        for _, _, d in c:
            counts[d] = counts.get(d, 0) + 1
        ok = {d for d, n in counts.items() if d is not None and n >= k}
        v2 = [x for x in v if x[1] in ok]
        ids = {x[0] for x in v2}
        c2 = [x for x in c if x[2] in ok and x[1] in ids]
        if len(v2) == len(v) and len(c2) == len(c):
            return v2, c2, passes
        v, c = v2, c2


def test_sparse_dates_cascade(spark):
    videos = [("a", "d1"), ("b", "d1"), ("c", "d2"), ("d", None)]
    comments = [("1", "a", "d1"), ("2", "c", "d1"), ("3", "c", "d2"), ("4", "c", "d2"), ("5", "b", "d3")]
    vdf = spark.createDataFrame(videos, "id STRING, date STRING")
    cdf = spark.createDataFrame(comments, "id STRING, video_id STRING, date STRING")
    for k in (1, 2, 3, 4, 9):
        v2, c2, passes = ex.filter_sparse_dates(vdf, cdf, k)
        pv, pc, pp = _sparse_py(videos, comments, k)
        assert sorted(tuple(r) for r in v2.select("id", "date").collect()) == sorted(pv)
        assert sorted(tuple(r) for r in c2.select("id", "video_id", "date").collect()) == sorted(pc)
        assert passes == pp
        # fixed point: another pass changes nothing
        v3, c3, p3 = ex.filter_sparse_dates(v2, c2, k)
        assert (v3.count(), c3.count(), p3) == (v2.count(), c2.count(), 1)


def test_sorted_topic_ids(spark):
    df = spark.createDataFrame([(3,), (1,), (-1,), (None,), (1,)], "topic_id INT")
    assert [r.topic_id for r in rel.sorted_topic_ids(df).collect()] == [1, 3]
