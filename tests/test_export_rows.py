"""PIPE-6 on odd rows against plain loops, and what the build moves and writes."""

from __future__ import annotations

import os
from collections import Counter

from pyspark.sql import functions as F

from skein.constants import CHILD_EXPORT_COLUMNS, SENTIMENT_COLUMNS, TOXICITY_COLUMNS
from skein.operators.export import build_exports, validate_exports
from skein.operators.relational import running_total
from skein.session import ensure_checkpoint_dir

DAY = 86_400
SCORES = [*TOXICITY_COLUMNS, *SENTIMENT_COLUMNS]


def _scored(df):
    return df.select("*", *(F.lit("xlm_neutral").alias(c) if c == "xlm_sentiment" else (F.col("n") / 10).alias(c) for c in SCORES))


def _tables(spark):
    videos = [(f"v{i}", i % 7 * DAY if i % 11 else None, "t", i) for i in range(60)] + [("v3", 0, "t", 5)]
    comments = [(f"c{i % 9}", f"v{i % 70}" if i % 13 else None, i * 37 % 9 * DAY if i % 17 else None, i) for i in range(400)]
    comments += [(None, "v1", DAY, 7), (None, "v1", DAY, 6), ("c1", "v1", 2 * DAY, 1), ("c1", "v1", None, 3), ("c1", None, DAY, 3)]
    v = _scored(spark.createDataFrame(videos, "id STRING, create_time LONG, topic_name STRING, n LONG"))
    return videos, comments, v, _scored(spark.createDataFrame(comments, "id STRING, video_id STRING, create_time LONG, n LONG"))


def _low(x):
    return (x is not None, x)


def _plain(videos, comments, least):
    v, c = {}, {}
    for id_, time, topic, n in sorted(videos, key=lambda r: (_low(r[1]), r[2], r[3])):
        v.setdefault(id_, (time, n))
    for id_, video, time, n in sorted(comments, key=lambda r: (_low(r[2]), r[3])):
        c.setdefault((video, id_), (time, n))
    while True:
        per = Counter(t // DAY for t, _ in [*v.values(), *c.values()] if t is not None)
        ok = {d for d, n in per.items() if n >= least}
        v2 = {k: r for k, r in v.items() if r[0] is not None and r[0] // DAY in ok}
        c2 = {k: r for k, r in c.items() if r[0] is not None and r[0] // DAY in ok and k[0] in v2}
        if (len(v2), len(c2)) == (len(v), len(c)):
            break
        v, c = v2, c2
    index = {k: i for i, k in enumerate(sorted(v, key=lambda k: (v[k][0], k)))}
    rows = [(index[k[0]], i, c[k][1] / 10) for i, k in enumerate(sorted(c, key=lambda k: (k[0], _low(k[1]))))]
    return {(i, v[k][1] / 10) for k, i in index.items()}, set(rows)


def test_exports_of_odd_rows(spark):
    videos, comments, v, c = _tables(spark)
    folder = ensure_checkpoint_dir(spark)
    before = set(os.listdir(folder.removeprefix("file:")))
    ve, ce, _ = build_exports(v, c, 12)
    want_v, want_c = _plain(videos, comments, 12)
    assert len(want_v) > 10 and len(want_c) > 50
    assert {(r["video_index"], r["xlm_polarity"]) for r in ve.collect()} == want_v
    got = ce.select("video_index", "comment_index", "xlm_polarity").collect()
    assert len(got) == len(want_c) and {tuple(r) for r in got} == want_c
    assert ce.columns == CHILD_EXPORT_COLUMNS
    assert all(r["failures"] == 0 for r in validate_exports(ve, ce, 12).collect())
    # the children's scores are written nowhere on the way
    for name in set(os.listdir(folder.removeprefix("file:"))) - before:
        if name.startswith("cut-"):
            columns = spark.read.parquet(f"{folder}/{name}").columns
            assert not {"video_id", "detoxify_toxicity"} <= set(columns)


def test_comment_order_by_other_columns(spark):
    _, _, v, c = _tables(spark)
    _, by_parent, _ = build_exports(v, c, 12)
    _, by_id, _ = build_exports(v, c, 12, comment_order=("id", "video_id"))
    index, rows = (sorted(r[0] for r in df.select("comment_index").collect()) for df in (by_parent, by_id))
    assert rows == index == list(range(len(index)))
    kept = [Counter(map(tuple, df.drop("comment_index").collect())) for df in (by_parent, by_id)]
    assert kept[0] == kept[1]


def test_running_total(spark):
    rows = [(f"k{i:03d}" if i else None, i % 5) for i in range(200)]
    out = running_total(spark.createDataFrame(rows, "k STRING, n LONG"), ["k"], "n", "before").collect()
    want, total = {}, 0
    for k, n in sorted(rows, key=lambda r: _low(r[0])):
        want[k], total = total, total + n
    assert {r["k"]: r["before"] for r in out} == want
