"""SET-4 against a plain loop over rows: cascades, repeated ids, nulls, orphans, ties, empty tables."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from skein.operators.export import filter_sparse_dates

V, C = "id STRING, date STRING, row INT", "video_id STRING, date STRING, row INT"


def plain(videos, comments, least):
    passes = 0
    while True:
        passes += 1
        n = Counter(d for _, d, _ in videos + comments if d is not None)
        v = [r for r in videos if r[1] is not None and n[r[1]] >= least]
        ids = {r[0] for r in v if r[0] is not None}
        c = [r for r in comments if r[1] is not None and n[r[1]] >= least and r[0] in ids]
        if (len(v), len(c)) == (len(videos), len(comments)):
            return v, c, passes
        videos, comments = v, c


def check(spark, videos, comments, least):
    v, c, passes = filter_sparse_dates(spark.createDataFrame(videos, V), spark.createDataFrame(comments, C), least)
    assert (v.columns, c.columns) == (["id", "date", "row"], ["video_id", "date", "row"])
    want = plain(videos, comments, least)
    assert ({r.row for r in v.collect()}, {r.row for r in c.collect()}) == tuple({r[2] for r in part} for part in want[:2])
    assert (v.count(), c.count(), passes) == (len(want[0]), len(want[1]), want[2])
    return passes


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    days = [f"2024-05-{d:02d}" for d in range(1, 21)]
    ids = [None, *(f"v{i}" for i in range(60))]
    videos = [(rng.choice(ids), rng.choice([None, *days]), i) for i in range(80)]  # ids repeat, on several dates
    hot = [("v1", rng.choice(days[:10]), 10_000 + i) for i in range(60)]
    comments = [(rng.choice([*ids, "gone"]), rng.choice([None, *days[: rng.randint(1, 20)]]), i) for i in range(120)] + hot
    for least in (9, 14):
        check(spark, videos, comments, least)


def test_a_cascade_removes_one_date_per_pass(spark):
    # each day's videos are held up by children whose parents belong to the day before
    videos = [(f"v{d}", f"2024-05-{d:02d}", d) for d in range(1, 6)]
    comments = [(f"v{d - 1}", f"2024-05-{d:02d}", 10 + d) for d in range(2, 6)]
    assert check(spark, videos, comments, 2) == 6
    assert check(spark, videos, comments, 1) == 1


def test_empty_tables(spark):
    assert check(spark, [], [], 1) == 1
    assert check(spark, [("a", "2024-05-01", 1)], [], 1) == 1
    assert check(spark, [], [("a", "2024-05-01", 1)], 1) == 2
