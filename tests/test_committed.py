"""Micro-batches committed to tables: replays, crashes between write and commit, and which days are written."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from skein.streaming import committed as cm
from skein.streaming import ingest as si

SCHEMA = "id long, video string, ts timestamp, v int"


def batch(spark, rows):
    frame = spark.createDataFrame([(i, video, day, v) for i, video, day, v in rows], "id long, video string, day string, v int")
    return frame.select("id", "video", F.to_timestamp("day").alias("ts"), "v")


def rows_of(spark, root):
    return sorted(((r.id, r.video, r.v) for r in cm.read_rows(spark, root).collect()), key=repr)


def days_of(spark, root):
    return {(str(r.day), r.video): r.n for r in cm.read_daily(spark, root).collect()}


def test_replays_are_dropped_and_days_merged(spark, tmp_path):
    root = str(tmp_path / "t")
    take = cm.take_in(root, ["id", "video"], "ts", ["video"], buckets=4)
    take(batch(spark, [(1, "a", "2024-01-01", 1), (1, "a", "2024-01-01", 2), (2, "a", "2024-01-02", 1), (None, "a", "2024-01-01", 5)]), 0)
    take(batch(spark, [(1, "a", "2024-03-01", 9), (3, "b", "2024-01-02", 1), (None, "a", "2024-01-01", 6), (4, "b", None, 1)]), 1)
    take(batch(spark, [(9, "z", "2024-01-09", 1)]), 1)  # the same batch again, whatever it holds
    assert cm.committed_batches(spark, root) == [0, 1]
    assert rows_of(spark, root) == sorted([(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "b", 1), (None, "a", 5)], key=repr)
    assert days_of(spark, root) == {("2024-01-01", "a"): 2, ("2024-01-02", "a"): 1, ("2024-01-02", "b"): 1}
    # the second batch touches one day and writes that one alone
    assert [d for d in os.listdir(f"{root}/daily/batch=1") if d.startswith("day=")] == ["day=2024-01-02"]
    take(batch(spark, []), 2)
    assert len(rows_of(spark, root)) == 5 and len(days_of(spark, root)) == 3


def test_a_crash_before_the_commit_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    take = cm.take_in(root, ["id"], "ts")
    take(batch(spark, [(1, "a", "2024-01-01", 1)]), 0)
    second = batch(spark, [(1, "a", "2024-01-01", 2), (2, "a", "2024-01-01", 1), (3, "a", "2024-01-02", 1)])
    with monkeypatch.context() as broken:
        broken.setattr(cm, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            take(second, 1)
    assert [r[0] for r in rows_of(spark, root)] == [1] and cm.committed_batches(spark, root) == [0]
    assert {d: n for (d, _), n in ((k if isinstance(k, tuple) else (k, None), n) for k, n in _plain_days(spark, root).items())} == {"2024-01-01": 1}
    take(second, 1)
    assert rows_of(spark, root) == [(1, "a", 1), (2, "a", 1), (3, "a", 1)]
    assert _plain_days(spark, root) == {"2024-01-01": 2, "2024-01-02": 1}


def _plain_days(spark, root):
    return {str(r.day): r.n for r in cm.read_daily(spark, root).collect()}


def test_a_restarted_stream_goes_on_without_state(spark, tmp_path):
    root, landing = str(tmp_path / "t"), str(tmp_path / "landing")
    schema = batch(spark, []).schema

    def run():
        stream = si.read_table_stream(spark, landing, schema, max_files=1)
        si.run_available_now(stream, "", str(tmp_path / "ckpt"), foreach_batch=cm.take_in(root, ["id"], "ts"))

    batch(spark, [(1, "a", "2024-01-01", 1), (2, "a", "2024-01-01", 1)]).coalesce(1).write.mode("append").parquet(landing)
    run()
    batch(spark, [(2, "a", "2024-01-01", 7), (3, "a", "2024-01-05", 1)]).coalesce(1).write.mode("append").parquet(landing)
    run()
    assert rows_of(spark, root) == [(1, "a", 1), (2, "a", 1), (3, "a", 1)]
    assert _plain_days(spark, root) == {"2024-01-01": 2, "2024-01-05": 1}
    assert not os.path.exists(tmp_path / "ckpt" / "state")
