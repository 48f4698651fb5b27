"""Readers, sinks, export validation, streaming resume, driver contract."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from skein.schemas import CHILD_SCHEMA
from skein.sources import readers as rd
from skein.sources import sinks as sk


def _write(path, name, text):
    with open(os.path.join(path, name), "w", encoding="utf-8") as fh:
        fh.write(text)


def test_parent_envelopes(spark, tmpdir_path):
    _write(tmpdir_path, "a.json", json.dumps({"results": [{"id": 7.0, "create_time": 1}, {"id": "123456789012345678901"}], "error": None}))
    _write(tmpdir_path, "b.json", json.dumps({"error": "boom"}))
    _write(tmpdir_path, "c.json", json.dumps([{"id": "9"}]))
    _write(tmpdir_path, "d.json", json.dumps({"results": []}))
    df = rd.read_parent_envelopes(spark, tmpdir_path)
    rows = sorted((r.source_file, r.pos, r.id) for r in df.collect())
    # a bare list is accepted (D-1); files without results give no rows
    assert rows == [("a.json", 0, "7"), ("a.json", 1, "123456789012345678901"), ("c.json", 0, "9")]


def test_child_batches(spark, tmpdir_path):
    lines = ['{"id": "1", "video_id": "v", "text": "hi"}', "", "[1, 2]", "not json", '{"id": 2, "video_id": 5.0}', '{"id": 7']
    _write(tmpdir_path, "comments_batch_00001.jsonl", "\n".join(lines) + "\n")
    _write(tmpdir_path, "x.json", json.dumps({"comments": [{"id": "3", "video_id": "w"}]}))
    _write(tmpdir_path, "y.json", json.dumps([{"id": "4", "video_id": "w"}, 5]))
    _write(tmpdir_path, "z.json", "{broken")
    df = rd.read_child_batches(spark, tmpdir_path, CHILD_SCHEMA, on_malformed=rd.SKIP)
    got = sorted((r.id, r.video_id) for r in df.collect())
    assert got == [("1", "v"), ("2", "5"), ("3", "w"), ("4", "w")]
    # nothing is lost in silence: reading fails by default, and the bad lines and files can be listed
    with pytest.raises(Exception, match="malformed JSON in comments_batch_00001.jsonl"):
        rd.read_jsonl(spark, tmpdir_path, CHILD_SCHEMA).collect()
    with pytest.raises(Exception, match="malformed JSON in z.json"):
        rd.read_child_batches(spark, tmpdir_path, CHILD_SCHEMA, jsonl_pattern="none*").collect()
    assert sorted(r.value for r in rd.malformed_lines(spark, tmpdir_path).collect()) == ["not json", '{"id": 7']
    bad = rd.malformed_payloads(rd.read_json_payloads(spark, tmpdir_path))
    assert [r.source_file for r in bad.collect()] == ["z.json"]


def test_json_states(spark):
    cases = {
        "": "blank", " \t\ufeff\n": "blank", None: "blank", "{}": "object", ' {"a": [1, "}"]} \n': "object", "\ufeff{}": "object",
        "[1, {}]": "other", "12": "other", '"x"': "other", "null": "other", "{": "malformed", "{} x": "malformed", "{}}": "malformed",
        "{}]": "malformed", "{}]}": "malformed", "{}, {}": "malformed", "1, 2": "malformed", "[1]]": "malformed", '"a": 1': "malformed",
        "no": "malformed", '{"a": 1': "malformed", "[1": "malformed", "{}{}": "malformed",
    }
    found = spark.createDataFrame([(c,) for c in cases], "v string").select("v", rd.json_state(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in found} == cases


def test_hashtags_as_list_and_text(spark, tmpdir_path):
    tags = [["a", "#b"], "a, #b", "['a', None, \"#b\"]", None, "[\"don't\", 'x']", "[odd", []]
    _write(tmpdir_path, "a.json", json.dumps({"results": [{"id": str(i), "hashtag_names": t} for i, t in enumerate(tags)]}))
    got = {r.id: r.hashtag_names for r in rd.read_parent_envelopes(spark, tmpdir_path).collect()}
    assert got == {"0": ["a", "b"], "1": ["a", "b"], "2": ["a", "b"], "3": None, "4": ["don't", "x"], "5": ["[odd"], "6": []}


def test_read_table_by_suffix(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a")], "k INT, v STRING")
    p = os.path.join(tmpdir_path, "t.parquet")
    sk.write_table(df, p)
    assert rd.read_table(spark, p).count() == 1
    c = os.path.join(tmpdir_path, "t.csv")
    sk.write_csv(df, c, single_file=True)
    assert rd.read_table(spark, c).first().v == "a"
    with pytest.raises(ValueError):
        rd.read_table(spark, os.path.join(tmpdir_path, "t.xlsx"))
    assert rd.first_existing(spark, [os.path.join(tmpdir_path, "nope"), p]) == p
    assert sk.has_columns(spark, p, ["k"]) and not sk.has_columns(spark, p, ["k", "zz"])


def test_terms_and_ids(spark, tmpdir_path):
    _write(tmpdir_path, "terms.txt", "# comment\nStress\n\nstress\nAnxiety\n")
    terms = [r.term for r in rd.read_terms(spark, terms_file=os.path.join(tmpdir_path, "terms.txt")).orderBy("pos").collect()]
    assert terms == ["Stress", "Anxiety"]
    assert [r.term for r in rd.read_terms(spark, "a, B ,b,,c").orderBy("pos").collect()] == ["a", "B", "c"]
    _write(tmpdir_path, "ids.csv", "other,video_id\nx,1\ny,\nz,1\nq,2\n")
    assert sorted(r.video_id for r in rd.read_id_list(spark, os.path.join(tmpdir_path, "ids.csv")).collect()) == ["1", "2"]


def test_jsonl_batches_and_redact(spark, tmpdir_path):
    df = spark.createDataFrame([(str(i), "" if i % 2 else None, "t") for i in range(25)], "id STRING, video_id STRING, text STRING")
    out = os.path.join(tmpdir_path, "batches")
    sk.write_jsonl_batches(df.coalesce(1), out, records_per_file=10, request_id="req")
    files = [f for f in os.listdir(out) if f.endswith(".json")]
    assert len(files) == 3
    back = spark.read.json(out)
    assert back.filter(F.col("video_id") == "req").count() == 25
    assert sk.redact(df).columns == ["video_id"]


def test_stream_resume_adds_nothing(spark, tmpdir_path):
    from skein.streaming import ingest as si

    land = os.path.join(tmpdir_path, "land")
    os.makedirs(land)
    _write(land, "b1.jsonl", '{"id": "1", "video_id": "v", "create_time": 1}\n{"id": "1", "video_id": "v", "create_time": 1}\n')
    ts = F.timestamp_seconds("create_time")
    stream = si.read_child_stream(spark, land).withColumn("ts", ts)
    deduped = si.dedupe_stream(stream, ["id", "video_id"]).drop("ts")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    si.run_available_now(deduped, out, ck)
    assert spark.read.parquet(out).count() == 1
    stream2 = si.dedupe_stream(si.read_child_stream(spark, land).withColumn("ts", ts), ["id", "video_id"]).drop("ts")
    si.run_available_now(stream2, out, ck)
    assert spark.read.parquet(out).count() == 1
    _write(land, "b2.jsonl", '{"id": "2", "video_id": "v", "create_time": 2}\n')
    stream3 = si.dedupe_stream(si.read_child_stream(spark, land).withColumn("ts", ts), ["id", "video_id"]).drop("ts")
    si.run_available_now(stream3, out, ck)
    assert spark.read.parquet(out).count() == 2


def test_export_validation_catches_failures(spark):
    from skein.constants import CHILD_EXPORT_COLUMNS, PARENT_EXPORT_COLUMNS
    from skein.operators import export as ex

    v = spark.createDataFrame([tuple(["t", 0, "2024-01-01"] + [0.1] * 7 + ["xlm_neutral"] + [0.0] * 4)], ",".join(
        f"{c} {'STRING' if c in ('topic', 'date', 'xlm_sentiment') else ('BIGINT' if c.endswith('index') else 'DOUBLE')}" for c in PARENT_EXPORT_COLUMNS
    ))
    c = spark.createDataFrame([tuple([5, 0, "2024-01-01"] + [0.1] * 7 + ["xlm_neutral"] + [0.0] * 4)], ",".join(
        f"{x} {'STRING' if x in ('date', 'xlm_sentiment') else ('BIGINT' if x.endswith('index') else 'DOUBLE')}" for x in CHILD_EXPORT_COLUMNS
    ))
    checks = {r.check: r.failures for r in ex.validate_exports(v, c, 3).collect()}
    assert checks["comment_parent_exists"] == 1
    assert checks["dates_above_threshold"] == 1
    assert checks["disallowed_columns"] == 0
    with pytest.raises(ValueError):
        ex.assert_valid(ex.validate_exports(v, c, 3))


def test_driver_contract(spark):
    import __spark_entry__ as entry

    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    df = entry.entry(spark)
    assert df.columns == ["topic", "rank", "term", "z_score"]
    assert df.count() >= 0


def test_latest_status_out_of_order(spark, tmpdir_path):
    from skein.streaming import ingest as si

    land = os.path.join(tmpdir_path, "land")
    schema = "user_id LONG, ts LONG, event_id LONG, event_type STRING"
    batches = [
        [(1, 10, 1, "error"), (2, 10, 2, "error"), (1, 5, 3, "ok")],  # user 1: latest is the error at ts 10
        [(1, 7, 4, "ok"), (2, 20, 5, "ok")],  # older event for user 1 arrives late: ignored; user 2 recovers
        [(3, 1, 6, "error")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(land, f"b={i}"))
    stream = si.read_table_stream(spark, land, spark.read.parquet(os.path.join(land, "b=0")).schema, max_files=1)
    latest = si.latest_status(stream, "user_id", ["ts", "event_id"], ["event_type"])
    out = os.path.join(tmpdir_path, "changes")
    si.run_available_now(latest, "", os.path.join(tmpdir_path, "ck"), mode="update", foreach_batch=si.append_each_batch(out))
    current = {r.user_id: r.event_type for r in si.fold_changes(spark.read.parquet(out), "user_id", ["ts", "event_id"]).collect()}
    assert current == {1: "error", 2: "ok", 3: "error"}


def test_split_sinks_and_inputs(spark, tmpdir_path):
    df = spark.createDataFrame([("1", None), ("2", "boom"), ("3", None)], "id STRING, error STRING")
    ok, bad = os.path.join(tmpdir_path, "ok"), os.path.join(tmpdir_path, "bad")
    sk.write_split_by_status(df, ok, bad)
    assert sorted(r.id for r in spark.read.json(ok).collect()) == ["1", "3"]
    assert [r.id for r in spark.read.json(bad).collect()] == ["2"]
    sk.write_tables({"a": df, "b": df.limit(1)}, os.path.join(tmpdir_path, "tables"), "_x")
    assert spark.read.parquet(os.path.join(tmpdir_path, "tables", "b_x")).count() == 1
    with pytest.raises(FileNotFoundError):
        rd.read_analysis_inputs(spark, {"videos_raw": ok})
    f1 = sk.fingerprint(df).first()
    f2 = sk.fingerprint(df.orderBy(F.col("id").desc())).first()
    assert (f1.rows, f1.hash_sum) == (f2.rows, f2.hash_sum)  # order-free


def test_topic_table_csv_headers(spark, tmpdir_path):
    from skein.constants import TOPIC_TABLE_HEADERS

    t = spark.createDataFrame([(1, 0, "Sunset", "a, b", "a, b, c")], "ID INT, topic_id INT, topic_label STRING, top_tags_first6 STRING, top_tags_all STRING")
    out = os.path.join(tmpdir_path, "topics_csv")
    sk.write_topic_table_csv(t, out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == TOPIC_TABLE_HEADERS and back.first()["Topic label"] == "Sunset"
