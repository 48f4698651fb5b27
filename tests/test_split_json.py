"""Large JSON payloads read by byte ranges: rows and errors as from whole files."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.sources import readers as rd
from skein.sources.split_json import _range_states, _segments

RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("sub", T.StructType([T.StructField("k", T.ArrayType(T.LongType()))])),
    ]
)
KEYS = ("results", "comments", "data")


@pytest.fixture()
def small_ranges(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def record(rng, i):
    odd = ['}', '{"', '\\', '\\"}', "]}", "é日本😀", "\n\t", "a" * rng.randint(0, 900), "[{", '"id": 5}', "\\\\"]
    text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 5)))
    return {"id": str(i), "text": text, "sub": {"k": [i, {"x": "}"}] if i % 5 == 0 else [i]}}


def payloads(seed):
    rng = random.Random(seed)
    rows = lambda n: [rng.choice([record(rng, i), record(rng, i), record(rng, i), 5, "}{", [record(rng, i)], None]) for i in range(n)]
    return {
        "a.json": json.dumps({"error": "}", "results": rows(40), "more": {"deep": {"er": [1]}}}),
        "b.json": json.dumps(rows(60), indent=1, ensure_ascii=False) + "\n",
        "c.json": json.dumps({"data": rows(8), "comments": rows(30)}, indent=rng.choice([None, 2])),
        "d.json": json.dumps({"results": None, "meta": {"x": [{"id": "no"}]}, "data": rows(20)}),
        "e.json": json.dumps({"id": "alone", "text": "x}" * 400, "sub": {"k": [1, 2]}, "other": [{"id": "in"}] * 30}),
        "f.json": "  " + json.dumps({"results": []}) + " " * 700,
        "g.json": json.dumps([[{"id": "deep"}], "x" * 900]),
        "h.json": json.dumps({"results": [record(rng, 1) for _ in range(3)] + [{"id": "z", "text": "y" * 2500}]}),
        "i.json": json.dumps({"results": {"not": {"a": "list"}}, "id": "j", "text": "t" * 400}),
        "j.json": "﻿" + json.dumps([record(rng, i) for i in range(20)]).replace(", {", " ,\n{"),
    }


def written(folder, files):
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as fh:
            fh.write(text)


def rows_of(df):
    return sorted((r.source_file, r.pos, r.id, r.text, r.sub) for r in df.collect())


@pytest.mark.parametrize(("seed", "keys", "single"), [(1, KEYS, True), (2, ("results",), False)])
def test_split_rows_equal_whole_rows(spark, tmpdir_path, small_ranges, seed, keys, single):
    written(tmpdir_path, payloads(seed))
    whole = rd.read_payload_records(spark, tmpdir_path, RECORD, keys=keys, single_object=single, split_bytes=1 << 40)
    split = rd.read_payload_records(spark, tmpdir_path, RECORD, keys=keys, single_object=single, split_bytes=1)
    wanted = rows_of(whole)
    assert len(wanted) > 60
    assert rows_of(split) == wanted
    plain = []
    for name, text in payloads(seed).items():
        found = json.loads(text.lstrip("\ufeff"))
        if isinstance(found, dict):
            lists = [found[k] for k in keys if isinstance(found.get(k), list)]
            found = lists[0] if lists else [found] if single else []
        plain += [(name, pos, r.get("id"), r.get("text")) for pos, r in enumerate(x for x in found if isinstance(x, dict))]
    assert sorted(r[:4] for r in wanted) == sorted(plain)


def test_a_file_is_read_by_many_tasks(spark, tmpdir_path, small_ranges):
    written(tmpdir_path, {"a.json": payloads(3)["a.json"]})
    segments = _segments(spark, tmpdir_path, "*.json", 1)
    states = _range_states(segments).collect()
    assert len(states) > 5 and len({r.block for r in states}) == len(states)
    assert segments.select(F.spark_partition_id().alias("p")).distinct().count() > 5


BROKEN = {
    "cut short": lambda t: t[: len(t) // 2],
    "a comma too many": lambda t: t.replace(", {", ",, {", 1),
    "no closing bracket": lambda t: t[:-2],
    "a broken record": lambda t: t.replace('"text":', '"text"', 1),
    "no opening bracket": lambda t: t[1:],
    "rubbish behind": lambda t: t + " x",
    "a closing bracket too many": lambda t: t + "]",
    "two documents": lambda t: t + t,
}


@pytest.mark.parametrize("fault", BROKEN)
def test_malformed_files_fail_or_are_skipped(spark, tmpdir_path, small_ranges, fault):
    rng = random.Random(9)
    good = json.dumps({"results": [record(rng, i) for i in range(20)]})
    written(tmpdir_path, {"good.json": good, "bad.json": BROKEN[fault](good)})
    split = rd.read_payload_records(spark, tmpdir_path, RECORD, on_malformed=rd.SKIP, split_bytes=1)
    whole = rd.read_payload_records(spark, tmpdir_path, RECORD, on_malformed=rd.SKIP, split_bytes=1 << 40)
    assert rows_of(split) == rows_of(whole) and len(rows_of(whole)) == 20
    with pytest.raises(Exception, match="malformed JSON in bad.json"):
        rd.read_payload_records(spark, tmpdir_path, RECORD, split_bytes=1).collect()


def test_parent_and_child_readers_take_large_files(spark, tmpdir_path, small_ranges):
    rng = random.Random(11)
    rows = [{"id": str(i), "video_id": f"{i}.0", "text": "}" * rng.randint(0, 9), "hashtag_names": ["a"]} for i in range(50)]
    written(tmpdir_path, {"a.json": json.dumps({"results": rows}), "b.json": json.dumps(rows[:7])})
    parents = rd.read_parent_envelopes(spark, tmpdir_path, split_bytes=1000)
    assert sorted((r.source_file, r.pos, r.id) for r in parents.collect()) == sorted(
        [("a.json", i, str(i)) for i in range(50)] + [("b.json", i, str(i)) for i in range(7)]
    )
    children = rd.read_child_batches(spark, tmpdir_path, split_bytes=1000, jsonl_pattern="none*")
    assert sorted((r.source_file, r.pos, r.text, r.video_id) for r in children.collect()) == sorted(
        [("a.json", i, r["text"], str(i)) for i, r in enumerate(rows)] + [("b.json", i, r["text"], str(i)) for i, r in enumerate(rows[:7])]
    )
