"""Exact nearest rows and the density cut, held against all pairs and against the cut's SQL."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skein.catalog import ORACLE_SQL, QUERIES
from skein.operators import nearest


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def brute(rows, k):
    """id → (copies, its nearest (d, id, copies)) over all pairs of different (id, vector)."""
    points = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            points[i, tuple(v)] = points.get((i, tuple(v)), 0) + 1
    found = {}
    for (i, a), copies in points.items():
        mine = [(d, j, n) for (j, b), n in points.items() if j != i and math.isfinite(d := distance(a, b))]
        most, near = found.get(i, (0, []))
        found[i] = max(most, copies), sorted(near + mine)[:k]
    return found


def odd_rows(kind):
    rng = random.Random(3)
    if kind == "grid":  # nearly all distances repeat
        rows = [(7 * i % 601, [float(i % 10), float(i // 10 % 10), float(i // 100)]) for i in range(600)]
    elif kind == "far":  # clusters far from zero and from each other, so that most blocks are not asked
        rows = [(i, [1e6 * (i % 4) + rng.gauss(0, 1e-3) for _ in range(4)]) for i in range(500)] + [(900 + i, [1e200 * i, 0.0, 0.0, 0.0]) for i in range(3)]
    else:
        rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(500)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + rows[20:60] + rows[20:30]  # copies, repeated rows
    rows += [(i, rows[i + 1][1]) for i in range(0, 50, 5)]  # ids with several vectors, some of them next to each other
    rows += [(2000, rows[0][1]), *((2000, [x + 1e-7 * i for x in rows[0][1]]) for i in range(1, 12))]
    return rows + [(None, rows[0][1]), (3000, None), (3001, []), (3002, [float("nan")] * len(rows[0][1])), (3003, [None] * len(rows[0][1]))]


@pytest.mark.parametrize("kind", ["normal", "grid", "far"])
def test_nearest_rows_equal_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(nearest, "RUN", 2)
    monkeypatch.setattr(nearest, "ASK_BLOCKS", 5)  # several blocks of vectors to one of asks
    rows = odd_rows(kind)
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "id long, embedding array<double>")
    nodes, near = nearest.nearest_rows(table.repartition(3), "id", "embedding", 5, block_rows=64)
    wanted = brute(rows, 5)
    assert dict(map(tuple, nodes.collect())) == {i: n for i, (n, _) in wanted.items()}
    assert {r.node: [tuple(x) for x in r.near] for r in near.collect()} == {i: x for i, (_, x) in wanted.items() if x}


def test_nearest_of_few_rows(spark):
    table = spark.createDataFrame([(4, [1.0, 2.0]), (2, [1.0, 2.0]), (9, [4.0, 6.0])], "id long, embedding array<double>")
    near = {r.node: [tuple(x) for x in r.near] for r in nearest.nearest_rows(table, "id", "embedding", 5)[1].collect()}
    assert near == {2: [(0.0, 4, 1), (5.0, 9, 1)], 4: [(0.0, 2, 1), (5.0, 9, 1)], 9: [(5.0, 2, 1), (5.0, 4, 1)]}
    for n in (0, 1):
        nodes, near = nearest.nearest_rows(table.limit(n), "id", "embedding", 5)
        assert nodes.count() == n and near.collect() == []


def test_density_cut_equals_its_sql(spark, tmpdir_path):
    """More rows than one bucket of the approximate neighbours had, and several rows of one vector: every row as by all pairs."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 16)) * 1.1
    vectors = (centers[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.33).astype(np.float32)
    vectors[200:212] = vectors[100]
    vectors[300] = vectors[301]
    ids = pa.array(rng.permutation(1500))
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32()))}), f"{tmpdir_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmpdir_path}/embeddings.parquet')")
    wanted = {r[0]: r[1:] for r in con.execute(ORACLE_SQL["density_cut"]).fetchall()}
    got = {r.vec_id: (r.core, r.joins_at, r.component) for r in QUERIES["density_cut"](spark, tmpdir_path).collect()}
    assert len({c for _, _, c in wanted.values()}) > 3 and len(wanted) == 1500
    assert got.keys() == wanted.keys()
    assert all(got[i][2] == c and got[i][:2] == pytest.approx((core, first), abs=2e-9) for i, (core, first, c) in wanted.items())
