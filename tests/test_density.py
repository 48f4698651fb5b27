"""Density hierarchy and spanning forests, held against plain single-machine versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import density, graph


class Union:
    def __init__(self, names):
        self.parent = {n: n for n in names}

    def root(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        self.parent[self.root(a)] = self.root(b)


def kruskal(names, edges):
    own, out = Union(names), []
    for e in sorted(edges, key=lambda e: (*e[2:], e[0], e[1])):
        if own.root(e[0]) != own.root(e[1]):
            own.join(e[0], e[1])
            out.append(e)
    return out, own


def test_spanning_forest_equals_kruskal(spark):
    rng = random.Random(4)
    edges = {}
    for _ in range(400):
        a, b = sorted(rng.sample(range(150), 2))
        edges[a, b] = rng.randrange(12)
    edges = [(a, b, w) for (a, b), w in edges.items()]
    chain = [(1000 + i, 1001 + i, 5) for i in range(60)]
    table = spark.createDataFrame([*((b, a, w) for a, b, w in edges + chain), (7, 7, 0), *edges[:5]], "u long, v long, w int")
    forest, labels = graph.spanning_forest(table.repartition(4))
    wanted, own = kruskal({x for e in edges + chain for x in e[:2]}, edges + chain)
    assert sorted(map(tuple, forest.collect())) == sorted(wanted)
    found = {}
    for node, component in labels.collect():
        found.setdefault(component, set()).add(node)
    brute = {}
    for node in own.parent:
        brute.setdefault(own.root(node), set()).add(node)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, brute.values()))


def test_forest_of_no_edges(spark):
    forest, labels = graph.spanning_forest(spark.createDataFrame([], "u long, v long, w int"))
    assert forest.collect() == [] and labels.collect() == []


def brute_hierarchy(points, least, most, samples, k=None):
    """Row → (cluster as a set of rows, strength) by one dendrogram over the whole nearest-neighbour graph."""
    nodes = {}
    for i, p in points:
        nodes.setdefault(p, []).append(i)
    names = {min(ids): (p, len(ids)) for p, ids in nodes.items()}
    near, core = {}, {}
    for n, (p, c) in names.items():
        others = sorted((float(np.sqrt(((np.array(p) - np.array(q)) ** 2).sum())), m, k) for m, (q, k) in names.items() if m != n)
        near[n] = others[:samples]
        seen, core[n] = c - 1, 0.0
        for d, _, k in near[n]:
            if seen >= samples:
                break
            seen, core[n] = seen + k, d
    edges = {}
    for n in near:
        for d, m, _ in near[n]:
            edges[min(n, m), max(n, m)] = (max(core[n], core[m], d), d)
    forest, _ = kruskal(names, [(a, b, w, d) for (a, b), (w, d) in edges.items()])
    # dendrogram as nested tuples (size, weight, left, right, node)
    top = {n: (c, None, None, None, n) for n, (_, c) in names.items()}
    own = Union(names)
    for a, b, w, _ in forest:
        x, y = top[own.root(a)], top[own.root(b)]
        own.join(a, b)
        top[own.root(a)] = (x[0] + y[0], w, x, y, None)
    trees = [top[r] for r in {own.root(n) for n in names}]
    inverse = lambda w: 1 / max(w, density.LEAST_WEIGHT)

    def leaves(t):
        out, queue = [], [t]
        while queue:
            t = queue.pop()
            if t[4] is not None:
                out.append(t[4])
            else:
                queue += [t[2], t[3]]
        return out

    def condense(t, since):
        """(stability, members with densities, birth size, children) from the top down."""
        exits, size = [], t[0]
        while True:
            if t[4] is not None:
                exits.append((t[4], inverse(core[t[4]])))
                return since, exits, size, []
            at, (a, b) = inverse(t[1]), (t[2], t[3])
            if a[0] >= least and b[0] >= least:
                return since, exits, size, [(at, condense(a, at)), (at, condense(b, at))]
            if a[0] < least and b[0] < least:
                exits += [(n, at) for n in leaves(t)]
                return since, exits, size, []
            small, t = (a, b) if a[0] < least else (b, a)
            exits += [(n, at) for n in leaves(small)]

    weight = {n: c for n, (_, c) in names.items()}

    def under(c):
        return c[1] + [x for _, k in c[3] for x in under(k)]

    def total(c):
        return sum(weight[n] for n, _ in under(c))

    def choose(c, allowed):
        since, exits, size, children = c
        own = sum((at - since) * weight[n] for n, at in exits) + sum((at - since) * total(k) for at, k in children)
        below = [choose(k, True) for _, k in children]
        sub = sum(s for s, _ in below)
        if not allowed or size > most or (children and sub > own):
            return sub, [x for _, f in below for x in f]
        return own, [c]

    large = [t for t in trees if t[0] >= least]
    found = {}
    for t in large:
        for cluster in choose(condense(t, 0.0), len(large) > 1)[1]:
            rows = under(cluster)
            best = max(at for _, at in rows)
            for n, at in rows:
                found[n] = (frozenset(m for m, _ in rows), round(at / best, 9))
    return {i: found.get(min(ids)) for ids in nodes.values() for i in ids}


def planted(seed, spread):
    """Clusters of unequal density and size, noise, and copies."""
    rng = np.random.default_rng(seed)
    parts = [((0, 0), 0.05, 40), ((3, 0), 0.3, 60), ((3, 2.2), 0.25, 50), ((-4, 3), 1.0, 45), ((0, 0.9), 0.06, 30)]
    rows = [tuple(p) for c, s, n in parts for p in (rng.normal(size=(n, 2)) * s * spread + c).tolist()]
    rows += [tuple(p) for p in rng.uniform(-8, 8, (40, 2)).tolist()]
    rows += [rows[3]] * 8 + [(9.0, 9.0)] * 15
    return list(enumerate(rows))


@pytest.mark.parametrize(("least", "most", "local"), [(10, 70, 50_000), (10, 70, 20), (12, 10_000, 60)])
def test_hierarchy_equals_brute_force(spark, least, most, local):
    points = planted(1, 1.0)
    table = spark.createDataFrame([(i, list(p), "x") for i, p in points], "id long, embedding array<double>, part string")
    got = density.density_hierarchy(table, "id", min_size=least, max_size=most, min_samples=6, local_edges=local).collect()
    wanted = brute_hierarchy(points, least, most, 6)
    clusters = {}
    for r in got:
        if r.topic_id >= 0:
            clusters.setdefault(r.topic_id, set()).add(r.id)
    assert [len(clusters[t]) for t in sorted(clusters)] == sorted(map(len, clusters.values()), reverse=True)
    assert sorted(clusters) == list(range(len(clusters))) and len(clusters) >= 3
    same = {}
    for i, f in wanted.items():
        if f:
            same.setdefault(f[0], set()).add(i)
    assert sorted(map(sorted, clusters.values())) == sorted(map(sorted, same.values()))
    assert {r.id: round(r.topic_probability, 9) for r in got} == {i: f[1] if f else 0.0 for i, f in wanted.items()}


def test_hierarchy_finds_planted_clusters(spark):
    points = planted(2, 0.5)
    table = spark.createDataFrame([(i, list(p)) for i, p in points], "id long, embedding array<double>")
    got = {r.id: r.topic_id for r in density.density_hierarchy(table, "id", min_size=12, max_size=100, min_samples=5).collect()}
    first = 0
    for n in (40, 60, 50, 45, 30):
        labels = [got[i] for i in range(first, first + n)]
        most = max(set(labels), key=labels.count)
        assert most >= 0 and labels.count(most) >= 0.7 * n
        first += n


def test_awkward_rows_are_outliers(spark):
    rows = [(i, [float(i % 5), 0.0]) for i in range(20)] + [(100, None), (101, []), (102, [float("nan"), 0.0]), (None, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {r.id: r.topic_id for r in density.density_hierarchy(table, "id", min_size=4, max_size=10, min_samples=2).collect()}
    assert len(got) == 24 and {got[100], got[101], got[102], got[None]} == {-1}
    assert [len({got[i] for i in range(k, 20, 5)}) for k in range(5)] == [1] * 5
    assert density.density_hierarchy(table.limit(0), "id").collect() == []


def test_neighbours_from_bounded_buckets(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 12)) * 3
    vectors = centers[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 12))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "id long, embedding array<double>")
    nodes, _ = density.vector_nodes(table, "id", "embedding")
    near = {r.node: [x.node for x in r.near] for r in density.neighbours(nodes, 10, trees=6, bucket=512).collect()}
    d = ((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    exact = np.argsort(d, axis=1)[:, :10]
    recall = np.mean([len(set(near[i]) & set(exact[i].tolist())) / 10 for i in range(3000)])
    assert recall >= 0.9


def test_ties_go_to_the_smaller_node(spark):
    """On a grid nearly all distances repeat; of equal ones the smaller nodes count."""
    points = {3 * i + 1: (float(i % 6), float(i // 6 % 5)) for i in range(30)} | {500: (1e200, 0.0), 501: (-1e200, 1.0)}
    nodes = spark.createDataFrame([(n, list(p), 1) for n, p in points.items()], "node long, vec array<double>, copies long")
    near = {r.node: [(x.d, x.node) for x in r.near] for r in density.neighbours(nodes, 5).collect()}
    with np.errstate(over="ignore"):
        wanted = {
            n: sorted((d, m) for m, q in points.items() if m != n and np.isfinite(d := float(np.sqrt(((np.array(p) - np.array(q)) ** 2).sum()))))[:5]
            for n, p in points.items()
        }
    assert near == {n: w for n, w in wanted.items() if w}


def test_small_parts_cost_no_call_of_their_own(spark):
    """Hundreds of parts go to a few groups; those below the least size are outliers; great ids stay whole beside nulls."""
    high = (1 << 60) + 1
    names = [high + i for i in range(8)]
    rows = [(n, 0, 1.0 if n != names[-1] else 9.0, 2.0, True) for n in names] + [(i, 10 + i, 1.0, None, False) for i in range(300)]
    rows += [(1000 + i, 500 + i // 3, 1.0, 2.0, True) for i in range(60)]
    parts = spark.createDataFrame([(n, p, c, b) for n, p, _, c, b in rows], "node long, part long, close double, born boolean")
    cores = spark.createDataFrame([(n, 1, c) for n, _, c, _, _ in rows], "node long, copies long, core double")
    edges = [(a, b, 1.0 if b != names[-1] else 9.0, 1.0) for a, b in zip(names, names[1:])]
    edges += [(1000 + i, 1001 + i, 1.0, 1.0) for i in range(59) if i % 3 < 2]
    forest = spark.createDataFrame(edges, "u long, v long, w double, d double")
    found = density.part_clusters(parts, cores, forest, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas [bin" in plan
    got = {r.node: r.cluster for r in found.collect()}
    assert len(got) == len(rows) and all(got[i] is None for i in range(300))
    assert all(got[1000 + i] == 1000 + i // 3 * 3 for i in range(60))
    assert {got[n] for n in names[:-1]} == {high}
    alone = parts.where("part = 0 or part >= 500").withColumn("close", F.lit(0.5)).withColumn("born", F.lit(False))
    assert all(r.cluster is None for r in density.part_clusters(alone, cores, forest, 3).collect())
