"""ML-8: a density hierarchy over vectors, with minimum and maximum cluster size and outliers.

1. Equal vectors become one weighted node.
2. ``neighbours``: a nearest-neighbour graph from buckets of bounded size, taken
   along space-filling curves under several random rotations; no row meets all
   others.
3. ``reachability_edges``: edges weigh the mutual reachability distance.
4. ``graph.spanning_forest``: Borůvka rounds over the edge table.
5. ``largest_parts``: of the forest's single-linkage hierarchy, the components
   that the next merge makes larger than the maximum size.  No cluster above
   that size can be chosen, so nothing is decided above them.
6. ``part_clusters``: each such part, of bounded size, has its condensed tree
   made and its clusters chosen by excess of mass, all parts in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graph import spanning_forest
from skein.operators.relational import dense_index
from skein.session import cut_lineage, ensure_checkpoint_dir, ship_package

BUCKET = 1024  # rows that are compared with each other
CURVE_DIMS, CURVE_BITS = 8, 7  # of a space-filling curve's 56-bit position
LOCAL_EDGES = 50_000  # of a part of the forest that one task merges
GROUP_ROWS = 4096  # rows of parts that a Python call takes together, about; a larger part counts by its own size
LEAST_WEIGHT = 1e-9  # weights below count as this; a density is one over a weight


def fine_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) per row; vec is null where the id is, or where the vector is null or holds null, non-finite or no numbers."""
    vec = F.transform(vec_col, lambda x: x.cast("double"))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(vec) > 0) & F.col(id_col).isNotNull()
    return rows.select(F.col(id_col).alias("id"), F.when(fine, F.transform(vec, lambda x: x + 0.0)).alias("vec"))


def vector_nodes(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(node, vec, copies) per different vector, and (id, node) per row; the node is the smallest id.

    Vectors that are null or hold null, non-finite or no numbers, and null ids, have node null.
    """
    own = fine_vectors(rows, id_col, vec_col)
    nodes = own.where("vec is not null").groupBy("vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = cut_lineage(nodes.select("node", "vec", "copies"))
    return nodes, own.join(nodes.select("vec", "node"), "vec", "left").select("id", "node")


def _curve(vectors: np.ndarray, directions: np.ndarray, center: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Position on a Z-order curve over the vectors' projections on ``directions``."""
    cells = np.clip(((vectors - center) @ directions) / width * 2**CURVE_BITS + 2 ** (CURVE_BITS - 1), 0, 2**CURVE_BITS - 1)
    cells = cells.astype(np.int64)
    code = np.zeros(len(vectors), np.int64)
    for bit in range(CURVE_BITS - 1, -1, -1):
        for d in range(directions.shape[1]):
            code = code << 1 | cells[:, d] >> bit & 1
    return code


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def on_curves(vectors: DataFrame, trees: int, seed: int = 42) -> DataFrame:
    """(tree, code, columns of ``vectors``): position of each ``vec`` on a space-filling curve under each of ``trees`` rotations."""
    ship_package(vectors.sparkSession)
    first = vectors.select(F.size("vec").alias("n")).first()
    size = first["n"] if first else 1
    stats = vectors.agg(*[f(F.get("vec", F.lit(i))) for i in range(size) for f in (F.avg, F.stddev_pop)]).first()
    center = np.array([x or 0.0 for x in stats[0::2]])
    spread = np.array([x or 0.0 for x in stats[1::2]])
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.normal(size=(size, size)))[0][:, : min(size, CURVE_DIMS)] for _ in range(trees)]
    widths = [6 * np.sqrt((basis**2 * spread[:, None] ** 2).sum(0)) + 1e-300 for basis in bases]
    own, place = vectors.columns, vectors.columns.index("vec")

    def curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matrix(batch.column(place))
            for tree, (basis, width) in enumerate(zip(bases, widths, strict=True)):
                code = pa.array(_curve(found, basis, center, width))
                columns = [pa.array(np.full(len(found), tree, np.int32)), code, *batch.columns]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "code", *own])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(curves, f"tree int, code bigint, {kinds}")


def neighbours(nodes: DataFrame, k: int, trees: int = 4, bucket: int = BUCKET, seed: int = 42) -> DataFrame:
    """(node, near): per node of ``nodes`` (node, vec, copies) its ``k`` nearest found, as (d, node, copies) ascending.

    Under each of ``trees`` random rotations the nodes are put in the order of a
    space-filling curve and cut into buckets of ``bucket`` rows that overlap by
    half; a node is compared with the bucket in whose middle half it lies.  So
    work and memory are linear in the nodes.  Up to half a bucket of nodes the
    result is exact.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    placed = on_curves(nodes.select("node", "vec", "copies"), trees, seed)
    placed = dense_index(placed, ["tree", "code", "node"], "at")
    half = bucket // 2
    part = F.floor(F.col("at") / half).cast("long")
    windows = placed.select("at", "node", "vec", "copies", F.explode(F.array(part, part - 1)).alias("part"))

    def nearest(rows: pa.Table) -> pa.Table:
        at = np.asarray(rows.column("at")) - rows.column("part")[0].as_py() * half
        names = rows.column("node").combine_chunks()
        order = np.argsort(pc.rank(names, tiebreaker="dense").to_numpy(), kind="stable")
        rank = np.asarray(pc.rank(names.take(pa.array(order)), tiebreaker="dense"))
        vectors = _matrix(rows.column("vec").combine_chunks())[order]
        asked = np.flatnonzero((at[order] >= half // 2) & (at[order] < half + half // 2))
        out_of, into, far = [], [], []
        repeated = np.concatenate(([False], rank[1:] == rank[:-1]))  # a node of two rotations counts once
        across = np.ascontiguousarray(vectors.T)
        for some in (asked[i : i + 64] for i in range(0, len(asked), 64)):
            square = np.zeros((len(some), len(vectors)))
            for x in across:
                square += (x[some, None] - x[None, :]) ** 2
            square[rank[some, None] == rank[None, :]] = np.inf
            square[:, repeated] = np.inf
            last = np.partition(square, min(k, len(vectors)) - 1, axis=1)[:, min(k, len(vectors)) - 1]
            row, col = np.nonzero((square <= last[:, None] * (1 + 1e-9)) & np.isfinite(square))
            own = np.sqrt(((vectors[some[row]] - vectors[col]) ** 2).sum(1))
            by = np.lexsort((col, own, row))
            row, col, own = row[by], col[by], own[by]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out_of.append(some[row[best]])
            into.append(col[best])
            far.append(own[best])
        out_of, into = (order[np.concatenate(x).astype(np.int64)] if x else np.zeros(0, np.int64) for x in (out_of, into))
        distance = np.concatenate(far) if far else np.zeros(0)
        copies = rows.column("copies").take(pa.array(into))
        return pa.table({"node": names.take(pa.array(out_of)), "d": distance, "near": names.take(pa.array(into)), "copies": copies})

    found = windows.groupBy("part").applyInArrow(nearest, f"node {kind}, d double, near {kind}, copies bigint")
    listed = F.sort_array(F.collect_set(F.struct("d", F.col("near").alias("node"), "copies")))  # trees * k at most
    near = found.groupBy("node").agg(F.slice(listed, 1, k).alias("near"))
    return cut_lineage(near)


def core_distances(nodes: DataFrame, near: DataFrame, min_samples: int) -> DataFrame:
    """(node, copies, core): distance to the ``min_samples``-th nearest other row, copies counted.

    Where fewer are known the farthest counts, for a node alone 0.
    """
    rows = nodes.select("node", "copies").join(near, "node", "left")
    start = F.struct((F.col("copies") - 1).alias("seen"), F.lit(0.0).alias("core"))

    def further(acc, x):
        enough = acc["seen"] >= min_samples
        return F.struct(
            F.when(enough, acc["seen"]).otherwise(acc["seen"] + x["copies"]).alias("seen"),
            F.when(enough, acc["core"]).otherwise(x["d"]).alias("core"),
        )

    known = F.aggregate(F.coalesce("near", F.array().cast(near.schema["near"].dataType)), start, further)
    return rows.select("node", "copies", known["core"].alias("core"))


def reachability_edges(near: DataFrame, cores: DataFrame) -> DataFrame:
    """(u, v, w, d) of the neighbour graph; w is the greatest of both core distances and the distance d."""
    pairs = near.select(F.col("node").alias("u"), F.explode("near").alias("x")).select("u", F.col("x.node").alias("v"), F.col("x.d").alias("d"))
    for end in ("u", "v"):
        pairs = pairs.join(cores.select(F.col("node").alias(end), F.col("core").alias(f"core_{end}")), end)
    return pairs.select("u", "v", F.greatest("core_u", "core_v", "d").alias("w"), "d")


def cut_components(nodes: DataFrame, forest: DataFrame, distance: float) -> DataFrame:
    """(node, component): the single-linkage clusters at ``distance``, named by their smallest node."""
    _, labels = spanning_forest(forest.where(F.col("w") <= distance).select("u", "v", "w"))
    named = labels.join(labels.groupBy("component").agg(F.min("node").alias("least")), "component")
    return nodes.select("node").join(named.select("node", "least"), "node", "left").select("node", F.coalesce("least", "node").alias("component"))


def _merged(nodes: pd.DataFrame, edges: pd.DataFrame, least: int, most: int) -> pd.DataFrame:
    """Parts of one piece of the forest: its edges are merged in order, and a merge beyond ``most`` rows closes both sides.

    (node, part, close, born): ``close`` is the weight of that merge, null if
    there is none; ``born`` tells that both sides have ``least`` rows, so that
    the part is a cluster of the hierarchy and not the rest of one.
    """
    names = nodes["node"].tolist()
    number = {v: i for i, v in enumerate(names)}
    parent, size = list(range(len(names))), nodes["size"].tolist()
    giant = [s > most for s in size]
    closed: dict[int, tuple[float, bool]] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    part = [-1] * len(names)  # root at closing, kept apart from later merges
    members = [[i] for i in range(len(names))]
    for a, b, w in edges.sort_values("at")[["a", "b", "w"]].itertuples(index=False):
        one, two = root(number[a]), root(number[b])
        total = size[one] + size[two]
        if total > most:
            for x, y in ((one, two), (two, one)):
                if not giant[x]:
                    closed[x] = (w, size[x] >= least and size[y] >= least)
                    for m in members[x]:
                        part[m] = x
                    members[x] = []
                    giant[x] = True
        if len(members[one]) < len(members[two]):
            one, two = two, one
        parent[two] = one
        size[one] = total
        giant[one] = total > most
        members[one] += members[two]
        members[two] = []
    rows = []
    for i, name in enumerate(names):
        if part[i] >= 0:
            rows.append((name, names[part[i]], *closed[part[i]]))
        elif not giant[root(i)]:
            rows.append((name, names[root(i)], None, False))
    return pd.DataFrame(rows, columns=["node", "part", "close", "born"]).astype({"close": "float64", "born": "bool"})


def _by_group(
    left: DataFrame, right: DataFrame, key: str, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """``run(rows of left, rows of right)`` for each value of ``key`` in ``left``, a written table.

    Values go together in groups of about ``GROUP_ROWS`` rows, dealt over as many
    partitions: a call per small value would cost far more than its rows.
    """
    bins = max(1, -(-left.count() // GROUP_ROWS))

    def group(_: tuple, own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        others, none = dict(iter(other.groupby(key))), other.iloc[:0]
        done = [run(rows, others.get(value, none)) for value, rows in own.groupby(key)]
        return pd.concat([x for x in done if len(x)] or done[:1])

    sides = (x.withColumn("bin", F.pmod(F.xxhash64(key), F.lit(bins))).repartition(bins, "bin").groupBy("bin") for x in (left, right))
    return next(sides).cogroup(next(sides)).applyInPandas(group, schema)


def largest_parts(
    nodes: DataFrame, forest: DataFrame, trees: DataFrame, least: int, most: int, local_edges: int = LOCAL_EDGES
) -> DataFrame:
    """(node, part, close, born): the components of the hierarchy whose next merge has more than ``most`` rows.

    ``nodes`` is (node, size), ``forest`` (u, v, w, d) and ``trees`` (node,
    component).  A tree with more than ``local_edges`` edges is split at its
    median edge, over and over: below it are the pieces that the lighter edges
    make, those of more than ``most`` rows being problems of their own; above it
    these pieces are single nodes.  What has become small enough is merged in
    one task each (see ``_merged``).  Nodes in no part (more copies than
    ``most``) are left out.
    """
    # numbers from 0 on are names of nodes, negative ones those of problems and of their pieces above
    numbered = cut_lineage(dense_index(nodes.select("node", "size"), ["node"], "i").withColumn("i", F.col("i").cast("bigint")))
    names = numbered.select("node", "i")
    ranked = dense_index(forest.select("u", "v", "w", "d"), ["w", "d", "u", "v"], "at")
    for end, to in (("u", "a"), ("v", "b")):
        ranked = ranked.join(names.select(F.col("node").alias(end), F.col("i").alias(to)), end)
    tree = names.withColumnRenamed("i", "problem").withColumnRenamed("node", "component")
    home = trees.join(tree, "component").join(names, "node").select("i", "problem")
    pieces = cut_lineage(
        numbered.join(home, "i", "left").select(F.coalesce("problem", "i").alias("problem"), F.col("i").alias("piece"), "size")
    )
    members = names.withColumnRenamed("i", "piece")  # the piece that a node is in by now
    edges = cut_lineage(ranked.join(home.withColumnRenamed("i", "a"), "a").select("problem", "a", "b", "w", "at"))
    used = 0
    while True:
        large = edges.groupBy("problem").agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx("at", 0.5, 1000).alias("mid"), F.max("at").alias("last")
        )
        large = cut_lineage(large.where(F.col("n") > local_edges).select("problem", F.least("mid", F.col("last") - 1).alias("mid")))
        if large.isEmpty():
            break
        split = edges.join(large, "problem", "left").withColumn("lower", F.coalesce(F.col("at") <= F.col("mid"), F.lit(False)))
        split = cut_lineage(split)
        _, labels = spanning_forest(split.where("lower").select(F.col("a").alias("u"), F.col("b").alias("v"), "at"))
        named = pieces.join(large.select("problem"), "problem", "left_semi").join(labels.withColumnRenamed("node", "piece"), "piece", "left")
        named = cut_lineage(named.select("problem", "piece", "size", F.coalesce("component", "piece").alias("component")))
        sums = named.groupBy("problem", "component").agg(F.sum("size").alias("size"))
        giants = dense_index(sums.where(F.col("size") > most), ["component"], "g")
        giants = cut_lineage(giants.select("component", (-1 - used - F.col("g")).cast("bigint").alias("fresh")))
        used += giants.count()
        named = cut_lineage(named.join(giants, "component", "left"))
        inside = named.where("fresh is not null")
        name = F.coalesce("fresh", "component")
        below_edges = split.where("lower").drop("problem").join(inside.select(F.col("piece").alias("a"), F.col("fresh").alias("problem")), "a")
        above_edges = split.where(~F.col("lower"))
        for end in ("a", "b"):
            to = named.select(F.col("piece").alias(end), name.alias("to"))
            above_edges = above_edges.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = cut_lineage(above_edges.select(*edges.columns).unionByName(below_edges.select(*edges.columns)))
        above = named.groupBy("problem", name.alias("piece")).agg(F.sum("size").alias("size"))
        below = inside.select(F.col("fresh").alias("problem"), "piece", "size")
        rest = pieces.join(large.select("problem"), "problem", "left_anti")
        pieces = cut_lineage(rest.unionByName(above).unionByName(below))
        moved = named.where("fresh is null").select("piece", "component")
        members = cut_lineage(members.join(moved, "piece", "left").select("node", F.coalesce("component", "piece").alias("piece")))

    def merge(own_nodes: pd.DataFrame, own_edges: pd.DataFrame) -> pd.DataFrame:
        return _merged(own_nodes.rename(columns={"piece": "node"}), own_edges, least, most)

    merged = _by_group(pieces, edges, "problem", merge, "node bigint, part bigint, close double, born boolean").withColumnRenamed("node", "piece")
    return members.join(merged, "piece").select("node", "part", "close", "born")


def _condensed(nodes: pd.DataFrame, edges: pd.DataFrame, least: int) -> pd.DataFrame:
    """(node, cluster, strength) of one part: clusters of its condensed tree chosen by excess of mass.

    ``strength`` is the density at which the node leaves its cluster over the
    greatest of that cluster; outliers have cluster null and strength 0.
    """
    names = nodes["node"].tolist()
    number = {v: i for i, v in enumerate(names)}
    close, born = nodes["close"].iloc[0], bool(nodes["born"].iloc[0])
    top = 0.0 if close is None or np.isnan(close) else 1 / max(close, LEAST_WEIGHT)

    class Cluster:
        __slots__ = ("children", "leaves", "stability", "total")

        def __init__(self) -> None:
            self.children: list[Cluster] = []
            self.leaves: list[tuple[int, float]] = []  # (node, density at which it leaves)

    # a group of merged nodes is the list of its nodes while it is small, and a cluster from ``least`` rows on
    copies = nodes["size"].tolist()
    density = [1 / max(c, LEAST_WEIGHT) for c in nodes["core"]]
    parent, size = list(range(len(names))), list(copies)
    small: list[list[int]] = [[i] for i in range(len(names))]
    state: list[Cluster | None] = [None] * len(names)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def leave(cluster: Cluster, who: list[int], at: float) -> None:
        cluster.leaves += [(i, at) for i in who]

    for i in range(len(names)):
        if copies[i] >= least:  # copies of one vector alone
            state[i] = Cluster()
            leave(state[i], [i], density[i])
            small[i] = []
    births: dict[int, float] = {}
    for u, v, w in edges.sort_values(["w", "d", "u", "v"])[["u", "v", "w"]].itertuples(index=False):
        one, two = root(number[u]), root(number[v])
        at = 1 / max(w, LEAST_WEIGHT)
        if len(small[one]) + size[one] < len(small[two]) + size[two]:
            one, two = two, one
        a, b = state[one], state[two]
        if a and b:
            both = Cluster()
            both.children = [a, b]
            births[id(a)] = births[id(b)] = at
            state[one] = both
        elif a or b:
            cluster = a or b
            leave(cluster, small[one] + small[two], at)
            state[one], small[one] = cluster, []
        elif size[one] + size[two] >= least:
            state[one] = Cluster()
            leave(state[one], small[one] + small[two], at)
            small[one] = []
        else:
            small[one] += small[two]
        small[two] = []
        parent[two] = one
        size[one] += size[two]
    whole = state[root(0)] if names else None
    rows: list[tuple] = []
    if whole:
        # excess of mass, from the leaves of the tree up; without recursion, as chains may be long
        order, queue = [], [whole]
        while queue:
            cluster = queue.pop()
            order.append(cluster)
            queue += cluster.children
        chosen: dict[int, list[Cluster]] = {}
        for cluster in reversed(order):
            since = births.get(id(cluster), top)
            cluster.total = sum(copies[i] for i, _ in cluster.leaves) + sum(c.total for c in cluster.children)
            cluster.stability = sum((at - since) * copies[i] for i, at in cluster.leaves)
            cluster.stability += sum((births[id(c)] - since) * c.total for c in cluster.children)
            under = sum(c.stability for c in cluster.children)
            if (cluster is whole and not born) or (cluster.children and under > cluster.stability):
                cluster.stability = under
                chosen[id(cluster)] = [x for c in cluster.children for x in chosen[id(c)]]
            else:
                chosen[id(cluster)] = [cluster]
        for cluster in chosen[id(whole)]:
            leaves, queue = [], [cluster]
            while queue:
                c = queue.pop()
                leaves += c.leaves
                queue += c.children
            name = min(names[i] for i, _ in leaves)
            best = max(at for _, at in leaves)
            rows += [(names[i], name, at / best) for i, at in leaves]
    seen = {r[0] for r in rows}
    rows += [(v, None, 0.0) for v in names if v not in seen]
    out = pd.DataFrame(rows, columns=["node", "cluster", "strength"])
    out["cluster"] = pd.Series([r[1] for r in rows], dtype=object)  # ids beside nulls stay whole numbers
    return out


def part_clusters(parts: DataFrame, cores: DataFrame, forest: DataFrame, least: int) -> DataFrame:
    """(node, cluster, strength) of every part by ``_condensed``; a part has at most the maximum size of rows.

    Parts of less than ``least`` rows hold no cluster, so their nodes are outliers without more ado.
    """
    kind = parts.schema["node"].dataType.simpleString()
    nodes = parts.join(cores, "node").select("part", "node", F.col("copies").alias("size"), "core", "close", "born")
    nodes = cut_lineage(nodes.withColumn("n", F.sum("size").over(Window.partitionBy("part"))))
    large = nodes.where(F.col("n") >= least).drop("n")
    inner = forest
    for end in ("u", "v"):
        inner = inner.join(large.select(F.col("node").alias(end), F.col("part").alias(f"part_{end}")), end)
    inner = inner.where("part_u = part_v").select(F.col("part_u").alias("part"), "u", "v", "w", "d")

    def condense(own_nodes: pd.DataFrame, own_edges: pd.DataFrame) -> pd.DataFrame:
        return _condensed(own_nodes, own_edges, least)

    found = _by_group(large, inner, "part", condense, f"node {kind}, cluster {kind}, strength double")
    small = nodes.where(F.col("n") < least)
    return found.unionByName(small.select("node", F.lit(None).cast(kind).alias("cluster"), F.lit(0.0).alias("strength")))


def density_hierarchy(
    rows: DataFrame,
    id_col: str,
    vec_col: str = "embedding",
    min_size: int = 300,
    max_size: int = 5000,
    min_samples: int = 15,
    trees: int = 4,
    bucket: int = BUCKET,
    local_edges: int = LOCAL_EDGES,
) -> DataFrame:
    """(id, topic_id, topic_probability): clusters of a density hierarchy, numbered by size, outliers −1.

    Distances are Euclidean, a row's core distance is that to its
    ``min_samples``-th nearest other row, and clusters have ``min_size`` to
    ``max_size`` rows when they part from another of ``min_size``; of those the
    tree's most stable ones are chosen.  Trees of the neighbour graph that no
    edge joins part from each other at density 0; a single tree of at most
    ``max_size`` rows isn't a cluster itself.  The probability is the density at
    which a row leaves its cluster over the cluster's greatest, 0 for outliers.

    Vectors must be of one length.  Repeated vectors share their result; null,
    empty or non-finite ones and null ids are outliers; an empty table gives no
    row.  Weights below ``LEAST_WEIGHT`` count as that.  Clusters of one size
    are numbered by their smallest id.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    nodes, known = vector_nodes(rows, id_col, vec_col)
    near = neighbours(nodes, min_samples, trees, bucket)
    cores = cut_lineage(core_distances(nodes, near, min_samples))
    forest, labels = spanning_forest(reachability_edges(near, cores))
    forest = cut_lineage(forest)
    sizes = cores.select("node", F.col("copies").alias("size"))
    parts = cut_lineage(largest_parts(sizes, forest, labels, min_size, max_size, local_edges))
    roots = cores.join(labels, "node", "left").groupBy(F.coalesce("component", "node").alias("tree")).agg(F.sum("copies").alias("n"))
    if len(roots.where(F.col("n") >= min_size).take(2)) > 1:  # trees part from each other
        large = parts.where("close is null").join(sizes, "node").groupBy("part").agg(F.sum("size").alias("n")).where(F.col("n") >= min_size)
        parts = parts.join(large.select("part", F.lit(True).alias("tree")), "part", "left")
        parts = parts.withColumn("born", F.col("born") | F.coalesce("tree", F.lit(False))).drop("tree")
    found = cut_lineage(part_clusters(parts, cores, forest, min_size))
    clusters = found.where("cluster is not null").join(sizes, "node").groupBy("cluster").agg(F.sum("size").alias("n"))
    numbered = dense_index(clusters, [F.desc("n"), F.asc("cluster")], "topic_id").select("cluster", F.col("topic_id").cast("int"))
    named = found.join(numbered, "cluster").select("node", "topic_id", F.col("strength").alias("topic_probability"))
    return known.join(named, "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("topic_id", F.lit(-1)).alias("topic_id"), F.coalesce("topic_probability", F.lit(0.0)).alias("topic_probability")
    )
