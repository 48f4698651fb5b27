"""Minimum spanning forests and components of edge tables, by Borůvka rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut_lineage


def _roots(picked: DataFrame) -> DataFrame:
    """(node, root) for pointers (node, next) in which every cycle has two nodes: pointers are doubled until none moves."""
    back = picked.select(F.col("node").alias("next"), F.col("next").alias("node"))
    mutual = picked.join(back, ["node", "next"], "left_semi").where("node < next").select("node")
    heads = mutual.select("node", F.col("node").alias("next"))
    now = cut_lineage(picked.join(mutual, "node", "left_anti").unionByName(heads))
    while True:
        onward = now.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = cut_lineage(now.join(onward, "next").select("node", F.col("far").alias("next"), (F.col("far") != F.col("next")).alias("moved")))
        now = moved.select("node", "next")
        if moved.where("moved").isEmpty():
            return now.withColumnRenamed("next", "root")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Minimum spanning forest of ``edges`` (u, v, w, …) and the components of its nodes.

    Edges are undirected; all columns behind u and v order them, then the ends
    themselves, so that the forest is unique.  Every round each component takes
    its lightest edge to another one; the picked edges are the forest's, their
    components become the nodes of the next round, and of several edges between
    two of them the lightest stays.  Each round is written to the shared folder,
    the number of rounds grows with the logarithm of the nodes, and no
    component's edges meet in one row.  Loops and repeated edges change nothing.

    Returns (forest with the columns of ``edges`` and u < v, labels (node, component)).
    """
    weight = [c for c in edges.columns if c not in ("u", "v")]
    ends = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    key = F.struct(*weight, "u", "v")
    now = edges.where("u <> v").select(*ends, *weight)
    now = cut_lineage(now.groupBy("u", "v").agg(F.min(F.struct(*weight)).alias("x")).select("u", "v", "x.*"))
    now = now.select(F.col("u").alias("a"), F.col("v").alias("b"), key.alias("edge"))
    labels = cut_lineage(now.select(F.col("a").alias("node")).union(now.select("b")).distinct().withColumn("component", F.col("node")))
    parts: list[DataFrame] = []
    while not now.isEmpty():
        ways = now.select(F.col("a").alias("node"), F.struct("edge", F.col("b").alias("next")).alias("way"))
        ways = ways.unionByName(now.select(F.col("b").alias("node"), F.struct("edge", F.col("a").alias("next")).alias("way")))
        best = cut_lineage(ways.groupBy("node").agg(F.min("way").alias("way")).select("node", "way.edge", "way.next"))
        parts.append(best.select("edge").distinct())
        roots = _roots(best.select("node", "next"))
        for end in ("a", "b"):
            now = now.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end)
        pair = [F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")]
        now = cut_lineage(now.where("ra <> rb").select(*pair, "edge").groupBy("a", "b").agg(F.min("edge").alias("edge")))
        onward = roots.withColumnRenamed("node", "component")
        labels = labels.join(onward, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        labels = cut_lineage(labels)
    forest = parts[0] if parts else now.select("edge")
    for part in parts[1:]:
        forest = forest.union(part)
    return forest.select("edge.u", "edge.v", *(F.col("edge")[c].alias(c) for c in weight)), labels
