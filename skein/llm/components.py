"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import write_shared


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and hash sum: equal for equal sets of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Each round turns neighbourhoods into stars around their smallest node:
    first over all larger neighbours, then over the smaller ones.  The number of
    rounds grows with the logarithm of the longest path.  Every round is written
    to the shared folder; no node's neighbours meet in one row.  Edges with a
    null end are left out; loops and repeated edges change nothing.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = write_shared(now, "edges")
    mark = _fingerprint(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = write_shared(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = write_shared(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        before, mark = mark, _fingerprint(now)
        if mark == before:
            break
    # every edge now leads from a node to the smallest node of its component
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
