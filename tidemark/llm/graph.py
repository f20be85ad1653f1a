"""Connected components of an edge table by alternating large-star and small-star steps.

Each step keeps one row an edge and needs a minimum per node, never a node's list of neighbours, so a node with very many
edges is pre-aggregated like any other key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours point at the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point at the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    step = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return step.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, root for every node of edges(u, v) but the roots themselves; root is the smallest node of its component."""
    edges = written(edges.select("u", "v").where("u != v").distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("s")).first()
        if tuple(now) == mark or not now["n"]:
            return edges.select("u", F.col("v").alias("root"))
        mark = tuple(now)
        edges = written(_small(_large(edges)), "edges")
