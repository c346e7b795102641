"""Connected components by alternating star contraction.

Every round replaces edges by edges to smaller nodes until each component is a star around its
smallest node.  A hub is only ever touched by an aggregate and an equi join, so it is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    full = _both_ways(edges)
    low = full.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    bigger = full.where(F.col("v") > F.col("u")).join(low, "u")
    return bigger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "id_1", b: str = "id_2", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node."""
    current = cut_lineage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = _fingerprint(current)
    for _ in range(max_rounds):
        # each round is checkpointed: lineage stays short and a lost executor costs one round
        current = cut_lineage(_small_star(_large_star(current)))
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component"))).distinct()


def component_of(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Add ``component`` to every node; a node without edges is its own component."""
    found = connected_components(edges)
    return nodes.join(found, nodes[key] == found["node"], "left").drop("node").withColumn("component", F.coalesce("component", F.col(key)))
