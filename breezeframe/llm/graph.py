"""Connected components of an edge table that never leaves the executors.

Alternates large-star and small-star steps (Kiveris et al., 2014): edges are re-hung on the
smallest known neighbour until every node hangs on the smallest node of its component. The
number of rounds grows with the logarithm of the longest path. Each round is one written
table in the shared folder, so a lost executor costs one round at most. A node with very many
neighbours is pre-aggregated before the shuffle (minimum), and the join back to its
neighbours is a plain equi-join whose hot partition adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeframe.llm.common import materialise


def _signature(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """Columns ``node, component`` for every node that has an edge to another node."""
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = materialise(edges, f"{name}-edges")
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, f"{name}-edges")
        now = _signature(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
