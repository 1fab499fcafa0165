"""Connected components of an edge table, by alternating large and small stars.

Every node keeps only links to smaller nodes. A round first joins each node's larger neighbours to its
smallest neighbour (large star), then all its smaller neighbours to the smallest of them (small star),
until each node's one link is to a node without a link, the smallest of its component. All tables stay distributed and each round
is written to the shared folder. Rows are grouped by their larger end only; by the smaller end, which may
have very many, they are joined with a stored table, so that adaptive execution can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Edges (a, b) of numbers: (node, component) for each node that has an edge to another; component
    is the smallest node reachable. Null ends and loops are ignored."""
    now = scratch.put(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"
    )
    for k in range(1, MAX_ROUNDS):
        least = scratch.put(now.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least-{k}")
        large = now.join(least.toDF("b", "m").hint("merge"), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(near, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.put(small.union(near.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-least-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = new
        # done if each node has one link and none is linked to that has a link
        links, nodes = new.agg(F.count("*"), F.count_distinct("a")).first()
        if links == nodes and new.select(F.col("b").alias("a")).distinct().join(new.select("a").hint("merge"), "a", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return new.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
