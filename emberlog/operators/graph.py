"""Connected components of a graph of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node: (node, root), for nodes that have an edge.

    edges(a, b) of any orderable type. Alternates large-star and small-star rounds, which
    need few rounds even on long chains. State stays in tables of the shared folder, two at a
    time: a checkpoint() keeps the size that the planner estimated, a product over its joins,
    so that this number had twice or more digits after each round, until it filled the driver.
    """
    folder = shared_dir(edges.sparkSession)
    e = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, "links0")
    mark = None
    for k in range(1, max_rounds + 1):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("p"))
        e = stored(small.select("p.a", "p.b").where(F.col("a") != F.col("b")).distinct(), folder, f"links{k % 2}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def min_label_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): each node with the smallest node that it can reach over edges(a, b); checkpointed."""
    roots = connected_components(edges).hint("merge")
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component")).checkpoint()
