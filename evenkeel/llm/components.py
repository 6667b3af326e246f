"""Connected components with DataFrame joins only: alternate large and small stars until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evenkeel.session import cut_lineage


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node it is connected with.

    Edges may repeat, point either way or at themselves; an edge with a NULL end is left out. Nodes may be of any
    orderable type. Every round is two grouped minima (combined before the shuffle) and two joins whose hot side
    can be split, and is written to the shared folder, so a lost executor costs one round at most. The number of
    rounds grows with the logarithm of the longest path, and rows never exceed twice the edges.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = cut_lineage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    now = cut_lineage(_down(pairs))
    before = None
    while True:
        now = cut_lineage(_small_star(_large_star(now)))
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (mark["n"], mark["s"]) == before:
            break
        before = (mark["n"], mark["s"])
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _down(pairs: DataFrame) -> DataFrame:
    """Every edge once, from its larger to its smaller end."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(down: DataFrame) -> DataFrame:
    """Link every neighbour above a node to the least neighbour of the node."""
    both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the planner may split the edges of a hot node: it cannot where one side is an aggregation
    least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return _down(down.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(down: DataFrame) -> DataFrame:
    """Link every neighbour below a node, and the node itself, to the least of them."""
    least = cut_lineage(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _down(moved.unionByName(least.select("u", F.col("m").alias("v"))))
