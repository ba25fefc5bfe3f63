"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenframe.session import ensure_checkpoint_dir


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node of each component.

    ``nodes`` has a column node, ``edges`` a and b. Every round replaces an edge by edges to the
    smaller ends (large star, then small star), which halves distances instead of walking them;
    lineage is cut with a reliable checkpoint, so a lost executor costs one round at most. The
    right side of every join has one row per node, so adaptive execution can split a hub's edges.
    """
    ensure_checkpoint_dir(nodes.sparkSession)

    def canonical(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def signature(e: DataFrame) -> tuple:
        """Number of edges and an order-free sum of their hashes: equal when a round changed nothing."""
        hashed = F.xxhash64("a", "b")
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(hashed, F.lit(1 << 31))), F.bit_xor(hashed)).first())

    current = canonical(edges).checkpoint()
    mark = signature(current)
    for _ in range(max_rounds):
        # Large star: all larger neighbours of a node are tied to its smallest neighbour.
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = canonical(both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # Small star: all smaller neighbours and the node itself are tied to the smallest.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(lowest, "a")
        small = canonical(tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b"))))
        after, before = small.checkpoint(), mark
        mark = signature(after)
        current = after
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    labels = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
