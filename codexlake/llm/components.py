"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.cluster import settle


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40))).alias("s")).first()
    return tuple(r)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node that has an edge (columns a, b); component is the smallest node reached.

    Each step joins the edges with the smallest neighbour of their node, which is aggregated before
    the shuffle; a hub's edges are only ever one side of that join, so a skewed one can be split.
    Rounds end when the edge set, by then a star for each component, stays the same. Their number grows
    with the logarithm of the longest path; a set still in change after `most_rounds` is an error.
    Edges with a null end and loops link nothing. No edges give no rows.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = _state(edges)
    for _ in range(most_rounds):
        if not last[0]:
            break
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("n")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = settle(small.distinct())
        now = _state(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components are still changing after {most_rounds} rounds")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
