"""Closures over edges, by rounds that go on to the fixed point."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rounds after which the rows found so far are written as one table.
COMPACT = 8


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth): every ancestor over (child, parent) edges at its smallest depth; cycles are walked once round.

    Paths double: when all pairs up to a distance are known, those at just that distance are followed by one known pair each,
    which gives all pairs up to twice the distance: the beginning of a shortest path is a shortest path too. So a chain of n
    takes log n rounds, a round joins no pair that it would only find again, and an ancestor of everything is a join key for no
    more than the pairs of one depth. A round without a pair that far is the last. Null ends and repeated edges are ignored.
    The result is as large as the relation: on a deep graph ask for less (``cycles``, ``reach``).
    """
    known = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node is not null and ancestor is not null").distinct().withColumn("depth", F.lit(1)).checkpoint()
    depth = 1
    while not known.where(F.col("depth") == depth).isEmpty():
        far = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        longer = known.where(F.col("depth") == depth).join(far, "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        known = known.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")).checkpoint()
        depth *= 2
    return known


def trimmed(edges: DataFrame) -> DataFrame:
    """The (child, parent) edges that may lie on a cycle: edges of a node without parents, or without children, go until none is left."""
    edges = edges.select("child", "parent").where("child is not null and parent is not null").distinct().checkpoint()
    n = edges.count()
    while n:
        inner = edges.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        edges = inner.join(inner.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent").checkpoint()
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that are their own ancestors. The closure is of the trimmed graph alone."""
    return closure(trimmed(edges)).where("node = ancestor").select("node").distinct()


def reach(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes reachable from ``seeds`` (node) over (a, b) edges, seeds included, in rounds until one adds nothing.

    Rounds are merge joins: broadcast, what is found would go through the driver again in each of them.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null").distinct().checkpoint()
    known = fresh = seeds.select("node").distinct().checkpoint()
    for step in count(1):
        fresh = fresh.hint("merge").join(edges, fresh["node"] == edges["a"]).select(F.col("b").alias("node")).distinct().join(known.hint("merge"), "node", "left_anti").checkpoint()
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
        if step % COMPACT == 0:
            known = known.checkpoint()
