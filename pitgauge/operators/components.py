"""Connected components by rounds of joins on edges that shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgauge.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b: of one type that has an order), where component is the smallest node reachable.

    Each round hangs every node on its smallest neighbour if that is smaller, shortens the paths to the roots by doubling, and
    moves the edges to the roots; edges inside a tree vanish. A hot node is only ever the unique side of a join or is
    combined before the shuffle. Loops, repeated edges and null ends are ignored; no edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v and a is not null and b is not null")
    left = cut_lineage(pairs.distinct())
    roots = None
    while not left.isEmpty():
        tree = cut_lineage(left.groupBy("u").agg(F.min("v").alias("v")))
        while True:
            up = tree.select(F.col("u").alias("v"), F.col("v").alias("top"))
            longer = cut_lineage(tree.join(up, "v", "left").select("u", F.coalesce("top", "v").alias("v"), F.col("top").isNotNull().alias("moved")))
            moved = longer.where("moved").isEmpty()
            tree = longer.select("u", "v")
            if moved:
                break
        at_u = tree.select("u", F.col("v").alias("ru"))
        at_v = tree.select(F.col("u").alias("v"), F.col("v").alias("rv"))
        ends = left.join(at_u, "u", "left").join(at_v, "v", "left").select(F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b"))
        left = cut_lineage(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        if roots is None:
            roots = tree
        else:
            moved_up = roots.join(tree.select(F.col("u").alias("v"), F.col("v").alias("top")), "v", "left").select("u", F.coalesce("top", "v").alias("v"))
            roots = cut_lineage(moved_up.union(tree).groupBy("u").agg(F.min("v").alias("v")))
    if roots is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    tops = roots.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    return roots.union(tops).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
