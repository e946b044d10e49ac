"""Connected components by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.plans.durable import durable, forget


def components(links: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): the component is the least node reached over ``links``; nodes without links don't appear.

    Each round hooks every root onto the least root it touches and then jumps pointers (parent := parent of parent)
    until all trees are flat, so chains halve per jump and the rounds grow with the logarithm of the diameter.
    Work is a join and a min-aggregate per jump; a hub contributes one row per link and is combined before the shuffle.
    Null ends are ignored, a node linked only to itself is a component; an empty frame gives an empty frame.
    """
    ends = durable(links.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct(), "links")
    nodes = ends.select(F.col("u").alias("node")).union(ends.select("v")).distinct()
    tree = durable(nodes.select("node", F.col("node").alias("root")), "roots")
    edges, written = ends.where("u <> v"), ends
    while True:
        # what is left of the links between different roots
        ru, rv = tree.toDF("u", "x"), tree.toDF("v", "y")
        left = durable(edges.join(ru, "u").join(rv, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "links")
        forget(written)
        edges = written = left
        if edges.isEmpty():
            return tree.toDF("node", "component")
        hook = durable(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")), "hooks")
        moved = True
        while moved:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = durable(hook.select("node", "root").join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "hooks")
            forget(hook)
            hook, moved = jumped, not jumped.where("moved").isEmpty()
        grown = durable(tree.join(hook.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
        forget(tree, hook)
        tree = grown
