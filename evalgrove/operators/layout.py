"""Places of a taxonomy's nodes in a drawing: roots at the top, leaves spread evenly, parents over the middle of their children.

The tree is that of the shortest paths, see taxonomy.node_paths(): of several parents a node hangs under the one
that its path goes through. Leaves stand in the order of a walk that takes siblings by label, which is the order of
their paths from the root down; their places come from one range exchange. Inner nodes are placed level by level from
below; each level is an aggregation of the one beneath, written, so there are as many rounds as the tree is deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrove.operators.ordinals import numbered
from evalgrove.operators.taxonomy import edges, node_paths
from evalgrove.sources.staging import staged

#: What is left free beside the first leaf.
MARGIN = 50


def tree_layout(nodes: DataFrame, x_span: int = 1200, y_span: int = 800, max_depth: int = 64) -> DataFrame:
    """(node, parent, depth, x, y, leaves) of nodes (label, path from the node to the root) and of the root.

    depth is the distance from the root, leaves the number of leaves below a node, itself if it is one. No nodes give
    no rows.
    """
    down = nodes.select(F.col("label").alias("node"), F.get("path", F.lit(1)).alias("parent"), (F.size("path") - 1).alias("depth"), F.reverse("path").alias("down"))
    down = staged(down, "tree")
    if down.isEmpty():
        return down.select("node", "parent", "depth", *[F.lit(0).alias(c) for c in ("x", "y")], F.lit(0).cast("long").alias("leaves"))
    leaves = down.join(down.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    placed = numbered(leaves, "_i", ["down"])
    (total,) = placed.agg(F.count("*")).head()
    x = F.floor(F.lit(float(MARGIN)) + F.col("_i") / F.lit(float(total)) * x_span).cast("int")
    placed = placed.select("node", "parent", "depth", x.alias("x"), F.lit(1).cast("long").alias("leaves"))
    (deepest,) = down.agg(F.max("depth")).head()
    if deepest > max_depth:
        raise ValueError(f"the tree has {deepest} levels, more than {max_depth}")
    out = level = None
    for depth in range(deepest, -1, -1):
        own = placed.where(F.col("depth") == depth)
        if level is not None:
            over = level.groupBy(F.col("parent").alias("node")).agg(F.floor(F.sum("x") / F.count("*")).cast("int").alias("x"), F.sum("leaves").alias("leaves"))
            if depth == 0:
                over = over.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "x", "leaves")
            else:
                over = over.join(down.where(F.col("depth") == depth).select("node", "parent", "depth"), "node").select("node", "parent", "depth", "x", "leaves")
            own = own.unionByName(over)
        level = staged(own, "placed")
        out = level if out is None else out.unionByName(level)
    y = F.floor(F.col("depth") / F.lit(float(deepest)) * y_span).cast("int")
    return out.select("node", "parent", "depth", "x", y.alias("y"), "leaves")


def chain_layout(chains: DataFrame, x_span: int = 1200, y_span: int = 800) -> DataFrame:
    """tree_layout() of the tree that leaf-to-root paths (path) make, such as those of rollouts.sample_chains()."""
    return tree_layout(node_paths(edges(chains)), x_span, y_span)
