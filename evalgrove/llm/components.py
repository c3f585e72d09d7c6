"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them. Edges have u > v."""
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    moved = edges.join(least, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> Staged:
    """(u, v) of undirected links becomes (u, v) with v the least node of u's component, v itself left out.

    Each round is written to the shared folder and the one before dropped. The rounds needed grow with the
    logarithm of the longest chain.
    """
    now = Staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        after = Staged(_small_star(_large_star(now.df)), "cc")
        now.drop()
        now = after
        row = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_if(F.col("v") >= F.col("u"))).head()
        if tuple(row) == mark:
            return now
        mark = tuple(row)
    raise RuntimeError("components did not settle")
