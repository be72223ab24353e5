"""Connected components of an edge table, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges(a, b)`` can reach.

    Alternates two steps until nothing changes. Large star: the larger neighbours of a node go to
    its smallest neighbour. Small star: the smaller neighbours of a node, and the node, go to
    their smallest. Both are a grouped minimum and a join, so no neighbourhood is ever in one
    place, and the rounds grow with the logarithm of a component's size. A null end or a loop
    adds nothing; repeated edges count once.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # v > u by each edge's direction
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialize(small.union(below.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def roots(parents: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of each node of a forest: ``parents(node, root)`` names one other node above each, the smaller one.

    Pointer jumping: in a round each node goes to where the one above it points, so that rounds grow with the logarithm
    of the depth. A root has no row. Nulls are not expected; no rows give none.
    """
    now = stored(parents.select("node", "root"))
    for _ in range(most_rounds):
        above = now.select(F.col("node").alias("root"), F.col("root").alias("top"))
        now = stored(now.select("node", "root").join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("node", "root")
    raise RuntimeError(f"roots were not reached in {most_rounds} rounds")
