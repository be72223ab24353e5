"""Graph queries over the edge table: keyword retrieval, neighbourhoods, reachability, payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..steps import checkpointed

#: The names of the patterns, by rank.
PATTERNS = ("source_label", "target_label", "rel_props")


def retrieve(edges: DataFrame, keyword: str, limit: int | None = 50) -> DataFrame:
    """Edges that match a keyword, with match_pattern; the first of equal facts stays.

    The keyword, normalised, is a literal part of the source label, the target label, or one of
    label and source. Each pattern gives its first ``limit`` edges by edge_ord (0 or None: 50); an
    edge is read once for all three. Facts are equal by src, dst, label and sentence.
    """
    kw = text.normalize(F.lit(keyword))
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), kw)
    found = F.array_compact(
        F.array(F.when(has("src"), 1), F.when(has("dst"), 2), F.when(has("label") | has("source"), 3))
    )
    rows = edges.where(has("src") | has("dst") | has("label") | has("source")).withColumn("pattern", F.explode(found))
    nth = F.row_number().over(Window.partitionBy("pattern").orderBy("edge_ord"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= (limit or 50)).drop("nth")
    fact = ["src", "dst", "label", F.coalesce("sentence", F.lit(""))]
    first = F.row_number().over(Window.partitionBy(*fact).orderBy("pattern", "edge_ord"))
    rows = rows.withColumn("first", first).where("first = 1").drop("first")
    return rows.withColumn("match_pattern", F.element_at(F.array(*map(F.lit, PATTERNS)), F.col("pattern")))


def sentences_into(edges: DataFrame, label: str) -> DataFrame:
    """The distinct sentences of edges into one node."""
    return edges.where((F.col("dst") == label) & F.col("sentence").isNotNull()).select("sentence").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """node, other, edge_ord, label: each edge from both its ends; a loop once."""
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "edge_ord", "label")
    back = edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), "edge_ord", "label")
    return there.union(back)


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    return undirected(edges).where(F.col("node") == node)


def reachable(edges: DataFrame, start: DataFrame, most_steps: int = 1000) -> DataFrame:
    """node, steps: what can be reached from the nodes of ``start``, either way along edges, by breadth."""
    pairs = checkpointed(undirected(edges).select("node", "other").distinct())
    seen = front = checkpointed(start.select("node", F.lit(0).alias("steps")).distinct())
    for step in range(1, most_steps + 1):
        new = pairs.join(front.select("node"), "node").select(F.col("other").alias("node")).distinct()
        front = checkpointed(new.join(seen.select("node"), "node", "left_anti").withColumn("steps", F.lit(step)))
        if front.isEmpty():
            return seen
        seen = checkpointed(seen.union(front))
    raise RuntimeError(f"more than {most_steps} steps")


def distance(edges: DataFrame, one: str, two: str, most_steps: int = 1000) -> int | None:
    """The fewest steps between two nodes, either way along edges; None if there is no way.

    Both ends go out in turn, the smaller front first, and stop when they meet, so that a graph is
    walked half as deep from each as from one, and nothing beyond. A front that is small enough goes to
    the edges (AQE broadcasts by measured size), so a hub's edges stay where they are.
    """
    if one == two:
        return 0
    spark = edges.sparkSession
    pairs = undirected(edges).select("node", "other").distinct()
    starts = [spark.createDataFrame([(n, 0)], "node string, steps int") for n in (one, two)]
    seen, front, size, depth, pairs = list(starts), list(starts), [1, 1], [0, 0], checkpointed(pairs)
    while sum(depth) < most_steps:
        a = 0 if size[0] <= size[1] else 1
        depth[a] += 1
        new = pairs.join(front[a].select("node"), "node").select(F.col("other").alias("node")).distinct()
        front[a] = checkpointed(new.join(seen[a].select("node"), "node", "left_anti").withColumn("steps", F.lit(depth[a])))
        met = front[a].join(seen[1 - a].select("node", F.col("steps").alias("there")), "node").agg(F.min("there")).first()[0]
        if met is not None:
            return depth[a] + met
        size[a] = front[a].count()
        if not size[a]:
            return None
        seen[a] = seen[a].union(front[a])
    raise RuntimeError(f"more than {most_steps} steps")


def siblings(edges: DataFrame, node: str, predicate: str, risk: str) -> DataFrame:
    """Nodes with a parent in common with ``node`` by ``predicate``, if it is linked with ``risk`` at any depth."""
    up = edges.where(F.col("label") == predicate).select("src", "dst").distinct()
    parents = up.where(F.col("src") == node).select("dst")
    found = up.join(parents, "dst", "left_semi").where(F.col("src") != node).select(F.col("src").alias("sibling")).distinct()
    return found if distance(edges, node, risk) is not None else found.limit(0)


def one_hop(edges: DataFrame, predicate: str, target: str) -> DataFrame:
    return edges.where((F.col("label") == predicate) & (F.col("dst") == target)).select("src").distinct()


def node_count(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("n")).agg(F.countDistinct("n").alias("nodes"))


def search_rows(rows: DataFrame, words: str) -> DataFrame:
    """Review rows whose subject, predicate and object together hold a text, without regard to case."""
    whole = F.lower(F.concat_ws(" ", "subject", "predicate", "object"))
    return rows.where(F.contains(whole, F.lower(F.trim(F.lit(words)))))


def payload_nodes(edges: DataFrame) -> DataFrame:
    """id, label, first: the nodes of edges in the order they are first seen, source before target."""
    ends = edges.select("edge_ord", F.posexplode(F.array("src", "dst")).alias("end", "label"))
    first = ends.groupBy("label").agg(F.min(F.col("edge_ord") * 2 + F.col("end")).alias("first"))
    return first.select(text.node_id(F.col("label")).alias("id"), "label", "first")


def payload_edges(edges: DataFrame) -> DataFrame:
    """id (e0, e1, ...), source, target, label of the edges of one retrieval, by edge_ord.

    Numbering needs one order over all rows; it is for answers of bounded size.
    """
    nth = F.row_number().over(Window.orderBy("edge_ord")) - 1
    return edges.select(
        F.concat(F.lit("e"), nth).alias("id"),
        text.node_id(F.col("src")).alias("source"),
        text.node_id(F.col("dst")).alias("target"),
        "label",
    )
