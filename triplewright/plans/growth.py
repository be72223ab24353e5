"""The whole way: what documents say, held against the graph, judged, and merged into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoder, text
from ..operators import graph, merge, novelty, triples, vectors
from ..params import Params
from ..steps import checkpointed, written
from .base import kg_edges, query

PREDICATES = ("is part of", "is located in", "is kind of")


def candidates(qualities: DataFrame, edges: DataFrame, params: Params) -> DataFrame:
    """Distinct qualities (id, quality) with max_score, kept and neighbors (rank, score, sentence) from the graph."""
    said = text.relation_text(F.col("sentence"), F.col("src"), F.col("label"), F.col("dst"))
    told = edges.select(F.col("edge_ord").alias("id"), said.alias("text"))
    asked = checkpointed(qualities.select("id", F.col("quality").alias("text")))
    # written, since the search passes over them several times; Parquet keeps the few distinct parts in a dictionary
    hits = vectors.top_k(written(encoder.encoded(asked)), written(encoder.encoded(told)), params.top_k)
    rows = vectors.filter_by_similarity(asked.withColumnRenamed("text", "quality"), hits, params.top_k, params.threshold)
    near = rows.select("id", F.explode("neighbors").alias("n")).join(told.withColumnRenamed("id", "edge"), F.col("n.edge_id") == F.col("edge"))
    near = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n.rank", "n.score", F.col("text").alias("sentence")))).alias("near"))
    none = F.array().cast("array<struct<rank:int,score:double,sentence:string>>")
    return rows.drop("neighbors").join(near, "id", "left").withColumn("neighbors", F.coalesce("near", none)).drop("near")


def judged(rows: DataFrame, params: Params) -> DataFrame:
    return novelty.by_rules(novelty.inputs(rows.where("kept"), params.novelty_neighbors))


def grown(edges: DataFrame, verdicts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(snapshot, summary): the graph with the triples that patterns find in new qualities."""
    new = novelty.qualifying(verdicts, None, enabled=True)
    found = triples.by_patterns(new.select(F.col("id").alias("edge_ord"), F.col("quality").alias("sentence")), list(PREDICATES))
    found = found.where("subject is not null").selectExpr(
        "edge_ord", "subject AS src", "object AS dst", "predicate AS label", "'documents' AS source", "sentence"
    )
    times = {c: F.lit(None).cast("timestamp") for c in ("created_at", "last_updated_at")}
    snapshot, summary, _ = merge.upsert_batch(edges.withColumns(times), found.withColumns(times), now)
    return snapshot, summary


def _sayings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences about other members of the graph, as documents would say them."""
    edges = kg_edges(spark, sf_dir).where("label <> 'is_part_of'")
    said = F.concat(F.col("src"), F.lit(" is "), F.when(F.col("label") == "is_kind_of", "kind of").otherwise("located in"), F.lit(" "), F.col("dst"))
    return edges.select(F.col("edge_ord").alias("id"), said.alias("quality"))


@query("flagship_growth")
def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decision, n over the sentences of the star schema held against its graph."""
    params = Params(threshold=0.3)
    rows = candidates(_sayings(spark, sf_dir), kg_edges(spark, sf_dir), params)
    return novelty.counts(judged(rows, params))


@query(
    "flagship_subgraph",
    """
WITH m AS (
  SELECT 1 AS p, * FROM kg_edges WHERE contains(lower(src), 'an')
  UNION ALL SELECT 2, * FROM kg_edges WHERE contains(lower(dst), 'an')
  UNION ALL SELECT 3, * FROM kg_edges WHERE contains(lower(label), 'an') OR contains(lower(source), 'an')
), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY edge_ord) AS n FROM m
), f AS (SELECT *, row_number() OVER (PARTITION BY src, dst, label, coalesce(sentence, '') ORDER BY p, edge_ord) AS u FROM r WHERE n <= 50)
SELECT 'n_' || left(sha1(label), 12) AS id, label, min(first) AS first, count(*) AS degree FROM (
  SELECT src AS label, edge_ord * 2 AS first FROM f WHERE u = 1 UNION ALL SELECT dst, edge_ord * 2 + 1 FROM f WHERE u = 1) GROUP BY label
""",
)
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph says about a keyword: the nodes of its subgraph and how many edges each has there."""
    hits = graph.retrieve(kg_edges(spark, sf_dir), "an")
    degree = hits.select(F.explode(F.array("src", "dst")).alias("label")).groupBy("label").agg(F.count("*").alias("degree"))
    return graph.payload_nodes(hits).join(degree, "label").select("id", "label", "first", "degree")
