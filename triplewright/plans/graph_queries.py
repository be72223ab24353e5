"""Queries over the graph: S-31 to S-38, S-78."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import graph
from .base import kg_edges, query

KEYWORD = "an"

RETRIEVE = """
WITH m AS (
  SELECT 1 AS p, * FROM kg_edges WHERE contains(lower(src), 'an')
  UNION ALL SELECT 2, * FROM kg_edges WHERE contains(lower(dst), 'an')
  UNION ALL SELECT 3, * FROM kg_edges WHERE contains(lower(label), 'an') OR contains(lower(source), 'an')
), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY edge_ord) AS n FROM m
), f AS (SELECT *, row_number() OVER (PARTITION BY src, dst, label, coalesce(sentence, '') ORDER BY p, edge_ord) AS u FROM r WHERE n <= 50
), hits AS (SELECT edge_ord, src, dst, label, source, sentence,
  CASE p WHEN 1 THEN 'source_label' WHEN 2 THEN 'target_label' ELSE 'rel_props' END AS match_pattern FROM f WHERE u = 1)
"""


@query("s31_source_label", "SELECT edge_ord, src FROM kg_edges WHERE contains(lower(src), 'an')")
def s31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg_edges(spark, sf_dir).where(F.contains(F.lower("src"), normalize(F.lit(KEYWORD)))).select("edge_ord", "src")


@query("s32_target_label", "SELECT edge_ord, dst FROM kg_edges WHERE contains(lower(dst), 'an')")
def s32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg_edges(spark, sf_dir).where(F.contains(F.lower("dst"), normalize(F.lit(KEYWORD)))).select("edge_ord", "dst")


@query(
    "s33_relation_properties",
    "SELECT edge_ord, label, source FROM kg_edges WHERE contains(lower(coalesce(label, '')), 'cat') OR contains(lower(coalesce(source, '')), 'cat')",
)
def s33(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("cat"))
    return kg_edges(spark, sf_dir).where(has("label") | has("source")).select("edge_ord", "label", "source")


@query("s34_retrieve", RETRIEVE + "SELECT * FROM hits")
def s34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.retrieve(kg_edges(spark, sf_dir), KEYWORD, 50).drop("pattern")


@query("s35_keyword_subgraph", RETRIEVE + "SELECT edge_ord, src, dst, label, source, sentence FROM hits")
def s35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.retrieve(kg_edges(spark, sf_dir), KEYWORD, 0).drop("pattern", "match_pattern")


@query(
    "s36_sentences_into_node",
    "SELECT DISTINCT sentence FROM kg_edges WHERE dst = 'EUROPE' AND sentence IS NOT NULL",
)
def s36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sentences_into(kg_edges(spark, sf_dir), "EUROPE")


@query(
    "s37_neighbourhood",
    """
SELECT src AS node, dst AS other, edge_ord, label FROM kg_edges WHERE src = 'NATION_8'
UNION ALL SELECT dst, src, edge_ord, label FROM kg_edges WHERE dst = 'NATION_8' AND src <> dst
""",
)
def s37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(kg_edges(spark, sf_dir), "NATION_8")


@query(
    "s38_reachable",
    """
WITH RECURSIVE p AS (SELECT src AS a, dst AS b FROM kg_edges UNION SELECT dst, src FROM kg_edges),
r AS (SELECT 'NATION_8' AS node UNION SELECT p.b FROM r JOIN p ON p.a = r.node)
SELECT node FROM r
""",
)
def s38r(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("NATION_8",)], "node string")
    return graph.reachable(kg_edges(spark, sf_dir), start).select("node")


@query(
    "s38_siblings",
    """
SELECT DISTINCT e.src AS sibling FROM kg_edges e JOIN kg_edges p ON e.dst = p.dst AND p.src = 'NATION_8'
WHERE e.label = 'is_part_of' AND p.label = 'is_part_of' AND e.src <> 'NATION_8'
""",
)
def s38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.siblings(kg_edges(spark, sf_dir), "NATION_8", "is_part_of", "EUROPE")


@query("s38b_one_hop", "SELECT DISTINCT src FROM kg_edges WHERE label = 'is_located_in' AND dst = 'NATION_8'")
def s38b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.one_hop(kg_edges(spark, sf_dir), "is_located_in", "NATION_8")


@query(
    "s38b_node_count", "SELECT count(DISTINCT n) AS nodes FROM (SELECT src AS n FROM kg_edges UNION ALL SELECT dst FROM kg_edges)"
)
def s38b_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_count(kg_edges(spark, sf_dir))


@query(
    "s38c_search_rows",
    "SELECT edge_ord FROM kg_edges WHERE contains(lower(src || ' ' || label || ' ' || dst), 'ring is')",
)
def s38c(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kg_edges(spark, sf_dir).selectExpr("edge_ord", "src AS subject", "label AS predicate", "dst AS object")
    return graph.search_rows(rows, " Ring IS").select("edge_ord")


@query(
    "s78_payload_nodes",
    """
SELECT 'n_' || left(sha1(label), 12) AS id, label, min(first) AS first FROM (
  SELECT src AS label, edge_ord * 2 AS first FROM kg_edges UNION ALL SELECT dst, edge_ord * 2 + 1 FROM kg_edges) GROUP BY label
""",
)
def s78n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.payload_nodes(kg_edges(spark, sf_dir))


@query(
    "s78_payload_edges",
    RETRIEVE
    + """
SELECT 'e' || (row_number() OVER (ORDER BY edge_ord) - 1) AS id, 'n_' || left(sha1(src), 12) AS source,
  'n_' || left(sha1(dst), 12) AS target, label FROM hits
""",
)
def s78e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.payload_edges(graph.retrieve(kg_edges(spark, sf_dir), KEYWORD))
