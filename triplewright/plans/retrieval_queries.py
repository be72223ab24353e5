"""Queries over vectors and retrieval: S-50 to S-52, S-68."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoder
from ..functions import text
from ..operators import postings, retrieval, vectors
from ..steps import shared_folder
from .base import kg_edges, paragraphs, query, table
from .base import vectors as sides

TOP = """
WITH u AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
pairs AS (SELECT q.id AS query_id, i.id AS item_id,
  CASE WHEN q.norm = 0 OR i.norm = 0 THEN 0 ELSE list_inner_product(q.v, i.v) / q.norm / i.norm END AS score
  FROM u q JOIN u i ON q.id % 100 = 0 AND i.id <> q.id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pairs)
"""


@query(
    "s50_unit_vectors",
    """
WITH u AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)
SELECT id, round(list_max(v) / norm, 4) AS high, round(list_min(v) / norm, 4) AS low FROM u
""",
)
def s50(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vectors.unit(F.col("embedding").cast("array<double>"), 64).alias("v"))
    return rows.select("id", F.round(F.array_max("v"), 4).alias("high"), F.round(F.array_min("v"), 4).alias("low"))


@query(
    "s51_cosine_top_k",
    TOP + "SELECT query_id, rank::INTEGER AS rank, item_id, round(score, 4) AS score FROM top WHERE rank <= 5",
)
def s51(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(*sides(spark, sf_dir), 5, others=True).withColumn("score", F.round("score", 4))


@query("s51b_approximate_top_k")
def s51b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.approximate_top_k(*sides(spark, sf_dir), 5, others=True)


@query(
    "s52_similarity_filter",
    TOP
    + """
SELECT query_id AS id, round(max(score), 4) AS max_score, max(score) >= 0.25 AS kept,
  CASE WHEN max(score) >= 0.25 THEN string_agg(item_id::VARCHAR, ',' ORDER BY rank) ELSE '' END AS neighbors FROM top WHERE rank <= 5 GROUP BY query_id
""",
)
def s52(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, given = sides(spark, sf_dir)
    rows = vectors.filter_by_similarity(asked.select("id"), vectors.top_k(asked, given, 5, others=True), 5, 0.25)
    ids = F.array_join(F.transform("neighbors", lambda n: n["edge_id"].cast("string")), ",")
    return rows.select("id", F.round("max_score", 4).alias("max_score"), "kept", ids.alias("neighbors"))


@query("s52b_edge_index")
def s52b(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = text.relation_text(F.col("sentence"), F.col("src"), F.col("label"), F.col("dst"))
    return encoder.encoded(kg_edges(spark, sf_dir).select(F.col("edge_ord").alias("id"), said.alias("text")))


BM25 = r"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(trim(text, E' \t\n\x0b\f\r'), '[\x20\t\n\x0b\f\r]+')) AS word FROM documents),
t AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf) AS size FROM t GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(size) FROM sizes) / (SELECT count(*) FROM documents) AS avgdl),
d AS (SELECT word, ln(n::DOUBLE - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM t, n GROUP BY word, n),
i AS (SELECT word, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM d) ELSE idf END AS idf FROM d),
q AS (SELECT item_id AS query_id, unnest(string_split_regex(trim(lower(text), E' \t\n\x0b\f\r'), '[\x20\t\n\x0b\f\r]+')) AS word FROM benchmark),
g AS (SELECT query_id, word, count(*) AS times FROM q WHERE word <> '' GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / avgdl))), 6) AS score
  FROM g JOIN i USING (word) JOIN t USING (word) JOIN sizes USING (doc_id), n GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
"""


def _lexical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", "text"), asked


@query("s52c_bm25", BM25 + "SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 3) AS score FROM bm WHERE rank <= 4")
def s52c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(*_lexical(spark, sf_dir)).withColumn("score", F.round("score", 3))


@query("s52c_posting_blocks", BM25 + "SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 3) AS score FROM bm WHERE rank <= 4")
def s52i(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _lexical(spark, sf_dir)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    postings.build(docs, path)
    return postings.search(spark, path, asked).withColumn("score", F.round("score", 3))


@query("s52d_diverse")
def s52d(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, given = sides(spark, sf_dir)
    hits = vectors.top_k(asked, given, 20, others=True)
    return retrieval.diverse(hits, given.select("id", vectors.unit(F.col("vec")).alias("vec")), 4)


@query(
    "s52e_rank_fusion",
    BM25
    + """
, o AS (SELECT query_id, doc_id, count(*) AS score FROM (SELECT DISTINCT query_id, word FROM g) JOIN t USING (word) GROUP BY ALL),
ov AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM o),
r AS (SELECT query_id, doc_id, 0.7::DOUBLE / (60 + rank) AS part FROM bm WHERE rank <= 10
  UNION ALL SELECT query_id, doc_id, 0.3::DOUBLE / (60 + rank) FROM ov WHERE rank <= 10),
f AS (SELECT query_id, doc_id, round(sum(part), 9) AS score FROM r GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM z WHERE rank <= 4
""",
)
def s52e(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _lexical(spark, sf_dir)
    both = retrieval.fused(retrieval.bm25(docs, asked, 10), retrieval.overlap(docs, asked, 10), alpha=0.7, k=4)
    return both.withColumn("score", F.round("score", 6))


@query(
    "s52f_threshold_retrieval",
    TOP + "SELECT query_id, rank::INTEGER AS rank, item_id, round(score, 4) AS score FROM top WHERE rank <= 10 AND score >= 0.25",
)
def s52f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(*sides(spark, sf_dir), 10, others=True).where("score >= 0.25").withColumn("score", F.round("score", 4))


@query(
    "s52g_contexts",
    BM25
    + """
SELECT query_id, sha256('Context:' || string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS context_sha256
FROM bm JOIN documents USING (doc_id) WHERE rank <= 4 GROUP BY query_id
""",
)
def s52g(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _lexical(spark, sf_dir)
    return retrieval.contexts(retrieval.bm25(docs, asked), docs, "Context:").select("query_id", F.sha2("context", 256).alias("context_sha256"))


#: The same over the sentences of edges, asked by those into one node.
SENTENCES = BM25.replace("FROM documents", "FROM e").replace("FROM benchmark", "FROM asked").replace(
    "WITH w AS",
    "WITH e AS (SELECT edge_ord AS doc_id, lower(sentence) AS text FROM kg_edges), "
    "asked AS (SELECT DISTINCT sentence AS item_id, sentence AS text FROM kg_edges WHERE dst = 'EUROPE'), w AS",
)


@query(
    "s52h_expanded_sentences",
    SENTENCES + "SELECT query_id AS sentence, rank::INTEGER AS rank, doc_id FROM bm JOIN e USING (doc_id) WHERE rank <= 4 AND text <> query_id",
)
def s52h(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = kg_edges(spark, sf_dir)
    from ..operators.graph import sentences_into

    docs = edges.select(F.col("edge_ord").alias("doc_id"), F.lower("sentence").alias("text"))
    return retrieval.expanded(sentences_into(edges, "EUROPE"), docs)


@query("s68_encoded_paragraphs")
def s68(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).select(F.concat_ws(":", "doc_id", "ord").alias("id"), F.col("body").alias("text"))
    return encoder.encoded(rows).select("id", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm"))
