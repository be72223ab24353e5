"""Queries over sources and text: S-01 to S-30."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import records
from ..sources import readers
from .base import kg_edges, paragraphs, query, table

BLANK = r"E' \t\n\x0b\f\r'"


@query(
    "s01_text_sentences",
    rf"""
WITH l AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
    lambda x: trim(x, {BLANK}) <> '') AS k FROM documents
), e AS (SELECT doc_id, unnest(k) AS line, generate_subscripts(k, 1) - 1 AS page_number FROM l)
SELECT doc_id AS source, page_number::INTEGER AS page_number,
  regexp_replace(trim(line, {BLANK}), '[!-/:-@\[-`{{-~]+$', '') AS sentence FROM e
""",
)
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.text_sentences(table(spark, sf_dir, "documents"), "doc_id")


@query("s02_chunks")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return readers.chunked(docs.select("doc_id", F.lit(1).alias("page_number"), F.col("text").alias("body")))


@query("s03_cleaned_chunks")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return readers.cleaned_chunks(docs.select("doc_id", F.lit(1).alias("page_number"), F.col("text").alias("body")))


@query("s04_paragraphs", "SELECT doc_id, ord::INTEGER AS ord, body FROM paragraphs")
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.paragraphs_of(table(spark, sf_dir, "documents"), need=True)


@query(
    "s05_pages",
    """
WITH e AS (SELECT source AS title, doc_id, unnest(string_split(text, chr(10))) AS body,
  generate_subscripts(string_split(text, chr(10)), 1) AS page_number FROM documents)
SELECT title, doc_id, page_number::INTEGER AS page_number, body FROM e WHERE page_number <= 3
""",
)
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.pages_of(table(spark, sf_dir, "documents"), page_limit=3)


@query(
    "s06_chunk_corpus",
    "SELECT 'chunks' AS mode, count(*) AS n, sum(length(body))::BIGINT AS chars FROM paragraphs",
)
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mode = readers.chunk_corpus(table(spark, sf_dir, "documents"), "PDF_PARAGRAPHS")
    return rows.agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))


@query(
    "s07_seed_edges",
    r"""
SELECT p_name AS src, 'is_kind_of' AS label, p_type AS dst, p_name || ' is_kind_of ' || p_type AS sentence, 'part' AS source
FROM part
""",
)
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  "))).alias("source"),
        F.lit("is_kind_of ").alias("relationship"),
        F.col("p_type").alias("destination"),
    )
    return readers.seed_edges(rows, "part", need=True)


@query(
    "s08_merge_counts",
    """
WITH k AS (SELECT DISTINCT src, label, dst FROM kg_edges)
SELECT (SELECT count(*) FROM (SELECT src FROM k UNION SELECT dst FROM k)) AS nodes, (SELECT count(*) FROM k) AS relationships
""",
)
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.seed_totals(kg_edges(spark, sf_dir))


@query(
    "s10_coerced_edges",
    """
SELECT edge_ord, src, dst, source, sentence, label, edge_ord::VARCHAR AS source_id, '' AS target_id FROM kg_edges
""",
)
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kg_edges(spark, sf_dir).withColumns(
        {"type": F.lit(None).cast("string"), "source_id": F.col("edge_ord"), "target_id": F.lit(None).cast("long")}
    )
    return readers.coerced_edges(rows)


@query(
    "s13_normalize_text",
    rf"SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normal FROM documents",
)
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


@query(
    "s14_sanitize_chunk",
    rf"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS chunk FROM documents",
)
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse(F.col("text")).alias("chunk"))


def _clean_sql(rules: list[str], joiner: str, name: str) -> str:
    drop = " AND ".join(f"NOT regexp_matches(x, '{r}')" for r in rules)
    return rf"""
SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: {drop}),
  lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), {joiner}) AS {name} FROM documents"""


SQL_DOI, SQL_NUMBERED = r"(?i)doi:\s*\d+\.\d+/\S+", r"^\d+[:.]"
SQL_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"


@query("s15_clean_chunks", _clean_sql([SQL_DOI, SQL_NUMBERED, SQL_EMAIL, r"^\s*\d+\s*$"], "' '", "chunk"))
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_lines(F.col("text")).alias("chunk"))


@query("s16_clean_pages", _clean_sql([SQL_DOI, SQL_NUMBERED, SQL_EMAIL], "chr(10)", "page"))
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = text.clean_lines(F.col("text"), text.PAGE_RULES, "\n")
    return table(spark, sf_dir, "documents").select("doc_id", page.alias("page"))


@query(
    "s17_front_matter",
    _clean_sql([SQL_DOI, SQL_NUMBERED, SQL_EMAIL, r"^\s*\d+\s*$", "(?i)(Received|revised|accepted|Keywords|Abstract)"], "' '", "chunk"),
)
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (*text.CHUNK_RULES, text.FRONT_MATTER)
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_lines(F.col("text"), rules).alias("chunk"))


@query(
    "s18_page_sentences",
    rf"""
WITH s AS (SELECT doc_id, ord, list_filter(list_transform(regexp_extract_all(body, '[^.!?]+[.!?]*'),
  lambda x: trim(x, {BLANK})), lambda x: length(x) > 20) AS k FROM paragraphs)
SELECT doc_id, ord::INTEGER AS page_number, unnest(k) AS sentence, (generate_subscripts(k, 1) - 1)::INTEGER AS sentence_index FROM s
""",
)
def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.posexplode(text.sentences(F.col("body"))).alias("sentence_index", "sentence")
    return paragraphs(spark, sf_dir).select("doc_id", F.col("ord").alias("page_number"), found)


@query("s19_long_chunks")
def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pages = docs.select("doc_id", F.lit(1).alias("page_number"), F.col("text").alias("body"))
    return readers.chunked(pages, 2000, 200)


@query(
    "s20_relation_text",
    """
SELECT edge_ord, upper(left(t, 1)) || substr(t, 2) AS text
FROM (SELECT edge_ord, trim(replace(sentence, '_', ' ')) AS t FROM kg_edges)
""",
)
def s20(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = text.relation_text(F.col("sentence"), F.col("src"), F.col("label"), F.col("dst"))
    return kg_edges(spark, sf_dir).select("edge_ord", said.alias("text"))


@query(
    "s22_triple_relations",
    r"""
SELECT 'edge ' || edge_ord AS sentence, lower(src) AS src, lower(label) AS label, lower(dst) AS dst, source FROM kg_edges
""",
)
def s22(spark: SparkSession, sf_dir: str) -> DataFrame:
    triple = F.struct(F.col("src").alias("subject"), F.col("dst").alias("object"), F.col("label").alias("predicate"))
    rows = kg_edges(spark, sf_dir).select(F.concat(F.lit("edge "), F.col("edge_ord")).alias("sentence"), F.array(triple).alias("triplets"), "source")
    return records.relations(rows)


@query(
    "s23_document_relations",
    """
SELECT lower(src) AS src, lower(label) AS label, lower(dst) AS dst, edge_ord AS doc_id, 'document' AS source, sentence AS original_sentence
FROM kg_edges
""",
)
def s23(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = kg_edges(spark, sf_dir)
    triple = F.struct(F.col("src").alias("subject"), F.col("dst").alias("object"), F.col("label").alias("predicate"))
    found = edges.select(F.col("edge_ord").alias("doc_id"), "sentence", F.array(triple).alias("triplets"))
    docs = edges.select(
        F.col("edge_ord").alias("doc_id"),
        F.create_map(F.lit("source"), F.lit("document"), F.lit("original_sentence"), F.col("sentence")).alias("meta"),
    )
    out = records.document_relations(found, docs)
    return out.select("src", "label", "dst", "doc_id", out["extra"]["source"].alias("source"), out["extra"]["original_sentence"].alias("original_sentence"))


@query(
    "s24_allowed_keywords",
    "SELECT DISTINCT c_mktsegment AS keyword, c_mktsegment IN ('BUILDING', 'MACHINERY') AS allowed FROM customer",
)
def s24(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("keyword")).distinct()
    allowed = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "keyword string")
    return records.allowed(asked, allowed)


@query(
    "s29_node_ids",
    "SELECT DISTINCT src AS label, 'n_' || left(sha1(src), 12) AS id FROM kg_edges",
)
def s29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg_edges(spark, sf_dir).select(F.col("src").alias("label")).distinct().withColumn("id", text.node_id(F.col("label")))


@query(
    "s30_underscored",
    "SELECT edge_ord, replace(src, ' ', '_') AS src, lower(replace(label, ' ', '_')) AS label, replace(dst, ' ', '_') AS dst FROM kg_edges",
)
def s30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg_edges(spark, sf_dir).select(
        "edge_ord",
        text.underscored(F.col("src")).alias("src"),
        F.lower(text.underscored(F.col("label"))).alias("label"),
        text.underscored(F.col("dst")).alias("dst"),
    )
