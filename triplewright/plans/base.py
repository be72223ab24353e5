"""The registry, and the tables that queries derive from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows; WITH is put before SQL that names a derived table."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            used: list[str] = []
            for table in DERIVED:
                if table in sql or any(table in DERIVED[u] for u in used):
                    used.append(table)
            body = sql.strip()
            head = ", ".join(f"{t} AS ({DERIVED[t]})" for t in reversed(DERIVED) if t in used)
            if head:
                rest = body[5:].lstrip() if body[:5].upper() == "WITH " else ""
                recursive = "RECURSIVE " if rest[:10].upper() == "RECURSIVE " else ""
                rest = rest[len(recursive) :]
                body = f"WITH {recursive}{head}, {rest}" if rest else f"WITH {head} {body}"
            SQL[name] = body
        return f

    return put


#: SQL of the derived tables; a later one may use those before it, so users come first.
DERIVED = {
    "kg_edges": """
SELECT 1000000000000 + n_nationkey AS edge_ord, n_name AS src, r_name AS dst, 'is_part_of' AS label, 'nation' AS source,
  n_name || ' is_part_of ' || r_name AS sentence FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 2000000000000 + s_suppkey, s_name, n_name, 'is_located_in', 'supplier', s_name || ' is_located_in ' || n_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 3000000000000 + c_custkey, c_name, n_name, 'is_located_in', 'customer', c_name || ' is_located_in ' || n_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 4000000000000 + p_partkey, p_name, p_type, 'is_kind_of', 'part', p_name || ' is_kind_of ' || p_type FROM part""",
    "qualities": r"""
SELECT doc_id, ord, unnest(s) AS quality, generate_subscripts(s, 1) - 1 AS pos FROM (
  SELECT doc_id, ord, list_filter(list_transform(regexp_extract_all(body, '[^.!?]+[.!?]*'),
    lambda x: trim(x, E' \t\n\x0b\f\r')), lambda x: length(x) > 20)[1:12] AS s FROM paragraphs)""",
    "paragraphs": r"""
SELECT doc_id, ord, body FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents) WHERE trim(body, E' \t\n\x0b\f\r') <> ''""",
}
DERIVED = {k: DERIVED[k] for k in ("kg_edges", "qualities", "paragraphs")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph that the star schema implies: places, members, kinds of parts."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = F.broadcast(nation.select("n_nationkey", "n_name"))  # 25 rows by the schema
    parts = [
        (nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")), "n_nationkey", "n_name", "is_part_of", "r_name", "nation"),
        (table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")), "s_suppkey", "s_name", "is_located_in", "n_name", "supplier"),
        (table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")), "c_custkey", "c_name", "is_located_in", "n_name", "customer"),
        (table(spark, sf_dir, "part"), "p_partkey", "p_name", "is_kind_of", "p_type", "part"),
    ]
    out = None
    for i, (rows, key, src, label, dst, source) in enumerate(parts, 1):
        edges = rows.select(
            (F.col(key).cast("long") + i * 10**12).alias("edge_ord"),
            F.col(src).alias("src"),
            F.col(dst).alias("dst"),
            F.lit(label).alias("label"),
            F.lit(source).alias("source"),
            F.concat_ws(" ", F.col(src), F.lit(label), F.col(dst)).alias("sentence"),
        )
        out = edges if out is None else out.union(edges)
    return out


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, body: the lines of a document that are not blank."""
    from ..sources.readers import paragraphs_of

    return paragraphs_of(table(spark, sf_dir, "documents"))


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, pos, quality: at most 12 sentences of each paragraph."""
    found = F.slice(text.sentences(F.col("body")), 1, 12)
    return paragraphs(spark, sf_dir).select("doc_id", "ord", F.posexplode(found).alias("pos", "quality"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, items) of the embeddings: the stated query set, ids divisible by 100, and every vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return rows.where("id % 100 = 0"), rows
