"""The document pipeline: each stage takes and gives documents; the last packs them.

Each function takes (spark, docs, sf_dir). All but the last return the columns of ``docs``;
``n_chars``, where it is there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm import line_dedup, packing, quality, secret_scan, simhash
from triplewright.llm.common import documents, rows_of, stored
from triplewright.llm.queries import VOCABULARY

#: SQL can express neither the fitted classifier nor the fingerprints.
ORACLE_SQL = None


def _rows(changed: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The rows of ``docs`` with another text, and ``n_chars``, where it is there, of that."""
    put = lambda c: F.col("row").getField(c).alias(c)
    size = lambda c: F.length(F.coalesce(text, F.lit(""))).cast(docs.schema[c].dataType).alias(c)
    special = {"text": lambda c: text.alias(c), "n_chars": size}
    return changed.select(*[special.get(c, put)(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, unchanged."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).where("keep").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many sites share."""
    return _rows(line_dedup.line_dedup(docs), docs, F.col("text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words are alike to 0.8; of rows that share id and text, one."""
    keep = simhash.similar_documents(docs).where("keep").select(F.col("doc_id").alias("of"), F.col("body").alias("of_body")).distinct()
    keyed = docs.select(rows_of(docs).alias("row"), F.col("doc_id").alias("id"), simhash.body_of("text"))
    kept = keyed.join(keep, F.col("id").eqNullSafe(F.col("of")) & (F.col("body") == F.col("of_body")), "left_semi")
    return kept.dropDuplicates(["id", "body"]).select("row.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with *** in place of its secrets."""
    old = F.col("row").getField("text")
    return _rows(secret_scan.secret_scan(docs), docs, F.when(F.size("spans") > 0, secret_scan.masked()).otherwise(old))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences that hold all documents."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage gives is written and read again by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
