"""Bulk upload: documents to sentences to triples to edges in one pass that carries what failed beside what didn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import merge, triples


def staged(docs: DataFrame, predicates: list[str], sentences: Column | None = None) -> DataFrame:
    """doc_id, source, edge_ord, sentence, src, label, dst, stage, error: a row an edge, or what stopped a text.

    docs: doc_id, source, text. ``sentences`` is the column of a text's sentences. stage is null for an edge
    that can be stored; else ``decompose`` (no sentence in a document), ``extract`` (no triple in a
    sentence) or ``store`` (an edge with an empty part), with the reason in error. Nothing aborts the
    rest: a document's good sentences count beside its bad ones. edge_ord is a hash of the
    document, the sentence's place and the triple's parts.
    """
    found = text.sentences(F.col("text")) if sentences is None else sentences
    rows = docs.select("doc_id", "source", F.posexplode_outer(found).alias("pos", "sentence"))
    edges = triples.by_patterns(rows, predicates)
    edges = edges.withColumnsRenamed({"subject": "src", "predicate": "label", "object": "dst"})
    checked = merge.validated(edges.withColumn("edge_ord", F.xxhash64("doc_id", "pos", "src", "label", "dst")))
    stage = F.when(F.col("sentence").isNull(), "decompose").when(F.col("src").isNull(), "extract").when(F.col("error").isNotNull(), "store")
    why = F.when(stage == "decompose", "the text has no sentence").when(stage == "extract", "no predicate is in the sentence").otherwise(F.col("error"))
    return checked.select("doc_id", "source", "edge_ord", "sentence", "src", "label", "dst", stage.alias("stage"), why.alias("error"))


def upload(current: DataFrame, docs: DataFrame, predicates: list[str], now: Column, sentences: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshot, rejects): the good edges of staged() merged into ``current``; doc_id, stage, sentence, error of the rest."""
    rows = staged(docs, predicates, sentences)
    good = rows.where("stage is null")
    missing = [c for c in current.columns if c not in good.columns]
    new = good.withColumns({c: F.lit(None).cast(current.schema[c].dataType) for c in missing}).select(*current.columns)
    return merge.merge_edges(current, new, now), rows.where("stage is not null").select("doc_id", "stage", "sentence", "error")
