"""Records of the graph: totals of a seed, triples as relations, checks of arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def seed_totals(edges: DataFrame) -> DataFrame:
    """nodes, relationships: what is in the graph after edges are merged by source, label and target."""
    facts = edges.select("src", "label", "dst").distinct()
    ends = facts.select(F.explode(F.array("src", "dst")).alias("node"))
    one = ends.agg(F.countDistinct("node").alias("nodes"), F.lit(1).alias("k"))
    return one.join(facts.agg(F.count("*").alias("relationships"), F.lit(1).alias("k")), "k").drop("k")


def relations(extractions: DataFrame) -> DataFrame:
    """A row per triple with its three parts normalised; ``sentence``, and ``source`` if there, stay."""
    rest = [c for c in extractions.columns if c != "triplets"]
    rows = extractions.select(*rest, F.explode("triplets").alias("t"))
    return rows.select(
        *rest,
        text.normalize(F.col("t.subject")).alias("src"),
        text.normalize(F.col("t.predicate")).alias("label"),
        text.normalize(F.col("t.object")).alias("dst"),
    )


def document_relations(extractions: DataFrame, docs: DataFrame) -> DataFrame:
    """relations() with ``extra``: the sentence, overridden by the metadata of the triple's document on a clash.

    extractions: doc_id, sentence, triplets; docs: doc_id, meta map<string,string>.
    """
    own = relations(extractions).join(docs.select("doc_id", "meta"), "doc_id", "left")
    said = F.create_map(F.lit("sentence"), F.col("sentence"), F.lit("original_sentence"), F.col("sentence"))
    meta = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(said, lambda k, _: ~F.map_contains_key(meta, k))
    return own.withColumn("extra", F.map_concat(kept, meta)).drop("meta", "sentence")


def allowed(asked: DataFrame, names: DataFrame) -> DataFrame:
    """keyword, allowed: whether a keyword is in the list, with its case."""
    listed = names.select("keyword", F.lit(True).alias("allowed")).distinct()
    return asked.join(listed, "keyword", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
