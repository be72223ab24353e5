"""Tables of the review: verdicts, rows, payloads, exports, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..steps import checkpointed


def first_of(rows: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def key_of(c: str) -> Column:
    return F.lower(strip(F.coalesce(F.col(c), F.lit(""))))


def verdict_tables(rows: DataFrame) -> DataFrame:
    """Of equal qualities in a decision the first by ord; best score first within a decision."""
    return first_of(rows, ["decision", key_of("quality")], ["ord"]).orderBy("decision", F.desc("max_score"), "ord")


def best_per_sentence(rows: DataFrame, text_col: str = "quality") -> DataFrame:
    """Of equal sentences the one with the highest score, the first of ties."""
    return first_of(rows, [key_of(text_col)], [F.desc("max_score"), "ord"])


def page(rows: DataFrame, number: int, order: list, size: int = 10) -> DataFrame:
    """A page of rows; numbers outside mean the first or last."""
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(number, 1), pages) - 1) * size).limit(size)


def _blank(c: str) -> Column:
    return strip(F.coalesce(F.col(c), F.lit(""))) == ""


def complete() -> Column:
    return ~(_blank("subject") | _blank("predicate") | _blank("object"))


def review_rows(extractions: DataFrame) -> DataFrame:
    """ord, pos, sentence, subject, predicate, object, deleted: a row per triple without empty parts."""
    rows = extractions.select("ord", "sentence", F.posexplode("triplets").alias("pos", "t")).select(
        "ord", "pos", "sentence", "t.subject", "t.predicate", "t.object", F.lit(False).alias("deleted")
    )
    return rows.where(complete())


def counters(rows: DataFrame) -> DataFrame:
    """valid, deleted."""
    gone = F.coalesce("deleted", F.lit(False))
    return rows.agg(F.count_if(~gone & complete()).alias("valid"), F.count_if(gone).alias("deleted"))


def upsert_payload(rows: DataFrame) -> DataFrame:
    """first, sentence, triplets: complete rows that stay, by sentence in the order first seen, each triple once."""
    alive = rows.where(~F.coalesce("deleted", F.lit(False)) & complete())
    parts = [strip(F.col(c)).alias(c) for c in ("subject", "predicate", "object")]
    once = first_of(alive.select("ord", "sentence", *parts), ["sentence", "subject", "predicate", "object"], ["ord"])
    ordered = F.sort_array(F.collect_list(F.struct("ord", "subject", "object", "predicate")))
    triples = F.transform(ordered, lambda t: F.struct(t["subject"].alias("subject"), t["object"].alias("object"), t["predicate"].alias("predicate")))
    return once.groupBy("sentence").agg(F.min("ord").alias("first"), triples.alias("triplets"))


def checked_payload(rows: DataFrame) -> DataFrame:
    """sentence, triplets with three non-blank parts only; rows left without any go, and none at all is an error."""
    good = F.filter("triplets", lambda t: (strip(t["subject"]) != "") & (strip(t["predicate"]) != "") & (strip(t["object"]) != ""))
    out = rows.where(~_blank("sentence")).withColumn("triplets", F.coalesce(good, F.array().cast(rows.schema["triplets"].dataType)))
    out = out.where(F.size("triplets") > 0)
    if out.isEmpty():
        raise ValueError("no valid triple")
    return out


def checked_qualities(rows: DataFrame) -> DataFrame:
    out = rows.select(strip(F.col("quality").cast("string")).alias("quality")).where("quality <> ''")
    if out.isEmpty():
        raise ValueError("no quality is selected")
    return out


def sentence_records(edges: DataFrame) -> DataFrame:
    """edge_ord, sentence, source, relation: each edge's sentence, else its original one; blank ones go."""
    said = strip(F.coalesce(F.nullif(F.col("sentence"), F.lit("")), F.col("original_sentence")))
    return edges.select("edge_ord", said.alias("sentence"), "source", F.col("label").alias("relation")).where("sentence <> ''")


def numbered(records: DataFrame) -> DataFrame:
    """line: "1. ...", the distinct sentences in order of first sight.

    Sentences are dealt to ranges of that order; each range counts its own, after how many there are before it.
    """
    first = records.groupBy("sentence").agg(F.min("edge_ord").alias("first"))
    first = checkpointed(first.repartitionByRange("first", "sentence").withColumn("range", F.spark_partition_id()))
    sizes = first.groupBy("range").agg(F.count("*").alias("n"))  # a row per range
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("first", "sentence"))
    first, nth = first.join(before, "range"), (own + F.col("before")).cast("string")
    return first.select(F.concat(nth, F.lit(". "), F.col("sentence")).alias("line"))


def triple_export(payload: DataFrame, keyword: str | None) -> DataFrame:
    """keyword, first, sentence, pos, subject, predicate, object: the triples that the payload would upsert, a row each.

    No keyword stays null. A payload without triples gives no rows; its sentences are numbered(payload_sentences(payload)).
    """
    rows = payload.select(F.lit(keyword).cast("string").alias("keyword"), "first", "sentence", F.posexplode("triplets").alias("pos", "t"))
    return rows.select("keyword", "first", "sentence", "pos", *[F.col("t")[c].alias(c) for c in ("subject", "predicate", "object")])


def payload_sentences(payload: DataFrame) -> DataFrame:
    """edge_ord, sentence: the sentences of a payload that are not empty, in the order first seen."""
    return payload.where("sentence <> ''").select(F.col("first").alias("edge_ord"), "sentence")


def grouped_export(rows: DataFrame) -> DataFrame:
    """place, Group, Sentence, Similarity: NEW, PARTIALLY NEW, EXISTING, each sentence once at its best score."""
    place = F.when(F.col("decision") == "NEW", 1).when(F.col("decision") == "PARTIALLY_NEW", 2).otherwise(3)
    best = first_of(rows, ["decision", key_of("quality")], [F.desc("max_score"), "ord"])
    return best.select(
        place.alias("place"),
        F.replace("decision", F.lit("_"), F.lit(" ")).alias("Group"),
        strip(F.col("quality")).alias("Sentence"),
        F.round("max_score", 2).alias("Similarity"),
    )


def decided(relations: DataFrame, decisions: DataFrame) -> DataFrame:
    """``relations`` (edge_key, ...) with status accept, reject or undecided.

    Decisions go by ``ord``: the first of an edge holds, and from a quit on none does. Without ``ord`` no quit comes before any.
    """
    order = F.col("ord") if "ord" in decisions.columns else F.lit(0)
    known = decisions.select("edge_key", F.lower("decision").alias("status"), order.alias("at"))
    stop = known.where("status = 'quit'").agg(F.min("at").alias("stop")).first()["stop"] if "ord" in decisions.columns else None
    known = known.where(F.col("status").isin("accept", "reject") & (F.lit(True) if stop is None else F.col("at") < F.lit(stop)))
    known = known.groupBy("edge_key").agg(F.min(F.struct("at", "status"))["status"].alias("status"))
    return relations.join(known, "edge_key", "left").withColumn("status", F.coalesce("status", F.lit("undecided")))


def decision_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def feedback_inserted(current: DataFrame, new: DataFrame) -> DataFrame:
    """``current`` and the rows of ``new`` whose text and user it lacks, with an id made of both."""
    key = ["exact_text", "username"]
    fresh = new.join(current.select(*key).distinct(), key, "left_anti").dropDuplicates(key)
    fresh = fresh.withColumn("id", F.sha2(F.concat_ws("\n", *key), 256))
    return current.unionByName(fresh, allowMissingColumns=True)


def feedback_updated(current: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """``current`` with the given columns from ``changes`` by id and user, where those are not null."""
    new = changes.select("id", "username", *[F.col(c).alias(f"__{c}") for c in columns]).dropDuplicates(["id", "username"])
    rows = current.join(new, ["id", "username"], "left")
    return rows.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*current.columns)
