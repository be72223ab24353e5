"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, stored, text_of


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    digest_all: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of blanks (0x20, 0x09-0x0D) is replaced by one
    space. Lengths that occur once leave first; of the others the first ``prefix_chars`` characters are
    hashed, and rows whose length and prefix occur once leave; only what survives both is grouped by a hash of
    the whole text. What goes from row to row is a length, a prefix or a digest: with ``digest_all`` no whole text is moved.

    The row with the smallest id stays. A null text counts as empty. A null id never beats
    another; if all ids of a group are null, keep_id is null and one row stays. Of rows that
    share both id and text, one stays. Very long texts are hashed whole. An empty table gives an empty result.
    Other columns of ``docs``, whatever their names, are not read. ``text_sha256`` is null for rows outside the
    surviving groups, unless ``digest_all`` asks for the digest of every row.
    """
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.regexp_replace(text_of(text_col), BLANKS, " ").alias("body"),
    ).withColumn("n", F.length("body"))
    lengths = stored(base.groupBy("n").count().where("count > 1").select("n"))
    heads = base.select("n", F.substring("body", 1, prefix_chars).alias("head")).join(lengths, "n", "left_semi")
    heads = heads.groupBy("n", F.xxhash64("head").alias("prefix")).count().where("count > 1")
    suspects = stored(heads.select("n", "prefix", F.lit(True).alias("suspect")))
    rows = base.withColumn("prefix", F.xxhash64(F.substring("body", 1, prefix_chars)))
    whole = F.sha2("body", 256)
    if digest_all:
        rows = rows.select("doc_id", "n", "prefix", whole.alias("text_sha256")).join(suspects, ["n", "prefix"], "left")
    else:
        rows = rows.join(suspects, ["n", "prefix"], "left").withColumn("text_sha256", F.when(F.col("suspect"), whole))
    suspect = F.coalesce("suspect", F.lit(False)).alias("suspect")
    hashed = stored(rows.select("doc_id", "n", suspect, "text_sha256", F.monotonically_increasing_id().alias("row")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("first")
    groups = hashed.where("suspect").groupBy("n", "text_sha256").agg(first, F.count("*").alias("size")).where("size > 1")
    # a written side lets Spark split a hot group on the other
    found = hashed.join(stored(groups), ["n", "text_sha256"], "left")
    return found.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
