"""Removal of lines that many sites share, by HyperLogLog spread per line hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, part_of, rows_of, text_of

BLANK_CHARS = " \t\n\x0b\f\r"


def _key(line: Column) -> Column:
    """128 bits: at 64, one of some 10**10 different lines would soon be taken for another."""
    return F.unhex(F.md5(F.btrim(line, F.lit(BLANK_CHARS)).cast("binary")))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int, margin: float) -> DataFrame:
    """(line, first_id): the line hashes on ``min_sites`` or more distinct sites.

    ``lines``: line, site, doc_id. One sketch per line hash, merged by aggregation. Only estimates
    within ``margin`` times the threshold are settled by an exact distinct count.
    """
    spread = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min("doc_id").alias("first_id")
    )
    spread = spread.where(F.col("sites") * margin >= min_sites)
    sure = spread.where(F.col("sites") >= min_sites * margin)
    close = spread.where(F.col("sites") < min_sites * margin).select("line")
    exact = (
        lines.groupBy("line", "site")  # first, so that a hot line is a row per site in the join
        .agg(F.min("doc_id").alias("first_id"))
        .join(close, "line", "left_semi")
        .groupBy("line")
        .agg(F.count("*").alias("n"), F.min("first_id").alias("first_id"))
        .where(F.col("n") >= min_sites)
    )
    return sure.select("line", "first_id").union(exact.select("line", "first_id"))


def line_dedup(
    docs: DataFrame,
    min_sites: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    lg_k: int = 12,
    margin: float = 1.5,
) -> DataFrame:
    """row (the columns of ``docs``), text without boilerplate lines, lines and removed (counts) of each row.

    A line counts as boilerplate if it occurs on ``min_sites`` or more distinct sites; blanks at its
    ends don't matter, and lines of blanks alone never count. It stays in the document with the
    smallest id that has it, at each place there, and leaves all others with its newline.

    A null text stays null and counts as empty. All null sites count as one site of its own. A null id is never
    the smallest unless all are null; then the line stays in each. Rows that share an id are parts of one
    document. Columns of any name stay in ``row``. Very long texts are looked through whole. Empty table: empty result.
    """
    split = F.split(text_of(text_col), "\n", -1)
    named = F.col(f"`{id_col}`").alias("doc_id"), part_of(id_col, text_col).alias("part")
    own = docs.select(
        *named,
        F.coalesce(F.concat(F.lit("="), F.col(f"`{site_col}`").cast("string")), F.lit("")).alias("site"),
        F.array_distinct(F.transform(F.filter(split, lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != ""), _key)).alias("found"),
    )
    lines = materialize(own.select("doc_id", "part", "site", F.explode("found").alias("line")))
    common = materialize(boilerplate(lines, min_sites, lg_k, margin).where("first_id is not null"))
    gone = (
        lines.join(common, "line")
        .where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("first_id")))
        .groupBy(F.col("doc_id").alias("of"), F.col("part").alias("of_part"))
        .agg(F.collect_set("line").alias("gone"))
    )
    base = docs.select(*named, rows_of(docs).alias("row"))
    marked = base.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")), "left")
    text = F.col("row").getField(text_col).alias("text")
    split = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    keep = F.filter(split, lambda x: ~F.array_contains("gone", _key(x)) | (F.btrim(x, F.lit(BLANK_CHARS)) == ""))
    marked = marked.select("row", text, F.size(split).cast("long").alias("lines"), F.when(F.col("gone").isNotNull(), keep).alias("kept"))
    return marked.select(
        "row",
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        "lines",
        F.coalesce(F.col("lines") - F.size("kept"), F.lit(0)).cast("long").alias("removed"),
    )
