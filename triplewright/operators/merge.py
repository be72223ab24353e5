"""The merge of edges into the graph: snapshots, batches with rejects, nodes, logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .review import first_of

KEY = ("src", "dst", "label", "__source")
POINTER = "number long, version string"


def merge_edges(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """A new snapshot of edges after ``incoming`` is merged.

    Edges are the same by src, dst, label and source (null: ''). Of equal incoming edges the first
    by edge_ord counts. A new edge stores all its properties; a known one changes only
    last_updated_at. Both tables have the columns of ``current``.
    """
    keyed = lambda df: df.withColumn("__source", F.coalesce("source", F.lit("")))
    rest = [c for c in current.columns if c not in KEY]
    new = first_of(keyed(incoming), list(KEY), ["edge_ord"]).select(*KEY, F.struct(*rest).alias("new"))
    old = keyed(current).select(*KEY, F.struct(*rest).alias("old"))
    both = old.join(new, list(KEY), "full_outer")

    def pick(c: str) -> Column:
        if c == "created_at":
            return F.when(F.col("old").isNotNull(), F.col("old.created_at")).otherwise(now)
        if c == "last_updated_at":
            return F.when(F.col("new").isNotNull(), now).otherwise(F.col("old.last_updated_at"))
        return F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))

    return both.select(*[c for c in current.columns if c in KEY], *[pick(c).alias(c) for c in rest]).select(*current.columns)


def merge_nodes(current: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """label, created_at, last_updated_at: nodes merged by exact label."""
    seen = edges.select(F.explode(F.array("src", "dst")).alias("label")).distinct().withColumn("seen", F.lit(True))
    both = current.join(seen, "label", "full_outer")
    return both.select(
        "label",
        F.coalesce("created_at", now).alias("created_at"),
        F.when(F.col("seen"), now).otherwise(F.col("last_updated_at")).alias("last_updated_at"),
    )


def validated(edges: DataFrame) -> DataFrame:
    """``edges`` with error: null, or why the edge can't be stored."""
    error = None
    for c in ("src", "label", "dst"):
        bad = strip(F.coalesce(c, F.lit(""))) == ""
        error = F.when(bad, F.lit(f"{c} is empty")) if error is None else error.when(bad, F.lit(f"{c} is empty"))
    said = F.concat_ws(" ", F.coalesce("src", F.lit("")), F.lit("-"), F.coalesce("label", F.lit("")), F.lit("->"), F.coalesce("dst", F.lit("")))
    return edges.withColumn("error", F.when(error.isNotNull(), F.concat(said, F.lit(": "), error)))


def batch_summary(checked: DataFrame) -> DataFrame:
    """attempted, succeeded, failed of validated() edges; an empty batch gives zeros."""
    return checked.agg(
        F.count("*").alias("attempted"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count("error").alias("failed")
    )


def upsert_batch(current: DataFrame, edges: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshot, summary, rejects): valid edges are merged, others are told with their error."""
    checked = validated(edges)
    good = checked.where("error is null").drop("error")
    return merge_edges(current, good, now), batch_summary(checked), checked.where("error is not null")


def write_snapshot(edges: DataFrame, base: str, version: str) -> None:
    """Write a version of the edge table, then point to it; readers see the old one until then.

    Pointers are only ever added, so there is always one that holds. A version that no pointer names is what a
    failure left; it is written anew. One that a pointer has ever had can't be written again.
    """
    spark, last = edges.sparkSession, pointer(edges.sparkSession, base)
    if last and not spark.read.schema(POINTER).parquet(f"{base}/current").where(F.col("version") == version).isEmpty():
        raise ValueError(f"version {version} is in use")
    edges.write.mode("overwrite").parquet(f"{base}/version={version}")
    row = [((last["number"] if last else 0) + 1, version)]
    spark.createDataFrame(row, POINTER).coalesce(1).write.mode("append").parquet(f"{base}/current")


def pointer(spark: SparkSession, base: str) -> Row | None:
    """The last pointer: number, version; None before the first version is complete."""
    try:
        return spark.read.schema(POINTER).parquet(f"{base}/current").orderBy(F.desc("number")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_snapshot(spark: SparkSession, base: str) -> DataFrame:
    last = pointer(spark, base)
    if last is None:
        raise ValueError(f"no version is complete under {base}")
    return spark.read.parquet(f"{base}/version={last['version']}")


def write_log(rows: DataFrame, base: str, stage: str, run_id: str) -> None:
    """Rows of a stage as JSON, in a folder of the stage and run."""
    stamped = rows.withColumns({"stage": F.lit(stage), "run_id": F.lit(run_id)})
    stamped.write.mode("append").partitionBy("stage", "run_id").json(base)
