"""Timings and counts of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def timing_summary(timings: DataFrame) -> DataFrame:
    """name, elapsed_seconds: the last record of each stage."""
    return timings.groupBy("name").agg(F.max_by("elapsed_seconds", F.struct("finished_at", "elapsed_seconds")).alias("elapsed_seconds"))


def total_seconds(timings: DataFrame) -> DataFrame:
    return timing_summary(timings).agg(F.sum("elapsed_seconds").alias("total_seconds"))


def stage_counts(rows: DataFrame, flag: str, yes: str, no: str) -> DataFrame:
    """How many rows a stage kept and dropped."""
    return rows.agg(F.count_if(F.col(flag)).alias(yes), F.count_if(~F.col(flag)).alias(no))


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``rows`` and the count that is known once they have been used, without a pass of its own."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen
