"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes 0x20 and 0x09-0x0D, as a Java regular expression.
BLANKS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The column's text; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def rows_of(docs: DataFrame) -> Column:
    """The whole row as one struct, so that no name of ours can clash with one of its columns."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def part_of(id_col: str, text_col: str) -> Column:
    """Tells rows without id apart by their text, so that they don't all meet in one place; '' for others."""
    return F.when(F.col(f"`{id_col}`").isNull(), F.md5(text_of(text_col).cast("binary"))).otherwise(F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; only a local session (tests) may do without one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and cut the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write rows as compressed Parquet in the shared folder and read them again; plans then know their size."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
