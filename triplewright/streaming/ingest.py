"""Incremental ingestion: a stream of text files becomes edges of the graph."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store, triples
from ..sources.readers import text_sentences


def edges_of(texts: DataFrame, predicates: list[str]) -> DataFrame:
    """src, dst, label, source, sentence of the triples that patterns find in texts (source, text)."""
    found = triples.by_patterns(text_sentences(texts).select("source", "page_number", "sentence"), predicates)
    return found.where("subject is not null").select(
        F.xxhash64("source", "page_number").alias("edge_ord"),
        F.col("subject").alias("src"),
        F.col("object").alias("dst"),
        F.col("predicate").alias("label"),
        "source",
        "sentence",
    )


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave a stream when its checkpoint was made."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def ingest(spark: SparkSession, folder: str, base: str, checkpoint: str, predicates: list[str]) -> StreamingQuery:
    """Merge new files of a folder into the edge table under ``base``; stops when none is left.

    A batch is a version named by the stream's id and its number, so other streams and writers of the same
    table have other names. A batch that a manifest knows was done before a failure; any other is written anew.
    """
    stream = spark.readStream.option("wholetext", True).text(folder).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        version = f"{stream_id(session, checkpoint)}-{number}"
        if not store.known(session, base, version):
            store.upsert(edges_of(batch, predicates), base, version, F.current_timestamp())

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
