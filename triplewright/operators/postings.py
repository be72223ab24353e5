"""A written inverted index for BM25: postings in blocks that know their highest impact, so that top-k skips most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..steps import written
from .retrieval import SENT, split_words, words

#: Documents of a block, about.
BLOCK = 4096


def _impact(k1: float, b: float):
    """What a word's count adds to a score, without the word's weight."""
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("average")))


def build(docs: DataFrame, path: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, block: int = BLOCK, folders: int = 8) -> None:
    """Writes the index of docs (doc_id, text) under ``path``: numbers, words, postings.

    A document belongs to a block by a hash of its id; a word's postings in a block are one row with
    their highest impact, so a word that every document has is as many rows as there are blocks.
    Postings lie in folders by a hash of the word, sorted by it. Weights of words are as in bm25().
    """
    spark = docs.sparkSession
    tokens = split_words(F.col("text"))
    whole = docs.agg(F.count("*").alias("n"), F.sum(F.when(F.col("text").isNotNull(), F.size(tokens))).alias("total")).first()
    n, total = whole["n"], whole["total"] or 0
    average = total / n if n else 1.0
    # each document counts a word once, so that counting starts where the documents are
    spread = docs.select(F.explode(F.array_distinct(tokens)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    spread = written(spread.withColumn("idf", idf))
    mean = spread.agg(F.avg("idf")).first()[0] or 0.0
    folder = F.pmod(F.xxhash64("word"), F.lit(folders)).cast("int").alias("folder")
    weight = F.when(F.col("idf") < 0, epsilon * mean).otherwise(F.col("idf")).alias("idf")
    spread.select("word", "df", weight, folder).hint("rebalance", "folder").sortWithinPartitions("folder", "word").write.partitionBy("folder").parquet(f"{path}/words")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // block)))).cast("int")
    # texts go to the task of their block, and postings, which are many times as large, are made and stay there
    dealt = docs.select("doc_id", "text", part.alias("block")).repartition("block")
    # split first: beside an explode the size would be taken again for each word
    held = dealt.select("block", "doc_id", F.size(tokens).alias("size"), tokens.alias("words"))
    counted = held.select("block", "doc_id", "size", F.explode("words").alias("word")).groupBy("block", "doc_id", "size", "word").agg(F.count("*").alias("tf"))
    rows = counted.withColumn("average", F.lit(float(average))).withColumn("impact", _impact(k1, b))
    posting = F.struct("doc_id", "impact")
    blocks = rows.groupBy("block", "word").agg(F.max("impact").alias("highest"), F.collect_list(posting).alias("postings"))
    blocks = blocks.select("word", "block", "highest", "postings", folder)
    blocks.sortWithinPartitions("folder", "word").write.partitionBy("folder").parquet(f"{path}/postings")
    spark.createDataFrame([(n, total, float(average), k1, b, folders)], "n long, words long, average double, k1 double, b double, folders int").coalesce(1).write.parquet(f"{path}/numbers")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 4, first: int = 1) -> DataFrame:
    """query_id, rank, doc_id, score: what bm25() gives, from an index; documents aren't read.

    Every block that has a word of a query gets a bound, the sum of its words' highest impacts. The
    ``first`` best blocks are scored, and of the others only those whose bound reaches the k-th best score of
    these: no other can hold a better document.
    """
    asked = words(queries, "query_id", "text", lower=True).groupBy(F.col("id").alias("query_id"), "word").agg(F.count("*").alias("times"))
    numbers = spark.read.parquet(f"{path}/numbers").first()
    if not numbers["words"]:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    folder = F.pmod(F.xxhash64("word"), F.lit(numbers["folders"])).cast("int")
    asked = asked.withColumn("folder", folder)
    weights = spark.read.parquet(f"{path}/words")
    wanted = written(asked.join(weights, ["folder", "word"]).select("query_id", "folder", "word", (F.col("times") * F.col("idf")).alias("weight")))

    def sent(some: DataFrame) -> DataFrame:
        return F.broadcast(some) if some.count() <= SENT else some

    wanted = sent(wanted)
    table = spark.read.parquet(f"{path}/postings").join(sent(wanted.select("folder", "word").distinct()), ["folder", "word"], "left_semi")
    bound = F.greatest(F.lit(0.0), F.col("weight") * F.col("highest"))
    blocks = table.select("folder", "word", "block", "highest").join(wanted, ["folder", "word"])
    blocks = blocks.groupBy("query_id", "block").agg(F.sum(bound).alias("bound"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    blocks = written(blocks.withColumn("turn", turn))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))

    def scored(some: DataFrame) -> DataFrame:
        some = sent(some.select("query_id", "block"))
        # a block's postings meet in one task, so that its sums, one for each query and document, end there as the k best
        rows = table.join(sent(some.select("block").distinct()), "block", "left_semi").select("folder", "word", "block", "postings").repartition("block")
        rows = rows.join(wanted, ["folder", "word"]).join(some, ["query_id", "block"])
        hits = rows.select("block", "query_id", "weight", F.explode("postings").alias("p"))
        found = hits.groupBy("block", "query_id", F.col("p.doc_id").alias("doc_id")).agg(F.round(F.sum(F.col("weight") * F.col("p.impact")), 6).alias("score"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    best = written(scored(blocks.where(F.col("turn") <= first)).select("query_id", "doc_id", "score"))
    least = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    rest = blocks.where(F.col("turn") > first).join(least, "query_id", "left")
    # scores are rounded, so a bound may be that much lower
    rest = rest.where(F.col("n").isNull() | (F.col("n") < k) | (F.col("bound") >= F.col("least") - 1e-6))
    every = best.union(scored(rest).select("query_id", "doc_id", "score"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
