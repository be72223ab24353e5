"""Exact top-k inner-product search: tiled matrix products, then a tree of merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a score block that is in memory at once.
STRIP = 4096
#: The key of a query's own vector, below all others.
OWN = -(2**62)


def _tile(k: int):
    def search(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(items):
            shard = int(items["shard"].iloc[0])
            items = items.sort_values("id", kind="stable")
            q, x = np.stack(queries["vec"].to_numpy()), np.stack(items["vec"].to_numpy())
            q_ids, ids = queries["id"].to_numpy(), items["id"].to_numpy()
            for at in range(0, len(ids), STRIP):
                part = ids[at : at + STRIP]
                scores = (q @ x[at : at + STRIP].T).astype(np.int64)
                # one number orders by score, then by the smaller id; all are different
                keys = scores * STRIP + (STRIP - 1 - np.arange(len(part)))
                keys[q_ids[:, None] == part[None, :]] = OWN
                top = min(k, len(part))
                best = np.argpartition(-keys, top - 1, axis=1)[:, :top]
                row = np.repeat(np.arange(len(q_ids)), top)
                col = best.ravel()
                live = keys[row, col] != OWN
                row, col = row[live], col[live]
                found.append(
                    pd.DataFrame({"query_id": q_ids[row], "vec_id": part[col], "score": scores[row, col], "shard": shard})
                )
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "shard": []}, dtype="int64")
        return pd.concat(found, ignore_index=True)

    return search


def exact_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_tile: int = 2048,
    shard_rows: int = 16384,
    fan_in: int = 32,
) -> DataFrame:
    """The k items with the highest integer inner product for each query: query_id, rank, vec_id, score.

    Queries are cut into blocks and items into shards; each pair of a block and a shard is one
    bounded matrix product in one task, of which the k best per query leave. Lists are merged
    ``fan_in`` shards at a time, then per query. Ties go to the smaller id.

    Components must be whole numbers whose products sum to less than 2**50. A vector that is null
    or holds a null or non-finite component takes no part, nor does a row without id; vectors are
    compared with those of their own length. A query's own id is no candidate; rows that repeat
    an id and its vector count once. Fewer than k candidates: all are returned. Empty input:
    empty result. Other columns are not read.
    """
    vec = F.col("vec")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    def clean(df: DataFrame, block: str, rows: int) -> tuple[DataFrame, int]:
        out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        out = out.where(F.col("id").isNotNull() & vec.isNotNull()).where(~F.exists("vec", bad)).distinct()
        parts = max(1, -(-out.count() // rows))
        return out.withColumns({"dim": F.size("vec"), block: F.pmod(F.xxhash64("id"), F.lit(parts))}), parts

    asked, blocks = clean(queries, "block", query_tile)
    given, shards = clean(items, "shard", shard_rows)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = asked.withColumn("shard", spread(shards))
    given = given.withColumn("block", spread(blocks))
    key = ["dim", "block", "shard"]
    found = (
        asked.groupBy(*key)
        .cogroup(given.groupBy(*key))
        .applyInPandas(_tile(k), "query_id long, vec_id long, score long, shard long")
    )
    order = [F.desc("score"), F.asc("vec_id")]
    group = Window.partitionBy("query_id", (F.col("shard") / fan_in).cast("long")).orderBy(*order)
    whole = Window.partitionBy("query_id").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
