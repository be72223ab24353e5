from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplewright.llm import exact_dedup, queries, topk

DOCS = "doc_id long, text string"


def test_exact_dedup_equals_brute_force(spark):
    texts = ["a b", "a\t\n b", "a  b ", "", None, " ", "x" * 500 + "1", "x" * 500 + "2", "x" * 500 + "1", "é", "a b", "a b c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, "a  b "), (None, "a b"), (None, "only null"), (None, "only null"), (50, "y " * 40_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit(1), "prefix": F.lit("x"), "body": F.lit(2)})
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    got = exact_dedup.exact_dedup(docs, digest_all=True).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_hash[r["text_sha256"]]
        named = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (min(named) if named else None)
    kept = [(r["text_sha256"]) for r in got if r["kept"]]
    assert sorted(kept) == sorted(by_hash)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    lazy = exact_dedup.exact_dedup(docs).where("group_size = 1")
    assert lazy.where("text_sha256 is null").count() > 0


@pytest.mark.parametrize("k", [1, 5, 200])
def test_top_k_equals_brute_force(spark, k):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (120, 6)).astype(float)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (None, [9.0] * 6), rows[3], (204, [1.0])]
    items = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "shard": F.lit(2)})
    got = topk.exact_topk(items.where("vec_id % 10 = 0"), items, k, query_tile=5, shard_rows=30, fan_in=2).toPandas()
    for q in range(0, 120, 10):
        want = sorted((-int(x[q] @ x[j]), j) for j in range(120) if j != q)[:k]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(zip(-mine.score, mine.vec_id, strict=True)) == want and list(mine["rank"]) == list(range(1, len(want) + 1))
    assert topk.exact_topk(items.limit(0), items, k).count() == 0 and topk.exact_topk(items, items.limit(0), k).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    items = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    got = topk.exact_topk(items.where("vec_id = 2"), items, 3, shard_rows=7).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 3]


def test_registered_queries_run(spark, data):
    for name in ("op4_exact_dedup", "op8_topk"):
        assert queries.queries()[name](spark, data).count() > 0


def test_registered_top_k_leaves_out_vectors_with_non_finite_parts(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(60, 4)).astype(np.float32)
    good = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    inf = float("inf")
    bad = [(100, [inf, 1.0, 1.0, 1.0]), (101, [-inf, 1.0, 1.0, 1.0]), (102, [float("nan"), 9.0, 9.0, 9.0]), (103, [None, 9.0, 9.0, 9.0]), (104, None)]
    folder = str(tmp_path)
    spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    got = queries.op8_topk(spark, folder).toPandas()
    whole = np.floor(x.astype(float) * 256).astype(int)
    assert set(got.query_id) == {0, 50}
    for q in (0, 50):
        want = sorted((-int(whole[q] @ whole[j]), j) for j in range(60) if j != q)[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(zip(-mine.score, mine.vec_id, strict=True)) == want
