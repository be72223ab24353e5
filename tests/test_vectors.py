from __future__ import annotations

import os
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from triplewright.functions import encoder
from triplewright.operators import postings, retrieval, topics, vectors
from triplewright.plans.base import vectors as sides
from triplewright.plans.registry import queries

V = "id long, vec array<double>"


def rows(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], V)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    q, x = rng.integers(-3, 4, (23, 4)), rng.integers(-3, 4, (90, 4))
    x[5] = 0
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    s = unit(q) @ unit(x).T
    got = vectors.top_k(rows(spark, q), rows(spark, x), 6, query_tile=10, shard_rows=20).toPandas()
    for i in range(len(q)):
        best = sorted(range(len(x)), key=lambda j: (-round(s[i, j], 9), j))[:6]
        mine = got[got.query_id == i].sort_values("rank")
        assert np.allclose(s[i, best], mine.score) and len(mine) == 6
    assert vectors.top_k(rows(spark, q), rows(spark, x), 0).count() == 0
    assert vectors.top_k(rows(spark, q), rows(spark, x).limit(0), 3).count() == 0


def test_a_tile_holds_few_scores_at_once():
    rng = np.random.default_rng(6)
    side = lambda n, start: pd.DataFrame({"id": range(start, start + n), "vec": list(rng.normal(size=(n, 4))), "shard": 0})
    asked, given = side(2048, 0), side(8192, 1000)
    tracemalloc.start()
    got = vectors._tile(5, True)(asked, given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * 2**20  # some 300 MB before
    s = np.stack(asked.vec) @ np.stack(given.vec).T
    s[asked.id.to_numpy()[:, None] == given.id.to_numpy()[None, :]] = -np.inf
    want = np.sort(np.maximum(s, -2.0), axis=1)[:, ::-1][:, :5]
    assert np.allclose(got.score.to_numpy().reshape(-1, 5), want)


def test_top_k_compares_equal_vectors_once(spark, monkeypatch):
    pairs, real = [], vectors._best

    def best(queries, items, *rest):
        pairs.append(queries.count() * items.count())
        return real(queries, items, *rest)

    monkeypatch.setattr(vectors, "_best", best)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (12, 3))[rng.integers(0, 12, 400)]
    s = (u := x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)) @ u.T
    for others in (False, True):
        got = vectors.top_k(rows(spark, x), rows(spark, x), 7, others=others).toPandas()
        for i in range(len(x)):
            best_ids = sorted((j for j in range(len(x)) if not others or j != i), key=lambda j: (-round(s[i, j], 9), j))[:7]
            mine = got[got.query_id == i].sort_values("rank")
            assert list(mine.item_id) == best_ids and list(mine["rank"]) == list(range(1, 8))
    assert max(pairs) <= 12 * 12  # 160,000 before


def test_unit_checks_the_dimension(spark):
    with pytest.raises(Exception, match="not 3 parts"):
        rows(spark, [[1, 2]]).select(vectors.unit(F.col("vec"), 3)).collect()


def test_filter_pads_with_zero(spark):
    asked = rows(spark, [[1, 0], [-1, 0], [0, 1]])
    given = rows(spark, [[1, 0]])
    out = {r["id"]: r for r in vectors.filter_by_similarity(asked.select("id"), vectors.top_k(asked, given, 2), 2, 0.5).collect()}
    assert out[0]["kept"] and out[0]["max_score"] == 1.0 and out[0]["neighbors"][0]["edge_id"] == 0
    assert out[1]["max_score"] == 0.0 and not out[1]["kept"] and out[1]["neighbors"] == []
    equal = vectors.filter_by_similarity(asked.select("id"), vectors.top_k(asked, given, 1), 1, 1.0)
    assert equal.where("kept").count() == 1 and {r["id"]: r["max_score"] for r in equal.collect()}[1] == -1.0


def test_approximate_finds_near_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    got = vectors.approximate_top_k(rows(spark, x + 0.01), rows(spark, x), 1).toPandas()
    assert (got.query_id == got.item_id).mean() > 0.9


def test_approximate_recall_on_the_embeddings_table(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    got = queries()["s51b_approximate_top_k"](spark, folder).toPandas()
    asked, given = (side.toPandas() for side in sides(spark, folder))
    q, x = (np.stack(s["vec"].to_numpy()) for s in (asked, given))
    scores = q @ x.T / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    scores[asked["id"].to_numpy()[:, None] == given["id"].to_numpy()[None, :]] = -np.inf
    best = given["id"].to_numpy()[np.argsort(-scores, axis=1, kind="stable")[:, :5]]
    mine = got.groupby("query_id")["item_id"].agg(set).to_dict()
    assert all(len(mine.get(i, ())) == 5 for i in asked["id"])
    recall = np.mean([len(mine[i] & set(b)) / 5 for i, b in zip(asked["id"], best.tolist(), strict=True)])
    print("recall@5", recall)
    assert recall >= 0.9


def test_approximate_fills_queries_whose_cells_hold_too_few(spark):
    x = np.random.default_rng(2).normal(size=(400, 8))
    asked, given = rows(spark, x[:9] + 0.5), rows(spark, x)
    got = vectors.approximate_top_k(asked, given, 3, cells=300, recall=0.01).toPandas()
    assert (got.groupby("query_id").size() == 3).all() and len(got) == 27


def test_approximate_splits_a_cell_that_holds_most_rows(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.ones((900, 8)) + rng.normal(scale=1e-3, size=(900, 8)), rng.normal(size=(300, 8))])
    asked, given = rows(spark, x[:50]), rows(spark, x)
    got = vectors.approximate_top_k(asked, given, 4, recall=1.0, query_tile=16, shard_rows=64, others=True).toPandas()
    want = vectors.top_k(asked, given, 4, others=True).toPandas()
    hit = got.merge(want, on=["query_id", "item_id"])
    assert len(got) == len(want) == 200 and len(hit) >= 190


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "dog dog bird"), (3, "fish"), (4, "Cat"), (5, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "CAT dog")], "query_id long, text string")
    got = retrieval.bm25(docs, asked, 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 2]
    f = retrieval.fused(retrieval.bm25(docs, asked), retrieval.overlap(docs, asked), 0.5).orderBy("rank").collect()
    assert [r["doc_id"] for r in f] == [1, 2]
    context = retrieval.contexts(retrieval.bm25(docs, asked), docs, "C:").first()["context"]
    assert context == "C:cat dog\n\ndog dog bird"
    said = spark.createDataFrame([("cat dog",)], "sentence string")
    assert [r["doc_id"] for r in retrieval.expanded(said, docs).collect()] == [2]


def test_posting_blocks_equal_bm25(spark, tmp_path):
    rng = np.random.default_rng(3)
    vocab = np.array([f"w{i}" for i in range(60)])
    p = 1 / np.arange(1, 61)
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(0, 40), p=p / p.sum()))) for i in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(7, "W40 w50"), (8, "w0 w0 w1"), (9, "nothing"), (10, "w59"), (11, "w3 w30 w33")], "query_id long, text string")
    path = str(tmp_path / "index")
    postings.build(docs, path, block=20, folders=3)
    got = sorted(map(tuple, postings.search(spark, path, asked, 5).collect()))
    assert got == sorted(map(tuple, retrieval.bm25(docs, asked, 5).collect())) and len(got) >= 15
    none = str(tmp_path / "none")
    postings.build(docs.limit(0), none)
    assert postings.search(spark, none, asked).count() == 0


def test_bm25_is_scored_where_documents_are(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vocab = np.array([f"w{i}" for i in range(40)] + ["W1", "é\u00a0x"])
    docs = [(i, "\t ".join(rng.choice(vocab, rng.integers(0, 30)))) for i in range(300)] + [(900, None), (901, " \n"), (902, "w1 w2"), (903, "w1 w2")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(7, "W1 w2 w2"), (8, "é\u00a0X w7"), (9, "nothing"), (10, None)], "query_id long, text string")
    near = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())
    mine = retrieval.bm25(docs, asked, 5)
    plan = mine._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "Generate" not in plan  # postings were shuffled before
    here = near(mine), near(retrieval.overlap(docs, asked, 5))
    monkeypatch.setattr(retrieval, "SENT", 0)
    assert here == (near(retrieval.bm25(docs, asked, 5)), near(retrieval.overlap(docs, asked, 5))) and len(here[0]) >= 10


def test_diverse_prefers_difference(spark):
    items = rows(spark, [[1, 0], [1, 0], [0.0, 1.0]])
    hits = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.9), (0, 2, 0.6)], "query_id long, item_id long, score double")
    assert [r["item_id"] for r in retrieval.diverse(hits, items, 2).orderBy("rank").collect()] == [0, 2]


def test_encoder_is_repeatable(spark):
    texts = spark.createDataFrame([(1, "Data bias"), (2, "bias data"), (3, "")], "id long, text string")
    got = {r["id"]: np.array(r["vec"]) for r in encoder.encoded(texts).collect()}
    assert np.allclose(got[1], got[2]) and not got[3].any() and abs(np.linalg.norm(got[1]) - 1) < 1e-6


def test_topics(spark):
    base = [("cats", "cat cat purr meow"), ("dogs", "dog bark bone")]
    texts = [(f"{k}{i}", t) for k, t in base for i in range(12 + (k == "dogs"))] + [("z", "fish fin"), ("e", " ")]
    found = topics.clustered(spark.createDataFrame(texts, "id string, text string")).cache()
    got = {r["id"]: r["topic_id"] for r in found.collect()}
    assert all(got[f"dogs{i}"] == 0 for i in range(13)) and all(got[f"cats{i}"] == 1 for i in range(12))
    assert got["z"] == got["e"] == -1
    words = topics.topic_words(found)
    hits = {r["topic_id"]: r for r in topics.matched(words, found, "CAT", ["dog", "bone"]).collect()}
    assert (hits[1]["match_type"], hits[1]["matched_terms"], hits[1]["keyword_count"], hits[1]["n_paragraphs"]) == ("exact", ["cat"], 1, 12)
    assert (hits[0]["match_type"], hits[0]["matched_terms"], hits[0]["keyword_count"]) == ("synonym", ["bone", "dog"], 0)
    inside = topics.matched_paragraphs(topics.matched(words, found, "cat", []), found).collect()
    assert {r["id"] for r in inside} == {f"cats{i}" for i in range(12)}
    info = {r["topic_id"]: r for r in topics.topic_info(found, words).collect()}
    assert info[-1]["n_paragraphs"] == 2 and info[-1]["name"] == "-1" and info[1]["name"] == "1_cat_meow_purr"
    docs = {r["id"]: r for r in topics.document_info(found, words).collect()}
    assert len(docs) == 27 and docs["z"]["probability"] == 0 and docs["cats0"]["probability"] == 1
    assert sum(r["is_representative"] for r in docs.values()) == 6 and docs["dogs3"]["top_words"] == "bark - bone - dog"
    told = topics.report(found, words, topics.matched(words, found, "cat", []), "cat", []).first()
    assert told["n_paragraphs"] == 27 and told["n_topics"] == 3 and told["matched"][0]["topic_id"] == 1


def _records_shuffled(spark) -> int:
    """Records that all stages so far wrote to a shuffle."""
    store, total, stage = spark.sparkContext._jsc.sc().statusStore(), 0, 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    last = spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    for stage in range(last):
        try:
            total += store.lastStageAttempt(stage).shuffleWriteRecords()
        except Exception:  # a stage that was skipped has no attempt
            continue
    return total


def test_a_query_goes_once_to_a_part_of_the_cells_it_looks_into(spark):
    x = np.random.default_rng(12).normal(size=(2000, 16))
    points = rows(spark, x).localCheckpoint()
    before = _records_shuffled(spark)
    got = vectors.approximate_top_k(points, points, 5, recall=1.0, others=True).toPandas()
    assert _records_shuffled(spark) - before < 20 * len(x)  # it was sent to each of its cells, some 40
    want = vectors.top_k(points, points, 5, others=True).toPandas()
    key = ["query_id", "rank"]
    a, b = got.sort_values(key), want.sort_values(key)
    assert a["item_id"].tolist() == b["item_id"].tolist() and np.allclose(a["score"], b["score"])


def test_hits_of_many_parts_and_of_equal_vectors_are_exact(spark):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=(900, 8)), np.repeat(rng.normal(size=(3, 8)), 200, axis=0)])
    got = vectors.approximate_top_k(rows(spark, x), rows(spark, x), 4, recall=1.0, query_tile=100, shard_rows=150, others=True).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    np.fill_diagonal(scores, -9)
    for i in range(0, len(x), 7):
        mine = got[got.query_id == i].sort_values("rank")
        assert np.allclose(mine["score"], np.sort(scores[i])[::-1][:4], atol=1e-8)
        if i >= 900:  # copies: the smallest ids
            assert mine["item_id"].tolist() == [j for j in range(900 + (i - 900) // 200 * 200, len(x)) if j != i][:4]


def test_an_index_shuffles_texts_and_not_their_postings_or_scores(spark, tmp_path):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in rng.integers(0, 300, 120))) for i in range(600)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(f"w{j}" for j in rng.integers(0, 300, 8))) for i in range(40)], "query_id long, text string")
    before = _records_shuffled(spark)
    postings.build(docs, str(tmp_path / "index"), block=100)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 4)) for r in postings.search(spark, str(tmp_path / "index"), asked).collect()}
    assert _records_shuffled(spark) - before < 15_000  # there are 59,000 postings, and 24,000 documents with a score
    want = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 4)) for r in retrieval.bm25(docs, asked).collect()}
    assert got == want and len(got) == 160
