from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from triplewright.llm import components, queries, simhash


def fingerprint(text: str, k: int = 3) -> int:
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    bits = [sum(xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def linked(points: list[int], radius: int) -> list[int]:
    x, root = np.array(points, dtype=np.uint64), list(range(len(points)))

    def find(a: int) -> int:
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= radius).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def test_spark_and_python_hash_alike(spark):
    row = spark.createDataFrame([("über das haus",)], "t string").select(F.xxhash64("t")).first()
    assert row[0] & (1 << 64) - 1 == xxh64_intdigest("über das haus".encode(), 42)


def test_fingerprints():
    texts = ["", "one", "One two", "a b c d e f", "ÄB c D e\x0bf", " x ", "word " * 5000, "k l m n o p q r s t"]
    assert simhash.fingerprints_of(texts)[:, 0].tolist() == [fingerprint(t) for t in texts]


def test_fingerprints_over_several_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    texts = ["a b c d e f g h i j k l m n o p", "", "q r s", "t u v w x y z a b c d e f"]
    assert simhash.fingerprints_of(texts)[:, 0].tolist() == [fingerprint(t) for t in texts]


@pytest.mark.parametrize(("radius", "free", "tile"), [(3, 2, 1024), (3, 2, 16), (2, 1, 16)])
def test_links_equal_brute_force(spark, monkeypatch, radius, free, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    points = {int(v) for v in rng.integers(0, 1 << 63, 150)} | {0, (1 << 64) - 1, 1 << 63}
    for center in list(points)[:4]:  # dense groups around some
        for _ in range(120):
            points.add(center ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False)))
    points = sorted(points, key=lambda p: p - (1 << 64) if p >> 63 else p)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius, free)
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    want = linked(points, radius)
    assert [got.get(s, s) for s in signed] == [signed[w] for w in want]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3), (3, 2)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 501
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_keep_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base), (3, base + " end"), (9, base.upper()), (1, "other text entirely here"), (2, None), (4, " "), (None, base), (3, base + " end"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "body": F.lit("x"), "keep": F.lit(0)})
    out = simhash.near_duplicates(docs).collect()
    want = linked([fingerprint(t or "") for _, t in rows], 3)
    assert len(out) == len(rows)
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in out}
    for (i, t), w in zip(rows, want, strict=True):
        ids = [rows[j][0] for j in range(len(rows)) if want[j] == w and rows[j][0] is not None]
        assert got[i, f"{fingerprint(t or ''):016x}"] == (min(ids) if ids else None)
    assert len({(r["component_id"], r["doc_id"], r["body"]) for r in out if r["keep"]}) == len(set(want))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_registered_query(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = sorted(docs)
    want = linked([fingerprint(docs[i]) for i in ids], 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, data).collect()}
    assert got == {i: (f"{fingerprint(docs[i]):016x}", ids[w]) for i, w in zip(ids, want, strict=True)}


def test_roots_of_a_forest(spark):
    rows = [(i, i - 1) for i in range(2, 40)] + [(101, 100), (102, 100), (103, 102)]
    found = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(rows, "node long, root long")).collect()}
    assert found == {**{i: 1 for i in range(2, 40)}, 101: 100, 102: 100, 103: 100}
    assert components.roots(spark.createDataFrame([], "node long, root long")).count() == 0
