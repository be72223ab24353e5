from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from triplewright.llm import quality, secret_scan, simhash


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    before = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "simhash near-dedup", "secret scans", "packing"]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = stages["quality classifier"](spark, docs, data)
    want = {r["doc_id"] for r in quality.classify(docs, labels).where("keep").select("row.*").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns
    lines = stages["line dedup"](spark, docs, data)
    rows = lines.collect()
    assert lines.columns == docs.columns and {r["doc_id"] for r in rows} == set(before)
    assert all(r["n_chars"] == len(r["text"]) <= before[r["doc_id"]]["n_chars"] for r in rows)
    near = stages["simhash near-dedup"](spark, docs.union(docs), data)
    shingles = {i: set(simhash.shingles_of(r["text"] or "", 5)) for i, r in before.items()}
    root = {i: i for i in before}
    by: dict = {}
    for i, found in shingles.items():
        for x in found or {b""}:
            by.setdefault(x, []).append(i)

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, j in {(i, j) for ids in by.values() for i in ids for j in ids if i < j}:
        both = len(shingles[i] & shingles[j])
        if both >= 0.8 * (len(shingles[i]) + len(shingles[j]) - both):
            low, high = sorted((top(i), top(j)))
            root[high] = low
    want_kept = {i for i in before if root[i] == i}
    got = [r["doc_id"] for r in near.collect()]
    assert len(got) == len(set(got)) and want_kept <= set(got)  # nothing goes that brute force keeps
    assert len(set(got) - want_kept) <= 0.1 * (len(before) - len(want_kept))
    masked = {r["doc_id"]: r["text"] for r in stages["secret scans"](spark, docs, data).collect()}
    found = {r["doc_id"]: r["spans"] for r in secret_scan.secret_scan(docs).select("row.doc_id", "spans").collect()}
    for i, spans in found.items():
        text, out, at = before[i]["text"], "", 0
        for s in spans:
            if s["start"] >= at:
                out += text[at : s["start"]] + "***"
            at = max(at, s["end"])
        assert masked[i] == out + text[at:]


def test_run_is_the_stages_in_order(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
    want = {r["doc_id"] for r in docs.collect()}
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in rows} == want
    for i in want:
        pieces = sorted((r["start"], r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] == i)
        assert sum(p[1] for p in pieces) == pieces[0][2]


def test_odd_documents(spark, data):
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0), (-2, "x", None, "s", None)], schema)
    clash = odd.withColumns({n: F.lit(1) for n in ("row", "__key", "__h", "keep", "body", "id", "of", "spans", "gone", "fp", "point", "lines")})
    for docs in (odd, odd.limit(0), odd.union(odd), clash):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, data)
            if name != "packing":
                assert out.columns == docs.columns
            out.collect()
