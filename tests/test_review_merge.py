from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from triplewright.operators import merge, metrics, review, store
from triplewright.streaming import ingest

EDGES = "edge_ord long, src string, dst string, label string, source string, sentence string, created_at timestamp, last_updated_at timestamp"


def day(i):
    return F.to_timestamp(F.lit(f"2024-01-0{i} 00:00:00"))


def batch(spark, *rows):
    return spark.createDataFrame([(i, *r, None, None) for i, r in enumerate(rows)], EDGES)


def test_merge_is_idempotent_and_first_wins(spark):
    new = batch(spark, ("a", "b", "is", None, "one"), ("a", "b", "is", "", "two"), ("a", "b", "is", "s", "three"))
    once = merge.merge_edges(new.limit(0), new, day(1))
    got = {r["sentence"]: r for r in once.collect()}
    assert set(got) == {"one", "three"} and got["one"]["created_at"] == datetime.datetime(2024, 1, 1)
    twice = {r["sentence"]: r for r in merge.merge_edges(once, new.withColumn("sentence", F.lit("other")), day(2)).collect()}
    assert set(twice) == {"one", "three"}
    assert twice["one"]["created_at"] == got["one"]["created_at"] and twice["one"]["last_updated_at"] == datetime.datetime(2024, 1, 2)


def test_batch_with_rejects_and_snapshot(spark, tmp_path):
    new = batch(spark, ("a", "b", "is", "s", "x"), ("a", None, "is", "s", "y"), (" ", "b", "is", "s", "z"))
    snapshot, summary, rejects = merge.upsert_batch(new.limit(0), new, day(1))
    assert tuple(summary.first()) == (3, 1, 2) and snapshot.count() == 1
    assert {r["error"] for r in rejects.collect()} == {"a - is -> : dst is empty", "  - is -> b: src is empty"}
    assert tuple(merge.batch_summary(merge.validated(new.limit(0))).first()) == (0, 0, 0)
    merge.write_snapshot(snapshot, str(tmp_path / "g"), "1")
    merge.write_snapshot(snapshot.union(snapshot), str(tmp_path / "g"), "2")
    assert merge.read_snapshot(spark, str(tmp_path / "g")).count() == 2
    merge.write_log(summary, str(tmp_path / "log"), "upsert", "r1")
    assert spark.read.json(str(tmp_path / "log")).first()["stage"] == "upsert"


def test_nodes(spark):
    old = merge.merge_nodes(spark.createDataFrame([], "label string, created_at timestamp, last_updated_at timestamp"), batch(spark, ("a", "b", "is", None, "")), day(1))
    got = {r["label"]: (r["created_at"].day, r["last_updated_at"].day) for r in merge.merge_nodes(old, batch(spark, ("b", "c", "is", None, "")), day(2)).collect()}
    assert got == {"a": (1, 1), "b": (1, 2), "c": (2, 2)}


T = "array<struct<subject:string,object:string,predicate:string>>"


def test_review_rows_and_payload(spark):
    found = spark.createDataFrame([(1, "s1", [("a", "b", "p"), ("a", "", "p")]), (2, "s2", [("a", "b", "p")]), (3, "s1", [("a", "b", "p"), ("c", "d", "p")])], f"ord long, sentence string, triplets {T}")
    rows = review.review_rows(found)
    assert rows.count() == 4 and tuple(review.counters(rows).first()) == (4, 0)
    rows = rows.withColumn("deleted", F.col("sentence") == "s2")
    out = review.checked_payload(review.upsert_payload(rows)).orderBy("first").collect()
    assert [(r["sentence"], [t["subject"] for t in r["triplets"]]) for r in out] == [("s1", ["a", "c"])]
    with pytest.raises(ValueError):
        review.checked_payload(review.upsert_payload(rows.where("sentence = 's2'")))
    with pytest.raises(ValueError):
        review.checked_qualities(spark.createDataFrame([(" ",)], "quality string"))


def test_verdicts_pages_exports(spark):
    rows = spark.createDataFrame([(1, "A ", 0.5, "NEW"), (2, "a", 0.9, "NEW"), (3, "b", 0.9, "EXISTING"), (4, "a", 0.9, "PARTIALLY_NEW")], "ord long, quality string, max_score double, decision string")
    assert [r["ord"] for r in review.verdict_tables(rows).where("decision = 'NEW'").collect()] == [1]
    assert {r["ord"] for r in review.best_per_sentence(rows).collect()} == {2, 3}
    assert [r["ord"] for r in review.page(rows, 99, ["ord"], 3).collect()] == [4]
    assert [r["ord"] for r in review.page(rows, -1, ["ord"], 3).collect()] == [1, 2, 3]
    assert review.page(rows.limit(0), 1, ["ord"]).count() == 0
    got = [(r["place"], r["Group"], r["Similarity"]) for r in review.grouped_export(rows).orderBy("place").collect()]
    assert got == [(1, "NEW", 0.9), (2, "PARTIALLY NEW", 0.9), (3, "EXISTING", 0.9)]


def test_decisions_and_feedback(spark):
    rel = spark.createDataFrame([("1",), ("2",), ("3",)], "edge_key string")
    dec = spark.createDataFrame([("1", "Accept"), ("2", "reject"), ("3", "quit")], "edge_key string, decision string")
    assert {r["status"]: r["n"] for r in review.decision_counts(review.decided(rel, dec)).collect()} == {"accept": 1, "reject": 1, "undecided": 1}
    now = spark.createDataFrame([("1", "t", "u", None)], "id string, exact_text string, username string, edge string")
    more = spark.createDataFrame([("t", "u"), ("t", "v"), ("t", "v")], "exact_text string, username string")
    out = review.feedback_inserted(now, more)
    assert out.count() == 2
    changed = review.feedback_updated(now, spark.createDataFrame([("1", "u", "e")], "id string, username string, edge string"), ["edge"])
    assert changed.first()["edge"] == "e"


def test_timings(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("b", 5.0, 1)], "name string, elapsed_seconds double, finished_at int")
    assert {r[0]: r[1] for r in metrics.timing_summary(rows).collect()} == {"a": 2.0, "b": 5.0}
    assert metrics.total_seconds(rows).first()[0] == 7.0
    frame, seen = metrics.observed(rows, "stage")
    frame.collect()
    assert seen.get["rows"] == 3


def test_stream_survives_failures_before_between_and_after(spark, tmp_path, monkeypatch):
    folder, base = tmp_path / "in", str(tmp_path / "graph")
    folder.mkdir()
    names = iter(("Apple", "Bean", "Carrot", "Daisy", "Elder"))

    def run():
        ingest.ingest(spark, str(folder), base, str(tmp_path / "check"), ["is part of"]).awaitTermination()

    commit, told = store._commit, []

    def before(*_):
        raise OSError("before")

    def after(*what):
        commit(*what)
        raise OSError("after")

    for fail in (before, None, before, after):
        name = next(names)
        (folder / f"{name}.txt").write_text(f"{name} is part of data.")
        told.append(name)
        if fail:
            monkeypatch.setattr(store, "_commit", fail)
            with pytest.raises(Exception):
                run()
        monkeypatch.setattr(store, "_commit", commit)
        run()
        assert sorted(r["src"] for r in store.read(spark, base).collect()) == sorted(told)


def test_two_streams_over_one_graph(spark, tmp_path):
    base, told = str(tmp_path / "graph"), []
    for k, names in enumerate((["Apple"], ["Daisy"], ["Bean"], ["Elder", "Fig"])):
        folder = tmp_path / f"in{k % 2}"
        folder.mkdir(exist_ok=True)
        for name in names:
            (folder / f"{name}.txt").write_text(f"{name} is part of data.")
        ingest.ingest(spark, str(folder), base, str(tmp_path / f"check{k % 2}"), ["is part of"]).awaitTermination()
        told += names
        assert sorted(r["src"] for r in store.read(spark, base).collect()) == sorted(told)


def test_bucketed_table_equals_merge_edges_and_rewrites_few_buckets(spark, tmp_path):
    base = str(tmp_path / "g")
    schema = "edge_ord long, src string, dst string, label string, source string, sentence string, created_at timestamp, last_updated_at timestamp"
    want, rewritten = spark.createDataFrame([], schema), []
    for v in range(6):
        rows = [(i, f"s{i % 300}", "d", "l", None if i % 2 else "", f"{v}:{i}", None, None) for i in range(0 if v == 0 else 290, 320 if v == 0 else 290 + 3 * v)]
        new = spark.createDataFrame(rows, schema)
        rewritten.append(store.upsert(new, base, f"v{v}", day(v + 1), buckets=16, most_deltas=3))
        want = spark.createDataFrame(merge.merge_edges(want, new, day(v + 1)).collect(), schema)
        got = store.read(spark, base)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    state = store.manifest(spark, base)
    touched = {p["bucket"] for p in state["parts"] if p["version"] == "v5"} | set(rewritten[5])
    assert rewritten[0] == rewritten[1] == rewritten[2] == [] and 0 < sum(map(len, rewritten)) < 16
    assert len(touched) < 16  # a small batch leaves the other buckets alone
    with pytest.raises(ValueError, match="in use"):
        store.upsert(new, base, "v2", day(9))


def test_a_number_that_another_writer_took_is_tried_again(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "g")
    edge = lambda name: batch(spark, (name, "d", "l", None, "x"))
    store.upsert(edge("a"), base, "one", day(1), buckets=4)
    real, raced = store.manifest, []

    def stale(session, where):
        state = real(session, where)
        if state and state["number"] == 1 and not raced and session is spark and stale.armed:
            raced.append(True)
            stale.armed = False
            store.upsert(edge("b"), base, "two", day(2))
        return state

    stale.armed = True
    monkeypatch.setattr(store, "manifest", stale)
    store.upsert(edge("c"), base, "three", day(3))
    monkeypatch.setattr(store, "manifest", real)
    assert sorted(r["src"] for r in store.read(spark, base).collect()) == ["a", "b", "c"]


def test_numbered_counts_over_ranges(spark):
    rows = spark.createDataFrame([(i, f"s{i % 40:02}") for i in range(100)], "edge_ord long, sentence string").repartition(5)
    got = [r["line"] for r in review.numbered(rows).collect()]
    assert sorted(got, key=lambda x: int(x.split(".")[0])) == [f"{i + 1}. s{i:02}" for i in range(40)]


def test_no_decision_holds_from_a_quit_on(spark):
    edges = spark.createDataFrame([(k,) for k in "abcd"], "edge_key string")
    said = [("a", "Accept", 1), ("a", "reject", 2), ("b", "reject", 3), ("x", "quit", 4), ("c", "accept", 5)]
    got = review.decided(edges, spark.createDataFrame(said, "edge_key string, decision string, ord int"))
    assert {r[0]: r["status"] for r in got.collect()} == {"a": "accept", "b": "reject", "c": "undecided", "d": "undecided"}


def test_stream_of_files_grows_the_graph(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "graph")
    folder.mkdir()
    for name, body in (("a.txt", "Bias is part of data.\nNothing."), ("b.txt", "Noise is part of data.")):
        (folder / name).write_text(body)
        ingest.ingest(spark, str(folder), base, str(tmp_path / "check"), ["is part of"]).awaitTermination()
    rows = store.read(spark, base).collect()
    assert sorted((r["src"], r["dst"]) for r in rows) == [("Bias", "data"), ("Noise", "data")]


def test_exported_triples_and_sentences(spark):
    rows = [
        (1, "s1", "a", "is", "b", False), (2, "s2", "c", "has", "d", False), (3, "s1", " a ", "is", "b", False),
        (4, "s1", "e", " ", "f", False), (5, "s3", "g", "is", "h", True), (6, "s1", "x", "is", "y", None), (7, "", "p", "is", "q", False),
    ]
    df = spark.createDataFrame(rows, "ord long, sentence string, subject string, predicate string, object string, deleted boolean")
    payload = review.upsert_payload(df)
    got = sorted(tuple(r) for r in review.triple_export(payload, "k").collect())
    assert got == [
        ("k", 1, "s1", 0, "a", "is", "b"), ("k", 1, "s1", 1, "x", "is", "y"), ("k", 2, "s2", 0, "c", "has", "d"), ("k", 7, "", 0, "p", "is", "q"),
    ]
    assert review.triple_export(payload, None).where("keyword is not null").count() == 0
    assert sorted(r["line"] for r in review.numbered(review.payload_sentences(payload)).collect()) == ["1. s1", "2. s2"]
    assert review.triple_export(review.upsert_payload(df.limit(0)), "k").count() == 0
