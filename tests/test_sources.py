from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from triplewright import schemas
from triplewright.functions import text
from triplewright.sources import readers


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_sentences_of_a_text_file(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿First one.\r\n---\n\n  foo .  \nlast\x0bmore!!".encode())
    rows = readers.text_sentences(readers.read_texts(spark, str(tmp_path))).orderBy("page_number").collect()
    assert [r["sentence"] for r in rows] == ["First one", "", "foo ", "last", "more"]
    assert [r["page_number"] for r in rows] == [0, 1, 2, 3, 4]
    assert rows[0]["source"].endswith("a.txt")


def test_chunks_cover_the_text_and_overlap():
    body = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6))
    out = readers.chunks(body, 100, 20)
    assert all(len(c) <= 100 and body[s : s + len(c)] == c for s, c in out)
    assert out[0][0] == 0 and all(a[0] < b[0] for a, b in zip(out, out[1:], strict=False))
    covered = set()
    for s, c in out:
        covered |= set(range(s, s + len(c)))
    assert all(body[i].isspace() for i in range(len(body)) if i not in covered)
    assert any(b[0] < a[0] + len(a[1]) for a, b in zip(out, out[1:], strict=False))
    assert readers.chunks("", 10, 2) == [] and readers.chunks("a" * 25, 10, 0) == [(0, "a" * 10), (10, "a" * 10), (20, "a" * 5)]


def test_chunk_table_and_errors(spark):
    docs = spark.createDataFrame([(1, "doi: 10.1/abc\nkept  line\n12\nme@example.org"), (2, None), (3, "doi:10.2/x")], "doc_id long, text string")
    rows, mode = readers.chunk_corpus(docs, "PDF_CHUNKS")
    got = {r["doc_id"]: r["chunk"] for r in rows.collect()}
    assert mode == "chunks" and got == {1: "kept line", 3: ""}
    with pytest.raises(ValueError):
        readers.chunk_corpus(docs, "PDF_SENTENCES")
    with pytest.raises(ValueError):
        readers.chunk_corpus(docs.where("doc_id = 2"), "TEXT")
    with pytest.raises(ValueError):
        readers.paragraphs_of(spark.createDataFrame([(1, " \n\t")], "doc_id long, text string"), need=True)


def test_pages(spark):
    docs = spark.createDataFrame([(1, "dir/file.name.pdf", "a\nb\nc")], "doc_id long, source string, text string")
    rows = readers.pages_of(docs, 2).orderBy("page_number").collect()
    assert [(r["title"], r["page_number"], r["body"]) for r in rows] == [("file.name", 1, "a"), ("file.name", 2, "b")]


def test_seed(spark, tmp_path):
    (tmp_path / "s.csv").write_text("source;relationship;destination\n Fair  ness ;is a;Value\n;is a;x\na;;b\n\nBias;harms;Fairness\n")
    rows = readers.seed_edges(readers.read_seed(spark, str(tmp_path / "s.csv")), "s.csv").orderBy("src").collect()
    assert [(r["src"], r["label"], r["dst"], r["sentence"]) for r in rows] == [
        ("Bias", "harms", "Fairness", "Bias harms Fairness"),
        ("Fair ness", "is a", "Value", "Fair ness is a Value"),
    ]
    with pytest.raises(ValueError):
        readers.seed_edges(spark.createDataFrame([("", "a", "b")], schemas.SEED), "x", need=True)


def test_keywords(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"keywords": [" bias ", "", "fairness"]}')
    assert [r[0] for r in readers.read_keywords(spark, str(tmp_path / "k.json")).collect()] == ["bias", "fairness"]
    (tmp_path / "bad.json").write_text('{"words": []}')
    with pytest.raises(Exception, match="must be a list"):
        readers.read_keywords(spark, str(tmp_path / "bad.json")).collect()


def test_logs_with_a_corrupt_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"keyword": "bias", "limit_per_pattern": 50, "num_hits": 0, "hits": []}')
    (tmp_path / "b.json").write_text('{"keyword": "bias", ')
    rows = readers.read_log(spark, str(tmp_path), schemas.RETRIEVAL_LOG).collect()
    assert sorted(r["_corrupt_record"] is None for r in rows) == [False, True]


def test_feedback_frame(spark, tmp_path):
    empty = readers.empty_feedback(spark)
    empty.write.option("header", True).csv(str(tmp_path / "f"))
    assert readers.read_feedback(spark, str(tmp_path / "f")).count() == 0 and "updated_edge" in empty.columns


def test_text_functions(spark):
    assert one(spark, "  A b\n\tC! ", text.normalize) == "a b c!"
    assert one(spark, None, text.collapse) == ""
    assert one(spark, "Short. This one is long enough to stay! ok?", text.sentences) == ["This one is long enough to stay!"]
    assert one(spark, "1. x\nReceived 2020\nme@a.org\nDOI: 10.1/z\nkeep", lambda c: text.clean_lines(c, (*text.CHUNK_RULES, text.FRONT_MATTER))) == "keep"
    assert one(spark, "a  b\n\n c", lambda c: text.clean_lines(c, text.PAGE_RULES, "\n")) == "a b\nc"
    said = lambda c: text.relation_text(F.nullif(c, F.lit("")), F.lit("data_bias"), F.lit("is_a"), F.lit("Risk"))
    assert one(spark, "", said) == "Data bias is a Risk" and one(spark, "own_sentence here", said) == "Own sentence here"
    assert one(spark, "x", text.node_id) == "n_11f6ad8ec52a"
    assert one(spark, "Ärger über_x 1!", text.tokens) == ["ärger", "über_x", "1"]


def test_coerced_edges(spark):
    rows = spark.createDataFrame([(None, "b", 7, None), ("t", "b", None, 1), (None, None, 1, 1)], "type string, label string, source_id long, target_id long")
    got = readers.coerced_edges(rows).collect()
    assert [(r["label"], r["source_id"], r["target_id"]) for r in got] == [("b", "7", ""), ("t", "", "1"), ("REL", "1", "1")]


def test_chunks_of_long_texts_leave_in_batches_of_bounded_size():
    import pyarrow as pa

    texts = ["one two three. " * 20_000, None, "x" * 5_000, "\n\n" + "line of words\n" * 30_000 + "end", ""] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([1] * len(texts)), pa.array(texts)], ["doc_id", "page_number", "body"])
    out = list(readers._chunk_batches(700, 70)(iter([batch])))
    assert len(out) > 2 and max(sum(map(len, b.column(3).to_pylist())) for b in out) < readers.GIVEN + 700
    got = [(r["doc_id"], r["start_index"], r["chunk"]) for b in out for r in b.to_pylist()]
    assert got == [(i, *c) for i, t in enumerate(texts) for c in readers.chunks(t or "", 700, 70)]
    assert list(readers._cut("\n\n\na\n\nb", "\n\n")) == ["", "\n\n\na", "\n\nb"] and list(readers._cut("ab", "")) == ["a", "b"]
