from __future__ import annotations

import hashlib
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triplewright.llm import bpe, packing, queries

TEXTS = [
    "",
    None,
    " \t\n",
    "Hello World's it'll 'sx don''t",
    "<|endoftext|>abc <|ENDOFTEXT|> x<|startoftext|>y's <|",
    "ΣΑΣ Σ ÇÉ é É x\u0085y \x1c",
    "日本語テキスト 123 4½ ² _a_b",
    "a" * 3000,
    "🙂🙂 İstanbul ǅ ﬁ \x0b\x0c tab\t",
    "word " * 9000,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    return bpe.WordBpe(queries.VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcdeéÉ'stre<|>endofx \n.,1", max_size=80))
def test_any_text_encodes_as_the_library(library, encoder, text):
    text = text.encode("utf-8", "ignore").decode()
    want = library.encode(text, add_special_tokens=False).ids
    got = encoder.encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == want
    assert encoder.decode(got) == library.decode(want, skip_special_tokens=False)


def test_every_code_point_encodes_as_the_library(library, encoder):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4000):
        some = points[at : at + 4000]
        # between letters, and with marks before and after, where normal forms may reorder or compose
        text = " ".join(f".{chr(c)}b" for c in some) + " " + " ".join(f"a\u0301{chr(c)}\u0323" for c in some)
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want, hex(some[0])


def test_long_words(library, encoder):
    rng = np.random.default_rng(3)
    letters = "".join(chr(97 + int(v)) for v in rng.integers(0, 26, 160_000))
    for word in (letters, "a" * 160_000, "日本" * 20_000, *(letters[:n] for n in (1, 2, 3, 255, 256, 257, 300))):
        start = time.time()
        got = np.frombuffer(encoder.encode([word])[0], "<u4").tolist()
        assert time.time() - start < 10
        assert got == library.encode(word, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=70))
def test_both_merges_agree(encoder, word):
    assert encoder._merge_one(word) == encoder.words([word] * bpe.FEW)[0]


def test_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    small = bpe.WordBpe(queries.VOCABULARY)
    for i in range(10):
        text = f"some words{i} again{i} and{i} more{i}"
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(small.known) < 40


def test_round_trip_table(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r["doc_id"]: r for r in bpe.bpe_digests(docs, queries.VOCABULARY).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_digests(docs.limit(0), queries.VOCABULARY).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=8), st.integers(1, 60))
def test_fill_is_optimal(counts, room):
    taken = packing.fill(counts, room)
    assert all(0 < c <= counts[n] for n, c in taken.items())
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    assert sum(n * c for n, c in taken.items()) == max(sums)


def check(rows, texts, library, capacity, ids_column):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t in texts.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(docs.pop(i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            piece = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r[ids_column] == (piece if ids_column == "ids" else zlib.crc32(piece))
            at += r["length"]
        assert at == len(ids)
    assert not docs
    short = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == capacity or at & (at - 1) == 0 and at < capacity
        short += at != capacity
    return short


def test_packing_is_whole_and_gapless(spark, library):
    texts = dict(enumerate(TEXTS)) | {100 + i: "some text here " * (i % 37) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit(1)).repartition(3)
    for capacity in (64, 4096):
        rows = packing.pack(docs, queries.VOCABULARY, capacity).collect()
        assert check(rows, texts, library, capacity, "ids") <= 3 * 12
    assert packing.pack(docs.limit(0), queries.VOCABULARY).count() == 0
    twice = docs.where("doc_id = 3").union(docs.where("doc_id = 3")).withColumn("doc_id", F.lit(None).cast("long"))
    out = packing.pack(twice, queries.VOCABULARY).collect()
    assert {r["doc_id"] for r in out} == {None} and sum(r["length"] for r in out) == 2 * out[0]["doc_tokens"]


def test_registered_queries(spark, data, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    check(queries.op3_packing(spark, data).collect(), docs, library, 4096, "ids_crc32")
    rows = queries.op6_bpe(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_ids_beyond_doubles_beside_nulls(spark):
    docs = spark.createDataFrame([(2**53 + 1, "a b"), (None, "c")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in bpe.bpe_digests(docs, queries.VOCABULARY).collect()} == {2**53 + 1, None}
    assert {r["doc_id"] for r in packing.pack(docs, queries.VOCABULARY).collect()} == {2**53 + 1, None}
