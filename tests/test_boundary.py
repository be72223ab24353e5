from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_vectors import _records_shuffled

from triplewright.operators import boundary, bulk, gate, novelty, triples
from triplewright.steps import written


def answers(spark, *raws):
    return spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "prompt_hash string, raw string")


def test_parsed_objects(spark):
    raws = ['{"a": 1}', '```json\n{"a": "}"}\n```', 'Sure: {"a": {"b": [1]}} and {', "nothing", None, '{"a": ', "[1]"]
    got = [r["value"] for r in boundary.parsed(answers(spark, *raws)).orderBy("prompt_hash").collect()]
    assert got == ['{"a": 1}', '{"a": "}"}', '{"a": {"b": [1]}}', "{}", "{}", "{}", "{}"]
    got = [r["value"] for r in boundary.parsed(answers(spark, "[1]", '{"a":1}', "x [2] y", "no"), array=True).orderBy("prompt_hash").collect()]
    assert got == ["[1]", '[{"a":1}]', "[2]", "[]"]


def test_qualities_or_lines(spark):
    rows = boundary.qualities_or_lines(answers(spark, '{"qualities": [" a ", 3, "", "b"]}', "- one\n\n• two\nthree", '{"qualities": "x"}'))
    got = [r["qualities"] for r in rows.orderBy("prompt_hash").collect()]
    assert got == [["a", "b"], ["one", "two", "three"], ['{"qualities": "x"}']]


def test_batches(spark):
    rows = spark.createDataFrame([(1, i, f"t{i}") for i in range(7)], "doc_id long, ord int, text string")
    b = boundary.batched(rows, 3, ["doc_id"], ["ord"])
    assert [(r["batch_id"], r["id"], r["running"]) for r in b.orderBy("ord").collect()] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 3), (1, 1, 4), (1, 2, 5), (2, 0, 6)]
    p = boundary.prompts(b, "s", ["doc_id"], "text").orderBy("batch_id").collect()
    assert p[2]["payload_json"] == '{"items":[{"id":0,"text":"t6"}]}' and p[0]["n"] == 3
    with pytest.raises(ValueError):
        boundary.batched(rows, 0, ["doc_id"], ["ord"])


def test_batch_qualities(spark):
    sent = spark.createDataFrame([("0", 0), ("0", 1), ("0", 2), ("1", 0)], "prompt_hash string, id int")
    raw = '{"results": [{"id": "0", "qualities": ["first"]}, {"id": 0, "qualities": [" a", 5, ""]}, {"id": 9, "qualities": ["x"]}, {"id": "z", "qualities": ["y"]}, {"id": 2, "qualities": ["1","2","3"]}]}'
    got = {(r["prompt_hash"], r["id"]): r["qualities"] for r in boundary.batch_qualities(sent, answers(spark, raw), cap=2).collect()}
    assert got == {("0", 0): ["a", "5"], ("0", 1): [], ("0", 2): ["1", "2"], ("1", 0): []}
    with pytest.raises(Exception, match="no answer"):
        boundary.batch_qualities(sent, answers(spark, raw), on_error="fail").collect()


def test_synonyms(spark):
    raw = '{"synonyms": ["A", "b", 3, "c"]}'
    rows = spark.createDataFrame([("k", raw)], "keyword string, raw string")
    assert [r["synonym"] for r in boundary.synonyms(rows, 2).orderBy("ord").collect()] == ["a", "b"]


def test_cascade(spark):
    rows = spark.createDataFrame(
        [(0, ["Bias"], 0.9, 0.9), (1, ["skew"], 0.9, 0.9), (2, ["x"], 0.45, 0.0), (3, ["x"], 0.1, 0.65), (4, [], 0.1, 0.1), (5, ["x"], None, None)],
        "id int, keywords array<string>, global_sim double, keyword_sim double",
    )
    got = [(r["match_type"], r["matched_terms"], r["score"]) for r in gate.cascade(rows, "BIAS", ["Skew", "lean"]).orderBy("id").collect()]
    assert got == [
        ("exact", ["bias"], None),
        ("synonym", ["skew"], None),
        ("near_paragraph_global", [], 0.45),
        ("near_paragraph_keywords", [], 0.65),
        (None, [], None),
        (None, [], None),
    ]


def test_prompts_that_lie_written_are_not_made_again(spark, monkeypatch):
    rows = spark.createDataFrame([("a", i, f"t{i}") for i in range(7)], "doc string, ord int, text string")
    sent = boundary.prompts(boundary.batched(rows, 3, ["doc"], ["ord"]), "decompose", ["doc"], "text").localCheckpoint()
    said = sent.where("batch_id <> 1").select("prompt_hash", F.lit('{"results": [{"id": 0, "qualities": ["x"]}]}').alias("raw"))
    want = {p: sorted(map(tuple, boundary.decomposed(rows, said, 3, ["doc"], ["ord"], "text", on_error=p).collect())) for p in ("empty", "stop")}
    monkeypatch.setattr(boundary, "batched", None)
    for p in want:
        got = boundary.decomposed(rows, said, 3, ["doc"], ["ord"], "text", on_error=p, sent=sent)
        assert sorted(map(tuple, got.collect())) == want[p] and len(want[p]) == (2 if p == "empty" else 1)


def test_keywords_are_scored_where_paragraphs_are(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocab = np.array([f"w{i}" for i in range(50)] + ["the", "É1", "x"])
    data = [(i // 4, i % 4, " ".join(rng.choice(vocab, rng.integers(0, 25)))) for i in range(200)] + [(99, 0, None), (99, 1, "--")]
    rows = spark.createDataFrame(data, "doc_id long, ord int, body string").repartition(3)
    words = [[w.lower() for w in (b or "").split() if len(w) >= 2 and w not in ("the", "--")] for _, _, b in data]
    df = Counter(w for ws in words for w in set(ws))
    want = []
    for (doc, ord_, _), ws in zip(data, words, strict=True):
        best = sorted((-round(tf * (math.log((1 + len(data)) / (1 + df[w])) + 1), 9), w) for w, tf in Counter(ws).items())[:3]
        want += [(doc, ord_, i + 1, w) for i, (_, w) in enumerate(best)]
    for frequent in (gate.FREQUENT, 20, 0):  # all words known, some, none
        monkeypatch.setattr(gate, "FREQUENT", frequent)
        found = gate.keywords(rows, 3)
        if frequent > 20:  # paragraphs and their terms were shuffled before
            plan = found._jdf.queryExecution().sparkPlan().toString()
            assert "Window" not in plan and "Join" not in plan
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_keywords_and_gate(spark):
    rows = spark.createDataFrame([(1, 0, "The bias of the data bias"), (1, 1, "a the of"), (2, 0, "data noise")], "doc_id long, ord int, body string")
    got = gate.keywords(rows, 1).orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"], r["ord"], r["term"]) for r in got] == [(1, 0, "bias"), (2, 0, "noise")]
    out = {(r["doc_id"], r["ord"]): r["match_type"] for r in gate.filter_paragraphs(rows, "bias", ["noise"]).collect()}
    assert out == {(1, 0): "exact", (1, 1): None, (2, 0): "synonym"}


def test_novelty_rules(spark):
    n = "array<struct<score:double,sentence:string>>"
    rows = spark.createDataFrame(
        [(0, "data bias harms", 0.95, [(0.95, "Data bias harms")]), (1, "data bias harms women", 0.95, [(0.95, "Data bias harms")]), (2, "x", 0.2, [(0.2, "y")]), (3, "x", 0.99, [])],
        f"id int, quality string, max_score double, neighbors {n}",
    )
    got = [(r["decision"], r["novel_spans"]) for r in novelty.by_rules(rows).orderBy("id").collect()]
    assert got[0] == ("EXISTING", []) and got[1] == ("PARTIALLY_NEW", ["women"]) and got[2][0] == "NEW" and got[3][0] == "NEW"
    kept = spark.createDataFrame([(0, [(0.9, " "), (0.8, "a"), (0.7, "b"), (0.6, "c")])], f"id int, neighbors {n}")
    assert [x["sentence"] for x in novelty.inputs(kept).first()["neighbors"]] == ["a", "b"]


VERDICT = "id long, decision string, rationale string, novel_spans array<string>, matched_neighbor_sentence string, confidence string"


def test_coerced_verdicts(spark):
    rows = spark.createDataFrame(
        [(0, "existing", None, ["a"], " ", "0.5"), (1, "?", "r", None, "m", "1.2"), (2, "NEW", "r", [" "], "m", None)], VERDICT
    )
    got = novelty.coerced(rows).orderBy("id").collect()
    assert [r["decision"] for r in got] == ["PARTIALLY_NEW", "PARTIALLY_NEW", "NEW"]
    assert [r["valid"] for r in got] == [True, False, False] and got[0]["matched_neighbor_sentence"] is None
    with pytest.raises(Exception, match="confidence"):
        novelty.strict(rows).collect()
    assert {r["decision"]: r["n"] for r in novelty.counts(novelty.coerced(rows)).collect()} == {"EXISTING": 0, "PARTIALLY_NEW": 2, "NEW": 1}
    assert novelty.policy(None) == ("PARTIALLY_NEW", "NEW") and novelty.policy("existing, ?") == ("EXISTING",)
    assert novelty.qualifying(rows).count() == 3


def test_aligned_ids(spark):
    sent = spark.createDataFrame([(0, "a"), (1, "b")], "id long, quality string")
    got = spark.createDataFrame([(0, 0, "x"), (0, 1, "y"), (1, 2, "z")], "id long, pos int, decision string")
    assert [r["decision"] for r in novelty.aligned(sent, got).orderBy("id").collect()] == ["y", "z"]
    for bad in (got.where("id = 0"), got.union(spark.createDataFrame([(7, 3, "w")], got.schema))):
        with pytest.raises(Exception, match="differ"):
            novelty.aligned(sent, bad).collect()


def test_extractions(spark):
    raw = '{"triplets": [["a ", "b", "c"], ["a", "b"], ["a", "b", "c", "d"], ["a", 1, "c"], ["", "b", "c"]]}'
    rows = spark.createDataFrame([("in", raw), ("in2", "no")], "input string, raw string")
    got = {r["input"]: (r["sentence"], [tuple(t) for t in r["triplets"]]) for r in triples.extraction(rows).collect()}
    assert got == {"in": ("in", [("a", "b", "c"), ("", "b", "c")]), "in2": ("in2", [])}
    sent = spark.createDataFrame([("0", 0, "x"), ("0", 1, "y"), ("1", 0, "z")], "prompt_hash string, id int, input string")
    batch = answers(spark, '{"results": [{"id": 1, "triplets": [["s", "o", "p"]]}, {"id": 5}]}', "broken")
    got = {(r["prompt_hash"], r["id"]): (r["sentence"], len(r["triplets"])) for r in triples.batch_extractions(sent, batch).collect()}
    assert got == {("0", 0): ("x", 0), ("0", 1): ("y", 1), ("1", 0): ("", 0)}


def test_patterns(spark):
    rows = spark.createDataFrame([("Bias and noise is part of data.",), ("Data is a thing.",), ("No predicate here",), (None,)], "sentence string")
    got = triples.by_patterns(rows, ["is", "is part of", "is a"]).collect()
    found = sorted((r["subject"], r["predicate"], r["object"]) for r in got if r["subject"])
    assert found == [("Bias", "is part of", "data"), ("Data", "is a", "thing"), ("noise", "is part of", "data")]
    assert sum(r["subject"] is None for r in got) == 2
    assert triples.unhandled(triples.by_patterns(rows, ["is"])).columns == ["sentence"]
    several = spark.createDataFrame([("A and B is part of C, D and E.",), ("x is . .",)], "sentence string")
    got = {(r["subject"], r["object"]) for r in triples.by_patterns(several, ["is part of", "is"]).collect()}
    assert got == {(a, b) for a in "AB" for b in "CDE"} | {("x", ". ")} or got == {(a, b) for a in "AB" for b in "CDE"} | {("x", ". .")}
    whole = {(r["subject"], r["object"]) for r in triples.by_patterns(several, ["is part of"], objects=False).collect()}
    assert ("A", "C, D and E") in whole
    many = [f"does {i} things with" for i in range(10_000)] + ["is part of"]
    wide = triples.by_patterns(several, many)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(wide) < 2 * size(triples.by_patterns(several, ["is part of"])) and wide.where("predicate = 'is part of'").count() == 6
    split = triples.training_split(spark.range(2000).select(F.col("id").cast("string").alias("sentence")), 0.8)
    assert 1500 < split.where("is_training").count() < 1700


def test_a_caller_and_decomposition(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id long, ord int, text string")
    sent = boundary.prompts(boundary.batched(rows, 2, ["doc_id"], ["ord"]), "decompose", ["doc_id"], "text")

    def call(payload: str) -> str:
        import json

        items = json.loads(payload)["items"]
        if items[0]["text"] == "c":
            raise RuntimeError("busy")
        return json.dumps({"results": [{"id": i["id"], "qualities": [i["text"].upper()]} for i in items]})

    said = boundary.answered(sent, call)
    got = boundary.decomposed(rows, said, 2, ["doc_id"], ["ord"], "text").orderBy("doc_id", "id").collect()
    assert [(r["doc_id"], r["id"], r["quality"]) for r in got] == [(1, 0, "A"), (1, 1, "B")]


def test_policies_for_failed_batches(spark):
    rows = spark.createDataFrame([(d, i, f"{d}{i}") for d in (1, 2) for i in range(5)] + [(3, 0, "30")], "doc_id long, ord int, text string")
    sent = boundary.prompts(boundary.batched(rows, 1, ["doc_id"], ["ord"]), "decompose", ["doc_id"], "text")
    text = F.get_json_object("payload_json", "$.items[0].text")
    raw = F.concat(F.lit('{"results": [{"id": 0, "qualities": ["'), text, F.lit('"]}]}'))
    said = sent.select("prompt_hash", F.when(~text.isin("12", "13", "30"), raw).alias("raw")).where("raw is not null or prompt_hash > 'a'")
    ask = lambda policy: {r["quality"] for r in boundary.decomposed(rows, said, 1, ["doc_id"], ["ord"], "text", on_error=policy).collect()}
    assert ask("empty") == {"10", "11", "14", "20", "21", "22", "23", "24"}
    assert ask("stop") == {"10", "11", "20", "21", "22", "23", "24"}
    assert boundary.failed_batches(sent, said, ["doc_id"]).count() == 3
    with pytest.raises(ValueError):
        ask("skip")
    alone = boundary.prompts(boundary.batched(rows, 1, ["doc_id"], ["ord"]), "decompose_text", ["doc_id"], "text")
    said = alone.where(text != "13").select("prompt_hash", F.concat(F.lit('{"qualities": ["'), text, F.lit('", " "]}')).alias("raw"))
    each = lambda policy: {r["quality"] for r in boundary.decomposed(rows, said, 9, ["doc_id"], ["ord"], "text", on_error=policy, mode="sentences").collect()}
    assert len(each("empty")) == 10 and len(each("stop")) == 9
    with pytest.raises(Exception, match="no answer"):
        each("fail")


def test_gate_by_meaning_reaches_every_kind(spark):
    rows = [(0, 0, "risk risk data"), (1, 0, "peril data"), (2, 0, "the of and"), (3, 0, ""), (4, 0, "near"), (5, 0, "far close low wide")]
    docs = spark.createDataFrame(rows, "doc_id long, ord int, body string")
    place = {"risk": [1.0, 0.0, 0.0], "near": [0.9, 0.43589, 0.0], "close": [0.8, 0.6, 0.0]}

    def encode(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for words in batch:
                v = [sum(x) for x in zip(*[place.get(w, [0.0, 0.0, 1.0]) for w in words])] or [0.0] * 3
                n = sum(x * x for x in v) ** 0.5 or 1
                out.append([x / n for x in v])
            yield pd.Series(out)

    got = {r["doc_id"]: r for r in gate.filter_by_meaning(docs, "risk", ["peril"], encoder=encode).collect()}
    assert [got[i]["match_type"] for i in range(6)] == ["exact", "synonym", None, None, "near_paragraph_global", "near_paragraph_keywords"]
    assert got[0]["score"] is None and round(got[4]["score"], 3) == 0.9 and round(got[5]["score"], 3) == 0.8 and not got[3]["is_matched"]


def test_bulk_upload_carries_what_failed(spark):
    rows = [(1, "s", "Bias is part of data. Nothing follows here at all."), (2, None, None), (3, "s", "short."), (4, "t", "Noise and bias are kinds of error.")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    empty = spark.createDataFrame([], "edge_ord long, src string, dst string, label string, source string, sentence string, created_at timestamp, last_updated_at timestamp")
    snapshot, rejects = bulk.upload(empty, docs, ["is part of", "are kinds of"], F.current_timestamp())
    assert {(r["src"], r["label"], r["dst"], r["source"]) for r in snapshot.collect()} == {("Bias", "is part of", "data", "s"), ("Noise", "are kinds of", "error", "t"), ("bias", "are kinds of", "error", "t")}
    assert sorted((r["doc_id"], r["stage"]) for r in rejects.collect()) == [(1, "extract"), (2, "decompose"), (3, "decompose")]
    assert bulk.upload(empty, docs.limit(0), ["is"], F.current_timestamp())[1].count() == 0


def test_classified(spark):
    sent = spark.createDataFrame([(0, "a", 0.5)], "id long, quality string, max_score double")
    kind = "id long, pos int, decision string, rationale string, novel_spans array<string>, matched_neighbor_sentence string, confidence string"
    got = novelty.classified(sent, spark.createDataFrame([(0, 0, "new", None, None, None, "1")], kind)).first()
    assert (got["decision"], got["confidence"], got["quality"]) == ("NEW", 1.0, "a")


def test_batches_of_a_group_in_many_ranges(spark):
    rows = [("hot", i) for i in range(5000)] + [(None, i) for i in range(7)] + [(f"d{j}", i) for j in range(40) for i in range(j % 5)]
    df = spark.createDataFrame(rows, "doc string, ord int").repartition(8)
    got = {(r["doc"], r["ord"]): (r["batch_id"], r["id"], r["running"]) for r in boundary.batched(df, 3, ["doc"], ["ord"]).collect()}
    assert got == {(d, i): (i // 3, i % 3, i) for d, i in rows}
    running = boundary.batched(df, 10, [], ["doc", "ord"]).orderBy("running").collect()
    assert [r["running"] for r in running] == list(range(len(rows)))
    assert [(r["doc"], r["ord"]) for r in running] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert boundary.batched(df.limit(0), 3, ["doc"], ["ord"]).count() == 0


def test_texts_that_are_prompts_alone_are_sent_for_their_place_and_their_answer_only(spark):
    rows = spark.range(3000).selectExpr("id % 40 AS doc", "id AS ord", "concat('text ', id % 2000) AS text")
    before = _records_shuffled(spark)
    sent = written(boundary.prompts(boundary.batched(rows, 1, ["doc"], ["ord"]), "decompose_text", ["doc"], "text", alone=True))
    said = sent.select("prompt_hash", F.to_json(F.struct(F.array(F.from_json("payload_json", "items array<struct<text:string>>")["items"][0]["text"]).alias("qualities"))).alias("raw"))
    got = boundary.decomposed(rows, said, 1, ["doc"], ["ord"], "text", on_error="stop", mode="sentences", sent=sent).collect()
    assert _records_shuffled(spark) - before < 3 * 3000  # it was 4.4 times, and longer rows
    assert sorted((r["doc"], r["batch_id"], r["quality"]) for r in got) == sorted((i % 40, i // 40, f"text {i % 2000}") for i in range(3000))
    some = said.where(F.col("raw") != '{"qualities":["text 1000"]}')  # its document ends there
    left = boundary.decomposed(rows, some, 1, ["doc"], ["ord"], "text", on_error="stop", mode="sentences", sent=sent).collect()
    assert {r["quality"] for r in got} - {r["quality"] for r in left} == {f"text {i}" for i in range(1000, 2000, 40)} and len(left) == 2950
