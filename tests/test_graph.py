from __future__ import annotations

import pytest
from triplewright.operators import graph, records

EDGES = "edge_ord long, src string, dst string, label string, source string, sentence string"


def edges(spark):
    return spark.createDataFrame(
        [
            (1, "Bias", "Risk", "is_a", "s1", "Bias is a Risk"),
            (2, "Data", "Bias", "has", "s1", None),
            (3, "Bias", "Risk", "is_a", "s2", "Bias is a Risk"),
            (4, "Fairness", "Value", "is_a", "bias report", "x"),
            (5, "100%", "a_b", "is_a", None, None),
            (6, "Noise", "Risk", "is_a", "s1", "n"),
        ],
        EDGES,
    )


def test_retrieve_first_wins_and_patterns(spark):
    rows = {r["edge_ord"]: r["match_pattern"] for r in graph.retrieve(edges(spark), " BIAS ").collect()}
    assert rows == {1: "source_label", 2: "target_label", 4: "rel_props"}
    assert [r["edge_ord"] for r in graph.retrieve(edges(spark), "bias", 1).orderBy("edge_ord").collect()] == [1, 2, 4]
    assert graph.retrieve(edges(spark), "%").count() == 1 and graph.retrieve(edges(spark), "_").count() == 4
    assert graph.retrieve(edges(spark), "nothing").count() == 0
    assert graph.retrieve(edges(spark).limit(0), "bias").count() == 0


def test_walks(spark):
    e = edges(spark)
    assert {r["other"] for r in graph.neighbourhood(e, "Bias").collect()} == {"Risk", "Data"}
    start = spark.createDataFrame([("Data",)], "node string")
    reach = {r["node"]: r["steps"] for r in graph.reachable(e, start).collect()}
    assert reach == {"Data": 0, "Bias": 1, "Risk": 2, "Noise": 3}
    assert [r[0] for r in graph.siblings(e, "Bias", "is_a", "Data").collect()] == ["Noise"]
    assert graph.siblings(e, "Bias", "is_a", "Value").count() == 0
    assert [r[0] for r in graph.sentences_into(e, "Risk").orderBy("sentence").collect()] == ["Bias is a Risk", "n"]
    assert graph.node_count(e).first()[0] == 8
    assert graph.one_hop(e, "is_a", "Risk").count() == 2


def test_payload_order(spark):
    e = edges(spark)
    nodes = [r["label"] for r in graph.payload_nodes(e).orderBy("first").collect()]
    assert nodes[:4] == ["Bias", "Risk", "Data", "Fairness"] and len(set(nodes)) == len(nodes)
    ids = [r["id"] for r in graph.payload_edges(e).collect()]
    assert sorted(ids) == [f"e{i}" for i in range(6)]


def test_relations_and_metadata(spark):
    t = "array<struct<subject:string,object:string,predicate:string>>"
    rows = spark.createDataFrame([(1, "s", [(" Data  Bias", "RISK", "Is a")])], f"doc_id long, sentence string, triplets {t}")
    docs = spark.createDataFrame([(1, {"sentence": "meta", "source": "f"})], "doc_id long, meta map<string,string>")
    got = records.document_relations(rows, docs).first()
    assert (got["src"], got["label"], got["dst"]) == ("data bias", "is a", "risk")
    assert got["extra"] == {"sentence": "meta", "original_sentence": "s", "source": "f"}
    asked = spark.createDataFrame([("Bias",), ("bias",)], "keyword string")
    names = spark.createDataFrame([("bias",)], "keyword string")
    assert {r["keyword"]: r["allowed"] for r in records.allowed(asked, names).collect()} == {"Bias": False, "bias": True}


def test_distance_meets_in_the_middle(spark, monkeypatch):
    chain = [(i, f"n{i}", f"n{i + 1}") for i in range(30)] + [(100 + i, "hub", f"leaf{i}") for i in range(200)] + [(300, "n29", "hub")]
    rows = spark.createDataFrame(chain, "edge_ord long, src string, dst string").selectExpr("*", "'to' AS label")
    steps = []
    real = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: steps.append(1) or real(df))
    assert graph.distance(rows, "n10", "n16") == 6 and len(steps) == 7  # the edges, then a front each
    monkeypatch.undo()
    assert graph.distance(rows, "leaf3", "leaf5") == 2 and graph.distance(rows, "leaf3", "n28") == 3
    assert graph.distance(rows, "n1", "n1") == 0 and graph.distance(rows, "n1", "nowhere") is None
    with pytest.raises(RuntimeError):
        graph.distance(rows, "n0", "n9", most_steps=4)
