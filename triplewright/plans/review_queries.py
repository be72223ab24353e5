"""Queries over novelty, triples, review, merge, topics and metrics: S-53 to S-88."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bulk, merge, metrics, novelty, records, review, store, topics, triples, vectors
from ..sources import readers
from ..steps import checkpointed, shared_folder
from .base import kg_edges, paragraphs, qualities, query, table
from .base import vectors as sides
from .retrieval_queries import TOP

# ---- novelty


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query vector as a quality, its hits as neighbours; every other neighbour has no sentence."""
    asked, given = sides(spark, sf_dir)
    hits = vectors.top_k(asked, given, 5, others=True)
    sentence = F.when(F.col("item_id") % 20 == 0, F.lit(" ")).otherwise(F.concat(F.lit("edge "), F.col("item_id")))
    near = F.sort_array(F.collect_list(F.struct("rank", "score", sentence.alias("sentence"))))
    rows = hits.groupBy(F.col("query_id").alias("id")).agg(F.max("score").alias("max_score"), near.alias("neighbors"))
    return rows.withColumn("quality", F.concat(F.lit("edge "), (F.col("id") / 100).cast("long"), F.lit(" holds")))


@query(
    "s60_novelty_inputs",
    TOP
    + """
SELECT query_id AS id, coalesce(string_agg('edge ' || item_id, '|' ORDER BY rank) FILTER (item_id % 20 <> 0), '') AS neighbors
FROM top WHERE rank <= 3 GROUP BY query_id
""",
)
def s60(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = novelty.inputs(_neighbours(spark, sf_dir))
    return rows.select("id", F.array_join(F.transform("neighbors", lambda n: n["sentence"]), "|").alias("neighbors"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 4
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("quality"),
        (F.col("value") / 500).alias("max_score"),
        F.when(kind == 0, " existing").when(kind == 1, "NEW").when(kind == 2, "Partially_New ").otherwise(F.col("event_type")).alias("decision"),
        F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("event_type")).alias("rationale"),
        F.when(F.col("event_id") % 3 == 0, F.array("event_type", F.lit(" "))).otherwise(F.array()).cast("array<string>").alias("novel_spans"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(" ").alias("matched_neighbor_sentence"),
        F.when(F.col("event_id") % 7 == 0, "high").otherwise((F.col("value") / 400).cast("string")).alias("confidence"),
    )


VERDICT = """
WITH v AS (SELECT *, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN 'PARTIALLY_NEW' ELSE 'EXISTING' END
  WHEN 1 THEN 'NEW' ELSE 'PARTIALLY_NEW' END AS decision FROM events)
"""


@query(
    "s61_coerced_verdicts",
    VERDICT
    + """
SELECT event_id AS id, decision, CASE WHEN event_id % 5 = 0 THEN 'No rationale provided.' ELSE event_type END AS rationale,
  CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS spans, CASE WHEN event_id % 2 = 0 THEN event_type END AS matched_neighbor_sentence,
  event_id % 7 <> 0 AND value / 400 BETWEEN 0 AND 1 AS valid FROM v
""",
)
def s61(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = novelty.coerced(_verdicts(spark, sf_dir))
    return rows.select("id", "decision", "rationale", F.array_join("novel_spans", "|").alias("spans"), "matched_neighbor_sentence", "valid")


@query("s62_aligned_results", VERDICT + "SELECT event_id AS id, event_type AS quality, decision FROM v")
def s62(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = novelty.coerced(_verdicts(spark, sf_dir)).select("id", "decision")
    received = rows.withColumn("pos", F.lit(1)).union(rows.select("id", F.lit("replaced").alias("decision"), F.lit(0).alias("pos")))
    sent = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("quality"))
    return novelty.aligned(sent, received)


@query(
    "s63_rule_verdicts",
    TOP
    + r"""
, b AS (SELECT query_id AS id, max(score) AS high, 'edge ' || (query_id // 100) || ' holds' AS quality,
  arg_min('edge ' || item_id, rank) FILTER (rank <= 3 AND item_id % 20 <> 0) AS best FROM top WHERE rank <= 5 GROUP BY query_id),
w AS (SELECT *, list_filter(regexp_extract_all(lower(quality), '[\p{L}\p{N}_]+'),
  lambda x: NOT list_contains(regexp_extract_all(lower(coalesce(best, '')), '[\p{L}\p{N}_]+'), x)) AS spans FROM b)
SELECT id, CASE WHEN best IS NULL OR high < 0.45 THEN 'NEW' WHEN high >= 0.9 AND len(spans) = 0 THEN 'EXISTING' ELSE 'PARTIALLY_NEW' END AS decision,
  array_to_string(spans, '|') AS spans FROM w
""",
)
def s63(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.by_rules(novelty.inputs(_neighbours(spark, sf_dir))).select("id", "decision", F.array_join("novel_spans", "|").alias("spans"))


@query(
    "s64_decision_counts",
    VERDICT + "SELECT d AS decision, (SELECT count(*) FROM v WHERE decision = d) AS n FROM (SELECT unnest(['EXISTING', 'PARTIALLY_NEW', 'NEW']) AS d)",
)
def s64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.counts(novelty.coerced(_verdicts(spark, sf_dir)))


@query(
    "s65_rebuilt_results",
    VERDICT + "SELECT event_id AS id, event_type AS quality, CASE WHEN event_id % 2 = 0 THEN 0 ELSE round(value / 500, 6) END AS max_score, decision FROM v",
)
def s65(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _verdicts(spark, sf_dir).withColumn("max_score", F.when(F.col("id") % 2 != 0, F.col("max_score")))
    return novelty.rebuilt(rows).select("id", "quality", F.round("max_score", 6).alias("max_score"), "decision")


@query("s66_qualifying_results", VERDICT + "SELECT event_id AS id, decision FROM v WHERE decision IN ('PARTIALLY_NEW', 'NEW')")
def s66(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.qualifying(novelty.coerced(_verdicts(spark, sf_dir)), " nonsense,", enabled=True).select("id", "decision")


# ---- triples


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer per edge, with a triple of two parts beside the good one."""
    edges = kg_edges(spark, sf_dir)
    good = F.array(F.concat(F.lit(" "), F.col("src")), F.col("dst"), F.col("label"))
    return edges.select(
        "edge_ord",
        F.col("sentence").alias("input"),
        F.concat(F.lit("```json "), F.to_json(F.struct(F.array(good, F.array("src", "dst")).alias("triplets"))), F.lit("```")).alias("raw"),
    )


@query("s67_extractions", "SELECT edge_ord, sentence, trim(src) AS subject, dst AS object, label AS predicate FROM kg_edges")
def s67(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triples.extraction(_answers(spark, sf_dir))
    return rows.select("edge_ord", "sentence", F.explode("triplets").alias("t")).select("edge_ord", "sentence", "t.subject", "t.object", "t.predicate")


@query(
    "s67c_batch_extractions",
    "SELECT edge_ord, sentence, CASE WHEN edge_ord % 5 < 4 THEN src || '>' || dst ELSE '' END AS triple FROM kg_edges",
)
def s67c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of five edges by number; each answer leaves out the last."""
    edges = kg_edges(spark, sf_dir).withColumns(
        {"prompt_hash": F.sha2(F.floor(F.col("edge_ord") / 5).cast("string"), 256), "id": (F.col("edge_ord") % 5).cast("int")}
    )
    result = F.struct("id", F.array(F.array("src", "dst", "label")).alias("triplets"))
    answers = edges.groupBy("prompt_hash").agg(F.collect_list(F.when(F.col("id") < 4, result)).alias("results"))
    answers = answers.select("prompt_hash", F.to_json(F.struct("results")).alias("raw"))
    rows = triples.batch_extractions(edges.select("prompt_hash", "id", F.col("sentence").alias("input"), "edge_ord"), answers)
    said = F.transform("triplets", lambda t: F.concat(t["subject"], F.lit(">"), t["object"]))
    return rows.select("edge_ord", "sentence", F.array_join(said, "|").alias("triple"))


@query(
    "s67f_pattern_triples",
    r"""
SELECT edge_ord, src AS subject, replace(label, '_', ' ') AS predicate, dst AS object FROM kg_edges WHERE label <> 'is_located_in'
UNION ALL SELECT edge_ord, NULL, NULL, NULL FROM kg_edges WHERE label = 'is_located_in'
""",
)
def s67f(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.col("src"), F.lit(" "), F.replace("label", F.lit("_"), F.lit(" ")), F.lit(" "), F.col("dst"), F.lit("."))
    rows = kg_edges(spark, sf_dir).select("edge_ord", said.alias("sentence"))
    found = triples.by_patterns(rows, ["is", "is part of", "is kind of", "holds"][1:])
    return found.select("edge_ord", "subject", "predicate", "object")


@query("s67g_training_split", "SELECT edge_ord, left(md5(sentence), 4) < 'cccd' AS is_training FROM kg_edges")
def s67g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples.training_split(kg_edges(spark, sf_dir), 0.8).select("edge_ord", "is_training")


# ---- review

JUDGED = """
WITH j AS (SELECT q.doc_id * 1000000 + q.ord * 100 + q.pos AS ord, quality, round(1.0::DOUBLE / (1 + q.pos), 4) AS max_score,
  CASE WHEN l.quality IS NULL THEN 'EXISTING' WHEN toxic = 1 THEN 'PARTIALLY_NEW' ELSE 'NEW' END AS decision
  FROM (SELECT doc_id, ord, pos, quality FROM qualities) q LEFT JOIN (SELECT doc_id AS d, quality, toxic FROM labels) l ON q.doc_id = l.d)
"""
JUDGED = JUDGED.replace("SELECT q.doc_id", "SELECT q.doc_id").replace(", quality, round", ", q.quality, round")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumnRenamed("quality", "good")
    rows = qualities(spark, sf_dir).join(labels, "doc_id", "left")
    return rows.select(
        (F.col("doc_id") * 1000000 + F.col("ord") * 100 + F.col("pos")).alias("ord"),
        "quality",
        F.round(1.0 / (1 + F.col("pos")), 4).alias("max_score"),
        F.when(F.col("good").isNull(), "EXISTING").when(F.col("toxic") == 1, "PARTIALLY_NEW").otherwise("NEW").alias("decision"),
    )


@query(
    "s70_verdict_tables",
    JUDGED
    + """
SELECT ord, quality, max_score, decision FROM (
  SELECT *, row_number() OVER (PARTITION BY decision, lower(trim(quality)) ORDER BY ord) AS n FROM j) WHERE n = 1
""",
)
def s70(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.verdict_tables(_judged(spark, sf_dir)).select("ord", "quality", "max_score", "decision")


@query(
    "s71_best_per_sentence",
    JUDGED
    + """
SELECT ord, quality, max_score FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(trim(quality)) ORDER BY max_score DESC, ord) AS n FROM j) WHERE n = 1
""",
)
def s71(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.best_per_sentence(_judged(spark, sf_dir)).select("ord", "quality", "max_score")


@query("s72_page", "SELECT edge_ord, src FROM kg_edges ORDER BY edge_ord LIMIT 10 OFFSET 20")
def s72(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.page(kg_edges(spark, sf_dir).select("edge_ord", "src"), 3, ["edge_ord"])


def _extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triples an edge, one of them without an object."""
    whole = F.struct(F.col("src").alias("subject"), F.col("dst").alias("object"), F.col("label").alias("predicate"))
    part = F.struct(F.col("src").alias("subject"), F.lit(" ").alias("object"), F.col("label").alias("predicate"))
    return kg_edges(spark, sf_dir).select(F.col("edge_ord").alias("ord"), "sentence", F.array(whole, part, whole).alias("triplets"))


@query(
    "s73_review_rows",
    """
SELECT edge_ord AS ord, p AS pos, sentence, src AS subject, label AS predicate, dst AS object, false AS deleted
FROM kg_edges, (SELECT unnest([0, 2])::INTEGER AS p)
""",
)
def s73(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_rows(_extractions(spark, sf_dir))


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg_edges(spark, sf_dir).select(
        F.col("edge_ord").alias("ord"),
        F.col("dst").alias("sentence"),
        F.col("src").alias("subject"),
        F.when(F.col("edge_ord") % 11 == 0, " ").otherwise(F.col("label")).alias("predicate"),
        F.col("dst").alias("object"),
        (F.col("edge_ord") % 7 == 0).alias("deleted"),
    )


@query(
    "s74_review_counters",
    "SELECT count(*) FILTER (edge_ord % 7 <> 0 AND edge_ord % 11 <> 0) AS valid, count(*) FILTER (edge_ord % 7 = 0) AS deleted FROM kg_edges",
)
def s74(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.counters(_reviewed(spark, sf_dir))


PAYLOAD = """
WITH a AS (SELECT dst AS sentence, src, label, dst, min(edge_ord) AS ord FROM kg_edges
  WHERE edge_ord % 7 <> 0 AND edge_ord % 11 <> 0 GROUP BY ALL)
SELECT sentence, min(ord) AS first, sha256(string_agg(trim(src) || '>' || label || '>' || dst, '|' ORDER BY ord)) AS triples FROM a GROUP BY sentence
"""


def _told(rows: DataFrame) -> DataFrame:
    said = F.transform("triplets", lambda t: F.concat_ws(">", t["subject"], t["predicate"], t["object"]))
    return rows.withColumn("triples", F.sha2(F.array_join(said, "|"), 256)).drop("triplets")


@query("s75_upsert_payload", PAYLOAD)
def s75(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(review.upsert_payload(_reviewed(spark, sf_dir)))


@query("s76_checked_payload", PAYLOAD)
def s76(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(review.checked_payload(review.upsert_payload(_reviewed(spark, sf_dir))))


@query("s77_checked_qualities", "SELECT trim(quality) AS quality FROM qualities")
def s77(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.checked_qualities(qualities(spark, sf_dir))


def _edges_with_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kg_edges(spark, sf_dir).withColumn("original_sentence", F.concat(F.lit(" from "), F.col("source")))
    return rows.withColumn("sentence", F.when(F.col("edge_ord") % 3 == 0, F.lit("")).otherwise(F.col("sentence")))


@query(
    "s79_sentence_records",
    "SELECT edge_ord, CASE WHEN edge_ord % 3 = 0 THEN 'from ' || source ELSE sentence END AS sentence, source, label AS relation FROM kg_edges",
)
def s79(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.sentence_records(_edges_with_origin(spark, sf_dir))


@query(
    "s79_numbered_sentences",
    """
WITH f AS (SELECT CASE WHEN edge_ord % 3 = 0 THEN 'from ' || source ELSE sentence END AS sentence, min(edge_ord) AS first FROM kg_edges GROUP BY 1)
SELECT row_number() OVER (ORDER BY first) || '. ' || sentence AS line FROM f
""",
)
def s79n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.numbered(review.sentence_records(_edges_with_origin(spark, sf_dir)))


@query(
    "s80_grouped_export",
    JUDGED
    + """
, b AS (SELECT *, row_number() OVER (PARTITION BY decision, lower(trim(quality)) ORDER BY max_score DESC, ord) AS n FROM j)
SELECT CASE decision WHEN 'NEW' THEN 1 WHEN 'PARTIALLY_NEW' THEN 2 ELSE 3 END AS place, replace(decision, '_', ' ') AS "Group",
  trim(quality) AS "Sentence", round(max_score, 2) AS "Similarity" FROM b WHERE n = 1
""",
)
def s80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.grouped_export(_judged(spark, sf_dir))


@query("s81_candidate_sentences", "SELECT DISTINCT quality AS sentence FROM qualities")
def s81(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualities(spark, sf_dir).select(F.col("quality").alias("sentence")).distinct()


KEPT = """
WITH a AS (SELECT dst AS sentence, trim(src) AS subject, label AS predicate, dst AS object, min(edge_ord) AS ord FROM kg_edges
  WHERE edge_ord % 7 <> 0 AND edge_ord % 11 <> 0 GROUP BY ALL)
"""


@query(
    "s81_exported_triples",
    KEPT
    + """
SELECT 'Places and Kinds' AS keyword, min(ord) OVER (PARTITION BY sentence) AS first, sentence,
  (row_number() OVER (PARTITION BY sentence ORDER BY ord) - 1)::INTEGER AS pos, subject, predicate, object FROM a
""",
)
def s81t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.triple_export(review.upsert_payload(_reviewed(spark, sf_dir)), "Places and Kinds")


@query(
    "s81_exported_sentences",
    KEPT + "SELECT row_number() OVER (ORDER BY min(ord), sentence) || '. ' || sentence AS line FROM a GROUP BY sentence",
)
def s81s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.numbered(review.payload_sentences(review.upsert_payload(_reviewed(spark, sf_dir))))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("edge_key"), F.when(good, "Accept").otherwise("reject").alias("decision"))


@query(
    "s82_review_decisions",
    """
SELECT d.doc_id AS edge_key, CASE WHEN l.doc_id IS NULL THEN 'undecided' WHEN quality = 1 AND toxic = 0 THEN 'accept' ELSE 'reject' END AS status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
)
def s82(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("edge_key"))
    return review.decided(docs, _decisions(spark, sf_dir))


@query(
    "s82_decision_counts",
    """
SELECT CASE WHEN l.doc_id IS NULL THEN 'undecided' WHEN quality = 1 AND toxic = 0 THEN 'accept' ELSE 'reject' END AS status, count(*) AS n
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL
""",
)
def s82c(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("edge_key"))
    return review.decision_counts(review.decided(docs, _decisions(spark, sf_dir)))


# ---- merge


def _graph_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All edges as the graph; what comes in has all of them again with other sentences, and each the other way round."""
    old, new = F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.lit(None).cast("timestamp")
    edges = kg_edges(spark, sf_dir)
    current = review.first_of(edges, ["src", "dst", "label", "source"], ["edge_ord"])
    current = current.withColumns({"created_at": old, "last_updated_at": old})
    back = edges.withColumns({"src": F.col("dst"), "dst": F.col("src"), "label": F.lit("holds")})
    incoming = edges.union(back.select(*edges.columns)).withColumn("sentence", F.concat(F.lit("again "), F.col("sentence")))
    return current, incoming.withColumns({"created_at": new, "last_updated_at": new})


MERGED = """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY src, dst, label, source ORDER BY edge_ord) AS n FROM kg_edges),
b AS (SELECT edge_ord, src, dst, label, source, sentence FROM kg_edges UNION ALL SELECT edge_ord, dst, src, 'holds', source, sentence FROM kg_edges),
i AS (SELECT *, row_number() OVER (PARTITION BY src, dst, label, source ORDER BY edge_ord) AS n FROM b)
SELECT coalesce(c.edge_ord, i.edge_ord) AS edge_ord, coalesce(c.src, i.src) AS src, coalesce(c.dst, i.dst) AS dst, coalesce(c.label, i.label) AS label,
  coalesce(c.source, i.source) AS source, coalesce(c.sentence, 'again ' || i.sentence) AS sentence,
  CASE WHEN c.src IS NOT NULL THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-06-01 00:00:00' END AS created_at,
  CASE WHEN i.src IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_updated_at
FROM (SELECT * FROM c WHERE n = 1) c FULL JOIN (SELECT * FROM i WHERE n = 1) i
  ON c.src = i.src AND c.dst = i.dst AND c.label = i.label AND c.source = i.source
"""


@query("s53_merged_edges", MERGED)
def s53(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, incoming = _graph_and_batch(spark, sf_dir)
    rows = merge.merge_edges(current, incoming, F.to_timestamp(F.lit("2024-06-01 00:00:00")))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_updated_at")})


@query("s53_bucketed_edges", MERGED)
def s53b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the bucketed table: the graph is a version, what comes in another."""
    current, incoming = _graph_and_batch(spark, sf_dir)
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for version, rows, day in (("graph", current, "2024-01-01"), ("batch", incoming, "2024-06-01")):
        store.upsert(rows, base, version, F.to_timestamp(F.lit(f"{day} 00:00:00")))
    return store.read(spark, base).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_updated_at")})


@query(
    "s53_merged_nodes",
    """
SELECT label, CASE WHEN bool_or(old) THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-06-01 00:00:00' END AS created_at,
  CASE WHEN bool_or(new) THEN TIMESTAMP '2024-06-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_updated_at FROM (
  SELECT src AS label, true AS old, true AS new FROM kg_edges UNION ALL SELECT dst, false, true FROM kg_edges)
GROUP BY label
""",
)
def s53n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph holds the sources of edges; their targets come in."""
    current, incoming = _graph_and_batch(spark, sf_dir)
    old = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    nodes = current.select(F.col("src").alias("label")).distinct().withColumns({"created_at": old, "last_updated_at": old})
    rows = merge.merge_nodes(nodes, incoming, F.to_timestamp(F.lit("2024-06-01 00:00:00")))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_updated_at")})


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("edge_ord") % 9 == 0, F.lit(None).cast("string")).otherwise(F.col("label"))
    return kg_edges(spark, sf_dir).withColumn("label", bad)


@query(
    "s54_batch_summary",
    "SELECT count(*) AS attempted, count(*) FILTER (edge_ord % 9 <> 0) AS succeeded, count(*) FILTER (edge_ord % 9 = 0) AS failed FROM kg_edges",
)
def s54(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.batch_summary(merge.validated(_batch(spark, sf_dir)))


@query("s54_batch_errors", "SELECT edge_ord, src || ' -  -> ' || dst || ': label is empty' AS error FROM kg_edges WHERE edge_ord % 9 = 0")
def s54e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.validated(_batch(spark, sf_dir)).where("error is not null").select("edge_ord", "error")


@query(
    "s55_upserted_extractions",
    "SELECT DISTINCT lower(src) AS src, lower(label) AS label, lower(dst) AS dst FROM kg_edges",
)
def s55(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _extractions(spark, sf_dir).withColumn("triplets", F.slice("triplets", 1, 1))
    new = records.relations(found.withColumnRenamed("ord", "edge_ord")).withColumns(
        {"source": F.lit(None).cast("string"), "created_at": F.lit(None).cast("timestamp"), "last_updated_at": F.lit(None).cast("timestamp")}
    )
    snapshot, _, _ = merge.upsert_batch(new.limit(0), new, F.current_timestamp())
    return snapshot.select("src", "label", "dst")


def _uploaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A document for each edge: a sentence before the edge's own in every seventh, no text in every ninth; into an empty graph."""
    said = F.concat(F.col("src"), F.lit(" "), F.replace("label", F.lit("_"), F.lit(" ")), F.lit(" "), F.col("dst"), F.lit("."))
    body = F.when(F.col("edge_ord") % 9 == 0, F.lit(None).cast("string")).when(F.col("edge_ord") % 7 == 0, F.concat(F.lit("Nothing is said about it here. "), said)).otherwise(said)
    docs = kg_edges(spark, sf_dir).select(F.col("edge_ord").alias("doc_id"), F.lit(None).cast("string").alias("source"), body.alias("text"))
    empty = spark.createDataFrame([], "edge_ord long, src string, dst string, label string, source string, sentence string, created_at timestamp, last_updated_at timestamp")
    return bulk.upload(empty, docs, ["is part of", "is kind of", "is located in"], F.to_timestamp(F.lit("2024-06-01 00:00:00")))


@query("s56_bulk_upload", "SELECT DISTINCT src, replace(label, '_', ' ') AS label, dst FROM kg_edges WHERE edge_ord % 9 <> 0")
def s56(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uploaded(spark, sf_dir)[0].select("src", "label", "dst")


@query(
    "s56_bulk_rejects",
    """
SELECT edge_ord AS doc_id, 'decompose' AS stage, NULL AS sentence, 'the text has no sentence' AS error FROM kg_edges WHERE edge_ord % 9 = 0
UNION ALL SELECT edge_ord, 'extract', 'Nothing is said about it here.', 'no predicate is in the sentence' FROM kg_edges WHERE edge_ord % 7 = 0 AND edge_ord % 9 <> 0
""",
)
def s56r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uploaded(spark, sf_dir)[1]


# ---- timings, topics, feedback, counts


@query(
    "s83_timing_summary",
    "SELECT event_type AS name, max_by(value, ts) AS elapsed_seconds FROM events GROUP BY event_type",
)
def s83(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.timing_summary(_timings(spark, sf_dir))


def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("elapsed_seconds"), F.col("ts").alias("finished_at"))


@query(
    "s83_total_seconds",
    "SELECT round(sum(v), 6) AS total_seconds FROM (SELECT max_by(value, ts) AS v FROM events GROUP BY event_type)",
)
def s83t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.total_seconds(_timings(spark, sf_dir)).select(F.round("total_seconds", 6).alias("total_seconds"))


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).select(F.concat_ws(":", "doc_id", "ord").alias("id"), F.col("body").alias("text"))
    return checkpointed(topics.clustered(rows))


@query("s84_topics")
def s84(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_words(_topics(spark, sf_dir))


@query("s85_matched_topics")
def s85(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _topics(spark, sf_dir)
    return topics.matched_paragraphs(topics.matched(topics.topic_words(rows), rows, "und", ["les", "die"]), rows)


@query("s86_topic_report")
def s86(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _topics(spark, sf_dir)
    return topics.topic_info(rows, topics.topic_words(rows))


@query("s86_document_info")
def s86d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _topics(spark, sf_dir)
    return topics.document_info(rows, topics.topic_words(rows))


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("text").alias("exact_text"), F.col("role").alias("username"), (F.col("conv_id") % 2 == 0).alias("old"))
    return rows.withColumn("decomposition", F.lit("none"))


@query(
    "s87_feedback_insert",
    "SELECT username, count(*) AS n FROM (SELECT DISTINCT text, role AS username FROM conversations) GROUP BY ALL",
)
def s87(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feedback(spark, sf_dir)
    current = rows.where("old").drop("old").dropDuplicates(["exact_text", "username"]).withColumn("id", F.lit("old"))
    return review.feedback_inserted(current, rows.drop("old")).groupBy("username").agg(F.count("*").alias("n"))


@query(
    "s87_feedback_update",
    "SELECT role AS username, count(*) FILTER (conv_id % 2 = 0) AS changed, count(*) AS n FROM conversations GROUP BY ALL",
)
def s87u(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("/", "conv_id", "turn").alias("id")
    rows = table(spark, sf_dir, "conversations").select(key, F.col("role").alias("username"), F.lit("none").alias("decomposition"), "conv_id")
    changes = rows.where("conv_id % 2 = 0").select("id", "username", F.lit("accept").alias("decomposition"))
    out = review.feedback_updated(rows, changes, ["decomposition"])
    return out.groupBy("username").agg(F.count_if(F.col("decomposition") == "accept").alias("changed"), F.count("*").alias("n"))


@query(
    "s88_stage_counts",
    TOP
    + """
, m AS (SELECT query_id, max(score) >= 0.25 AS kept FROM top WHERE rank <= 5 GROUP BY query_id)
SELECT count(*) FILTER (kept) AS num_kept, count(*) FILTER (NOT kept) AS num_dropped FROM m
""",
)
def s88(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, given = sides(spark, sf_dir)
    rows = vectors.filter_by_similarity(asked.select("id"), vectors.top_k(asked, given, 5, others=True), 5, 0.25)
    return metrics.stage_counts(rows, "kept", "num_kept", "num_dropped")


@query("s57_log_sink", "SELECT doc_id, n_chars, lang AS run_id, 'chunks' AS stage FROM documents")
def s57(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of every document, written as a stage's sink does, a run a language, and read again."""
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    for lang in [r["lang"] for r in docs.select("lang").distinct().collect()]:  # a few names
        merge.write_log(docs.where(F.col("lang").eqNullSafe(lang)).drop("lang"), base, "chunks", lang)
    return spark.read.schema("doc_id long, n_chars long, stage string, run_id string").json(base)


@query("s11_feedback_source", "SELECT conv_id || '/' || turn AS id, role AS username FROM conversations")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback rows as CSV with a header, read by the source."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.lit(None).cast("timestamp").alias("ts"), F.col("role").alias("username"))
    rest = readers.empty_feedback(spark).columns[3:]
    rows.withColumns({c: F.lit(None).cast("string") for c in rest}).write.csv(path, header=True)
    return readers.read_feedback(spark, path).select("id", "username")
