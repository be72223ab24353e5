"""Queries at the model boundary and the keyword gate: S-39 to S-49."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boundary, gate
from ..steps import written
from .base import paragraphs, qualities, query, table

BATCHES = """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, pos) - 1 AS nr FROM qualities),
b AS (SELECT *, CAST(floor(nr / 5.0) AS BIGINT) AS batch_id FROM a)
"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.batched(qualities(spark, sf_dir), 5, ["doc_id"], ["ord", "pos"])


@query(
    "s39_batches",
    BATCHES + "SELECT doc_id, batch_id, count(*) AS n, max(nr % 5)::BIGINT AS last_id FROM b GROUP BY ALL",
)
def s39(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).groupBy("doc_id", "batch_id").agg(F.count("*").alias("n"), F.max("id").cast("long").alias("last_id"))


@query(
    "s40_prompts",
    BATCHES
    + """
, p AS (SELECT doc_id, batch_id, count(*)::INTEGER AS n,
  to_json(struct_pack(items := list(struct_pack(id := nr, "text" := quality) ORDER BY nr)))::VARCHAR AS payload_json FROM b GROUP BY ALL)
SELECT 'novelty' AS stage, doc_id, batch_id, n, sha256('novelty' || chr(10) || payload_json) AS prompt_hash, payload_json FROM p
""",
)
def s40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.prompts(_batches(spark, sf_dir), "novelty", ["doc_id"], "quality", "running")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' JSON as a model would wrap it: bare, in a fence, or among words."""
    raw = (
        F.when(F.col("event_id") % 3 == 0, F.col("props"))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
        .otherwise(F.concat(F.lit("Sure: "), F.col("props"), F.lit(" that is } all")))
    )
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


@query("s41_parsed_objects", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def s41(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boundary.parsed(_answers(spark, sf_dir))
    return rows.select("event_id", F.get_json_object("value", "$.k").cast("int").alias("k"))


@query("s42_parsed_arrays", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def s42(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boundary.parsed(_answers(spark, sf_dir), array=True)
    return rows.select("event_id", F.get_json_object("value", "$[0].k").cast("int").alias("k"))


LINES = r"""
list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x, E' \t\n\x0b\f\r'), '^[-•\s]+', '')), lambda x: x <> '')
"""


@query(
    "s43_qualities_or_lines",
    f"SELECT conv_id, turn, unnest({LINES}) AS quality, (generate_subscripts({LINES}, 1) - 1)::INTEGER AS pos FROM conversations WHERE role = 'assistant'",
)
def s43(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("raw"))
    rows = boundary.qualities_or_lines(answers)
    return rows.select("conv_id", "turn", F.posexplode("qualities").alias("pos", "quality"))


@query("s43_coerced_qualities", f"SELECT conv_id, turn, unnest({LINES}) AS quality FROM conversations WHERE role = 'assistant'")
def s43c(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    lines = F.split("text", "\n", -1)
    bare = F.transform(lines, lambda x: F.regexp_replace(F.btrim(x, F.lit(" \t\n\x0b\f\r")), r"^[-•\s]+", ""))
    raw = F.concat(F.lit("Here it is.\n```json\n"), F.to_json(F.struct(bare.alias("qualities"))), F.lit("\n```"))
    rows = boundary.parsed(answers.select("conv_id", "turn", raw.alias("raw")))
    return rows.select("conv_id", "turn", F.explode(boundary.qualities_of(F.col("value"))).alias("quality"))


def _answers_to(sent: DataFrame) -> DataFrame:
    """An answer per prompt that leaves out its last item, repeats ids and adds one outside."""
    items = F.from_json("payload_json", "items array<struct<id:int,text:string>>")["items"]
    result = F.transform(
        F.filter(items, lambda x: x["id"] < 4),
        lambda x: F.struct(x["id"].cast("string").alias("id"), F.array(F.lit(" "), x["text"]).alias("qualities")),
    )
    more = F.array(F.struct(F.lit("99").alias("id"), F.array(F.lit("outside")).alias("qualities")))
    early = F.array(F.struct(F.lit("0").alias("id"), F.array(F.lit("replaced later")).alias("qualities")))
    answers = sent.select("prompt_hash", F.to_json(F.struct(F.concat(early, result, more).alias("results"))).alias("raw"))
    return answers.dropDuplicates(["prompt_hash"])


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of all batches, written, since what was sent and its answers are both read from them."""
    return written(boundary.prompts(_batches(spark, sf_dir), "decompose", ["doc_id"], "quality"))


def _batch_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What was sent, and the answers."""
    sent = _sent(spark, sf_dir)
    items = F.from_json("payload_json", "items array<struct<id:int,text:string>>")["items"]
    asked = sent.select("doc_id", "batch_id", "prompt_hash", F.explode(items).alias("i")).select("doc_id", "batch_id", "prompt_hash", F.col("i.id").alias("id"))
    return asked, _answers_to(sent)


@query(
    "s44_batch_qualities",
    BATCHES + "SELECT doc_id, batch_id, (nr % 5)::INTEGER AS id, CASE WHEN nr % 5 < 4 THEN trim(quality) ELSE '' END AS quality FROM b",
)
def s44(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boundary.batch_qualities(*_batch_answers(spark, sf_dir))
    return rows.select("doc_id", "batch_id", "id", F.array_join("qualities", "|").alias("quality"))


#: A batch fails here if the length of its first text says so.
FAILED = BATCHES + ", f AS (SELECT doc_id, batch_id FROM b WHERE nr % 5 = 0 AND length(quality) % 7 = 3) "
ITEMS = "SELECT doc_id, batch_id, (nr % 5)::INTEGER AS id, 0 AS pos, trim(quality) AS quality FROM b"


def _decomposed(spark: SparkSession, sf_dir: str, on_error: str) -> DataFrame:
    sent = _sent(spark, sf_dir)
    items = F.from_json("payload_json", "items array<struct<id:int,text:string>>")["items"]
    # equal prompts have equal first texts, so a failed one is left out before it is answered
    answers = _answers_to(sent.where(~F.coalesce(F.length(items[0]["text"]) % 7 == 3, F.lit(False))))
    return boundary.decomposed(qualities(spark, sf_dir), answers, 5, ["doc_id"], ["ord", "pos"], "quality", on_error=on_error, sent=sent)


@query(
    "s45_decomposed",
    FAILED + ", e AS (SELECT doc_id, min(batch_id) AS stop FROM f GROUP BY doc_id) " + ITEMS + " LEFT JOIN e USING (doc_id) WHERE nr % 5 < 4 AND (stop IS NULL OR batch_id < stop)",
)
def s45(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches one after the other: nothing counts from the first failed one on."""
    return _decomposed(spark, sf_dir, "stop")


@query("s45_decomposed_apart", FAILED + ITEMS + " ANTI JOIN f USING (doc_id, batch_id) WHERE nr % 5 < 4")
def s45p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches side by side: only failed ones are empty."""
    return _decomposed(spark, sf_dir, "empty")


@query(
    "s45_decomposed_sentences",
    BATCHES + "SELECT doc_id, nr AS batch_id, 0 AS id, 0 AS pos, trim(quality) AS quality FROM b",
)
def s45s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt a text."""
    rows, by, order = qualities(spark, sf_dir), ["doc_id"], ["ord", "pos"]
    sent = written(boundary.prompts(boundary.batched(rows, 1, by, order), "decompose_text", by, "quality", alone=True))
    text = F.from_json("payload_json", "items array<struct<id:int,text:string>>")["items"][0]["text"]
    answers = sent.select("prompt_hash", F.to_json(F.struct(F.array(text, F.lit(" ")).alias("qualities"))).alias("raw"))  # equal ones for equal prompts
    return boundary.decomposed(rows, answers, 1, by, order, "quality", on_error="stop", mode="sentences", sent=sent)


@query(
    "s46_offline_qualities", "SELECT doc_id, ord::INTEGER AS ord, pos::INTEGER AS pos, quality FROM qualities"
)
def s46(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualities(spark, sf_dir)


@query(
    "s46b_synonyms",
    """
WITH t AS (SELECT r_name AS keyword, list(n_name ORDER BY n_name) AS k FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT keyword, (generate_subscripts(k[1:3], 1) - 1)::INTEGER AS ord, lower(unnest(k[1:3])) AS synonym FROM t
""",
)
def s46b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = F.to_json(F.struct(F.sort_array(F.collect_list("n_name")).alias("synonyms")))
    return boundary.synonyms(rows.groupBy(F.col("r_name").alias("keyword")).agg(raw.alias("raw")), most=3)


STOPS = ", ".join(f"'{w}'" for w in gate.STOP_WORDS)
KEYWORDS = rf"""
WITH w AS (SELECT doc_id, ord, unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]+')) AS term FROM paragraphs),
t AS (SELECT doc_id, ord, term, count(*) AS tf FROM w WHERE length(term) >= 2 AND term NOT IN ({STOPS}) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM paragraphs),
s AS (SELECT doc_id, ord, term, row_number() OVER (PARTITION BY doc_id, ord ORDER BY tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) DESC, term) AS rank
  FROM t JOIN d USING (term), n)
"""


@query("s47_keywords", KEYWORDS + "SELECT doc_id, ord::INTEGER AS ord, rank::INTEGER AS rank, term FROM s WHERE rank <= 8")
def s47(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.keywords(paragraphs(spark, sf_dir), 8)


CASCADE = """
, k AS (SELECT doc_id, ord, list(term ORDER BY rank) AS keywords FROM s WHERE rank <= 8 GROUP BY ALL),
c AS (SELECT p.doc_id, p.ord::INTEGER AS ord, coalesce(keywords, []) AS keywords FROM paragraphs p LEFT JOIN k USING (doc_id, ord)),
m AS (SELECT doc_id, ord, CASE WHEN list_contains(keywords, 'und') THEN 'exact'
  WHEN list_has_any(keywords, ['die', 'les', 'que']) THEN 'synonym' END AS match_type FROM c)
"""


@query("s48_match_cascade", KEYWORDS + CASCADE + "SELECT match_type, count(*) AS n FROM m GROUP BY ALL")
def s48(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate.filter_paragraphs(paragraphs(spark, sf_dir), "und", ["die", "les", "que"])
    return rows.groupBy("match_type").agg(F.count("*").alias("n"))


@query(
    "s49_keyword_gate",
    KEYWORDS + CASCADE + "SELECT doc_id, ord, match_type, match_type IS NOT NULL AS is_matched FROM m",
)
def s49(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate.filter_paragraphs(paragraphs(spark, sf_dir), "und", ["die", "les", "que"])
    return rows.select("doc_id", "ord", "match_type", "is_matched")


#: The hashed encoder in SQL: a word's place and sign by its MD5; a keyword of one word is one of them.
MEANING = (
    KEYWORDS
    + r"""
, k AS (SELECT doc_id, ord, list(term ORDER BY rank) AS keywords FROM s WHERE rank <= 8 GROUP BY ALL),
c AS (SELECT p.doc_id, p.ord::INTEGER AS ord, coalesce(keywords, []) AS keywords FROM paragraphs p LEFT JOIN k USING (doc_id, ord)),
words AS (SELECT doc_id, ord::INTEGER AS ord, unnest(regexp_extract_all(lower(body), '[\p{L}\p{N}_]+')) AS word FROM paragraphs),
h AS (SELECT word, ('0x' || md5(word)[1:8])::BIGINT % 64 AS place, CASE WHEN ('0x' || md5(word)[9:10])::BIGINT % 2 = 1 THEN 1 ELSE -1 END AS sign
  FROM (SELECT word FROM words UNION SELECT 'und')),
q AS (SELECT place, sign FROM h WHERE word = 'und'),
v AS (SELECT doc_id, ord, place, sum(sign) AS x FROM words JOIN h USING (word) GROUP BY ALL),
g AS (SELECT doc_id, ord, coalesce(sum(x * q.sign) FILTER (v.place = q.place), 0) / sqrt(nullif(sum(x * x), 0)) AS sim FROM v, q GROUP BY ALL),
e AS (SELECT doc_id, ord, max(CASE WHEN h.place = q.place THEN h.sign * q.sign ELSE 0 END) AS best
  FROM (SELECT doc_id, ord, unnest(keywords) AS word FROM c) JOIN h USING (word), q GROUP BY ALL),
m AS (SELECT doc_id, ord, CASE WHEN list_contains(keywords, 'und') THEN 'exact' WHEN list_has_any(keywords, ['die', 'les', 'que']) THEN 'synonym'
  WHEN coalesce(sim, 0) >= 0.45 THEN 'near_paragraph_global' WHEN best >= 0.65 THEN 'near_paragraph_keywords' END AS match_type, coalesce(sim, 0) AS sim, best
  FROM c LEFT JOIN g USING (doc_id, ord) LEFT JOIN e USING (doc_id, ord))
SELECT doc_id, ord, match_type, match_type IS NOT NULL AS is_matched,
  CASE match_type WHEN 'near_paragraph_global' THEN round(sim, 4) WHEN 'near_paragraph_keywords' THEN round(best, 4) END AS score FROM m
"""
)


@query("s49_gate_by_meaning", MEANING)
def s49m(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate.filter_by_meaning(paragraphs(spark, sf_dir), "und", ["die", "les", "que"])
    return rows.select("doc_id", "ord", "match_type", "is_matched", F.round("score", 4).alias("score"))
