"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language, line_dedup, lm, packing, phrases, quality, runs, secret_scan, simhash, substring, topk
from .common import BLANKS, documents, text_of

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.classify(documents(spark, sf_dir), labels, carry=["doc_id"])
    return found.select(
        "row.doc_id",
        F.col("doc").alias("doc_probability"),
        F.col("host").alias("host_posterior"),
        F.col("path").alias("path_posterior"),
        "score",
        "keep",
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secret_scan.BASE + secret_scan.MORE
    found = secret_scan.secret_scan(documents(spark, sf_dir).select("doc_id", "text"), rules)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE))
    return found.select(
        "row.doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.joined(base, rules), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans"), rules).alias("spans"),
    )


def _op2_sql() -> str:
    rules = secret_scan.BASE + secret_scan.MORE
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    matches = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, {quote(r.kind)} AS name, {r.least} AS least, "
        f"string_split_regex(text, {quote(r.pattern)}) AS gaps, regexp_extract_all(text, {quote(r.pattern)}, 0) AS found, "
        f"regexp_extract_all(text, {quote(r.pattern)}, {r.group}) AS counted FROM d"
        for i, r in enumerate(rules)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({matches}),
e AS (
  SELECT doc_id, kind, name, least, unnest(gaps[1:len(found)]) AS gap, unnest(found) AS hit, unnest(counted) AS part,
    generate_subscripts(found, 1) AS i FROM m WHERE len(found) > 0
), s AS (
  SELECT doc_id, kind, name, least, length(part) AS size,
    sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS stop, length(hit) AS n FROM e
), k AS (
  SELECT doc_id, kind, stop - n AS start, name || ':' || (stop - n) || ':' || stop AS span FROM s WHERE size >= least
), a AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(span, ',' ORDER BY start, kind) AS spans FROM k GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), VOCABULARY)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), digest_all=True)


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(documents(spark, sf_dir), VOCABULARY)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    # floor gives a long, in which NaN and the infinities would be whole numbers, so these go first
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(finite).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x * 256).cast("double")).alias("embedding")
    )
    return topk.exact_topk(vectors.where("vec_id % 50 = 0"), vectors, k=5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(documents(spark, sf_dir), texts=False)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text", "source")).select(
        "row.doc_id",
        F.col("lines").alias("n_lines"),
        F.col("removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), e AS (
  SELECT doc_id, site, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d
), t AS (
  SELECT *, trim(line, E' \t\n\x0b\f\r') AS body FROM e
), b AS (
  SELECT body, min(doc_id) AS first_id FROM t WHERE body <> '' GROUP BY body HAVING count(DISTINCT site) >= 8
), k AS (
  SELECT t.doc_id, t.line, t.place, b.body IS NULL OR t.doc_id = b.first_id AS kept FROM t LEFT JOIN b USING (body)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (kept), '')) AS text_sha256
FROM k GROUP BY doc_id
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir).select("doc_id", "lang", "text"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), g AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM p, (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size
), f AS (
  SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10
), w AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f
), holds AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM w WHERE size = 3
  ) GROUP BY ALL
), own AS (
  SELECT w.* FROM w LEFT JOIN holds USING (lang, phrase) WHERE size > 1 AND NOT coalesce(100 * longer >= 50 * a, false)
), cut AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:size], ' ') AS two
  FROM own, (VALUES (1), (2)) s(k) WHERE k < size
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cut c JOIN f l ON l.lang = c.lang AND l.phrase = c.one JOIN f r ON r.lang = c.lang AND r.phrase = c.two
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) QUALIFY rank <= 2000
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(text_of(), BLANKS, -1), lambda w: w != "")
    docs = documents(spark, sf_dir).select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    # one document in ten gets a tail that repeats
    split = docs.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    g = F.floor(F.col("h") / 10)
    cut = split.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.flatten(F.array_repeat(period, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    altered = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a"))), " ")
    given = cut.select("doc_id", F.when(F.col("a").isNotNull(), altered).otherwise(F.col("text")).alias("text"))
    found = runs.periodic_runs(given, carry=["doc_id"])
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    told = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text", held_out.alias("held_out"))
    model = language.fit(docs.where("not held_out and lang is not null"))
    found = language.identify(docs, model, carry=["doc_id", "held_out"])
    # the nearest language even of a far text; far tells it
    return found.select("row.doc_id", "row.held_out", F.col("nearest").alias("lang_pred"), "score", "far")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_secrets": op2_secrets,
        "op3_packing": op3_packing,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_simhash": op5_simhash,
        "op6_bpe": op6_bpe,
        "op7_language_model": op7_language_model,
        "op8_topk": op8_topk,
        "op9_substring": op9_substring,
        "op10_line_dedup": op10_line_dedup,
        "op11_collocations": op11_collocations,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_language": op13_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": _op2_sql(), "op4_exact_dedup": OP4_SQL, "op8_topk": OP8_SQL, "op10_line_dedup": OP10_SQL, "op11_collocations": OP11_SQL}
