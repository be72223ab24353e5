"""The novelty stage: what is sent to a judge, and what its answers become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, tokens
from .gate import STOP_WORDS

#: Fixed values.
DECISIONS = ("EXISTING", "PARTIALLY_NEW", "NEW")
NO_RATIONALE = "No rationale provided."


def inputs(kept: DataFrame, most: int = 3) -> DataFrame:
    """``kept`` with its first ``most`` neighbours (score, sentence), of which blank ones are then dropped."""
    first = F.slice("neighbors", 1, most)
    return kept.withColumn("neighbors", F.filter(first, lambda n: strip(F.coalesce(n["sentence"], F.lit(""))) != ""))


def decision_of(raw: Column, spans: Column) -> Column:
    """The decision in upper case, PARTIALLY_NEW if unknown, or if EXISTING comes with new spans."""
    name = F.upper(strip(F.coalesce(raw, F.lit(""))))
    known = F.when(name.isin(*DECISIONS), name).otherwise("PARTIALLY_NEW")
    return F.when((known == "EXISTING") & (F.size(spans) > 0), "PARTIALLY_NEW").otherwise(known)


def coerced(rows: DataFrame) -> DataFrame:
    """``rows`` (decision, rationale, novel_spans, matched_neighbor_sentence, confidence as text) made regular.

    ``valid`` says whether the confidence is a number from 0 to 1; a missing one is not.
    """
    none = F.array().cast("array<string>")
    spans = F.filter(F.transform(F.coalesce("novel_spans", none), strip), lambda s: s != "")
    number = F.col("confidence").try_cast("double")
    rows = rows.withColumn("novel_spans", spans)
    return rows.withColumns(
        {
            "decision": decision_of(F.col("decision"), F.col("novel_spans")),
            "rationale": F.coalesce(F.nullif(strip(F.col("rationale")), F.lit("")), F.lit(NO_RATIONALE)),
            "matched_neighbor_sentence": F.nullif(strip(F.col("matched_neighbor_sentence")), F.lit("")),
            "confidence": number,
            "valid": F.coalesce(number.between(0.0, 1.0), F.lit(False)),
        }
    )


def strict(rows: DataFrame) -> DataFrame:
    """coerced() where a bad confidence is an error."""
    checked = F.when(F.col("valid"), F.col("confidence")).otherwise(F.raise_error(F.lit("confidence must be a number from 0 to 1")))
    return coerced(rows).withColumn("confidence", checked).drop("valid")


def aligned(sent: DataFrame, received: DataFrame) -> DataFrame:
    """sent (id, ...) joined with received (id, pos, ...) of which the last for an id wins, by id.

    An id that was sent and not received, or received and not sent, is an error.
    """
    rest = [c for c in received.columns if c not in ("id", "pos")]
    last = received.groupBy("id").agg(F.max_by(F.struct(*rest), "pos").alias("r"), F.lit(True).alias("got"))
    both = sent.withColumn("asked", F.lit(True)).join(last, "id", "full_outer")
    wrong = F.col("asked").isNull() | F.col("got").isNull()
    error = F.raise_error(F.concat(F.lit("ids of sent and received differ: "), F.col("id").cast("string")))
    rows = both.withColumn("id", F.when(wrong, error.cast("long")).otherwise(F.col("id")))
    return rows.select(*sent.columns, "r.*")


def by_rules(rows: DataFrame, low: float = 0.45, high: float = 0.9) -> DataFrame:
    """A verdict without a model: rows (quality, max_score, neighbors by score) with decision and novel_spans.

    novel_spans: the words of the quality that its best neighbour lacks. High similarity and
    nothing new: EXISTING; below ``low``, or no neighbour: NEW; else PARTIALLY_NEW.
    """
    words = lambda c: F.filter(F.array_distinct(tokens(c)), lambda t: ~t.isin(STOP_WORDS))
    best = F.coalesce(F.get("neighbors", F.lit(0))["sentence"], F.lit(""))
    rows = rows.withColumn("novel_spans", F.array_except(words(F.col("quality")), words(best)))
    verdict = (
        F.when((F.size("neighbors") == 0) | (F.col("max_score") < low), "NEW")
        .when((F.col("max_score") >= high) & (F.size("novel_spans") == 0), "EXISTING")
        .otherwise("PARTIALLY_NEW")
    )
    return rows.withColumn("decision", verdict)


def classified(rows: DataFrame, received: DataFrame) -> DataFrame:
    """Verdicts of qualities (id, quality, max_score, ...) from a model's results (id, pos, decision, ...), strictly by id.

    No quality gives no verdict; ids that don't agree, or a bad confidence, are errors.
    """
    return strict(aligned(rows, received))


def counts(rows: DataFrame) -> DataFrame:
    """decision, n for each of the three, none left out."""
    names = rows.sparkSession.createDataFrame([(d,) for d in DECISIONS], "decision string")
    found = rows.groupBy("decision").agg(F.count("*").alias("n"))
    return names.join(found, "decision", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rebuilt(rows: DataFrame) -> DataFrame:
    """Results from outside rows: a quality is needed, max_score is 0 by default, and there are no neighbours."""
    named = F.nullif(strip(F.coalesce("quality", F.lit(""))), F.lit(""))
    rows = rows.withColumn("quality", F.coalesce(named, F.raise_error(F.lit("a result needs a quality")).cast("string")))
    score = F.coalesce(F.col("max_score").cast("double"), F.lit(0.0))
    return coerced(rows.withColumn("max_score", score)).withColumn("neighbors", F.array().cast("array<string>"))


def policy(text: str | None) -> tuple[str, ...]:
    """The decisions of a comma list; unknown ones are dropped, and none left means PARTIALLY_NEW and NEW."""
    names = [x.strip().upper() for x in (text or "").split(",")]
    return tuple(d for d in DECISIONS if d in names) or ("PARTIALLY_NEW", "NEW")


def qualifying(rows: DataFrame, allowed: str | None = None, enabled: bool = False) -> DataFrame:
    """Results whose decision the policy lets on; off by default: all."""
    return rows.where(F.col("decision").isin(*policy(allowed))) if enabled else rows
