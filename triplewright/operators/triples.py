"""Triples from answers, and from sentences by patterns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import collapse, strip
from .boundary import _ids, _list, parsed


def _triples(items: Column) -> Column:
    """Of an array of variants, the arrays of three strings, trimmed, as structs; empty parts stay."""
    arrays = F.transform(items, lambda v: F.try_variant_get(v, "$", "array<variant>"))
    good = F.filter(arrays, lambda a: (F.size(a) == 3) & F.forall(a, lambda p: F.schema_of_variant(p) == "STRING"))
    part = lambda a, i: strip(F.variant_get(F.get(a, F.lit(i)), "$", "string"))
    return F.transform(good, lambda a: F.struct(part(a, 0).alias("subject"), part(a, 1).alias("object"), part(a, 2).alias("predicate")))


def extraction(rows: DataFrame) -> DataFrame:
    """``rows`` (input, raw) with sentence and triplets of one answer {"sentence", "triplets"}; the input is the default sentence."""
    rows = parsed(rows)
    said = F.try_variant_get(F.try_parse_json("value"), "$.sentence", "string")
    none = F.array().cast(f"array<{schemas.TRIPLE}>")
    found = F.coalesce(_triples(_list(F.col("value"), "triplets")), none)
    return rows.withColumns({"sentence": F.coalesce(said, F.col("input")), "triplets": found}).drop("value")


def batch_extractions(sent: DataFrame, answers: DataFrame) -> DataFrame:
    """``sent`` (prompt_hash, id, input) with sentence and triplets from the batch's answer.

    Whole-number ids within the batch count, the last of repeated ones wins, and an id without
    answer has no triples. An answer of another shape leaves empty sentences and triples.
    """
    shaped = parsed(answers).select("prompt_hash", _list(F.col("value"), "results").alias("results"))
    got = shaped.select("prompt_hash", F.posexplode("results").alias("pos", "r"))
    said = F.try_variant_get("r", "$.sentence", "string")
    found = _triples(F.try_variant_get("r", "$.triplets", "array<variant>"))
    got = got.select("prompt_hash", "pos", _ids(F.col("r")).alias("id"), F.struct(said.alias("sentence"), found.alias("triplets")).alias("x"))
    last = got.where("id is not null").groupBy("prompt_hash", "id").agg(F.max_by("x", "pos").alias("x"))
    well = shaped.select("prompt_hash", F.col("results").isNotNull().alias("well"))
    none = F.array().cast(f"array<{schemas.TRIPLE}>")
    rows = sent.join(last, ["prompt_hash", "id"], "left").join(well, "prompt_hash", "left")
    sentence = F.when(F.coalesce("well", F.lit(False)), F.coalesce("x.sentence", "input")).otherwise(F.lit(""))
    return rows.withColumns({"sentence": sentence, "triplets": F.coalesce("x.triplets", none)}).drop("x", "well")


def _trie(names: list[str]) -> dict:
    """Words to words below them; under None the name that ends there."""
    root: dict = {}
    for name in names:
        at = root
        for w in name.split(" "):
            at = at.setdefault(w, {})
        at[None] = name
    return root


def _parts(words: list[str], trie: dict) -> tuple[str, str, str] | None:
    """subject, predicate, object by the longest name with words on both sides; ties by the name, then the first place."""
    best = None
    for i in range(1, len(words) - 1):
        at, k = trie.get(words[i]), i + 1
        while at is not None and k < len(words):
            if None in at:
                key = -len(at[None]), at[None], i
                if best is None or key < best[0]:
                    best = key, k
            at, k = at.get(words[k]), k + 1
    if best is None:
        return None
    (_, name, i), k = best
    rest = " ".join(words[k:])
    return " ".join(words[:i]), name, rest[:-1] if rest.endswith(".") and len(rest) > 1 else rest


def by_patterns(sentences: DataFrame, predicates: list[str], objects: bool = True) -> DataFrame:
    """A row per triple of ``sentences`` (sentence, ...): subject, predicate, object; parts joined by "and" or commas fan out.

    The longest predicate of the vocabulary that a sentence holds between two parts is taken, by one
    walk through a trie of all of them: the plan is as large for ten thousand as for one. Every subject
    goes with every object; ``objects`` False leaves these whole. A sentence without a predicate gives a
    row whose subject is null (see ``unhandled``).
    """
    names = sorted({" ".join(p.split()) for p in predicates if p.strip()})
    shape = "struct<subject:string,predicate:string,object:string>"

    @F.pandas_udf(shape)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = _trie(names)
        for batch in batches:
            found = [_parts(s.split(" "), trie) if s else None for s in batch]
            yield pd.DataFrame([f or (None, None, None) for f in found], columns=["subject", "predicate", "object"], dtype=object)

    rows = sentences.withColumn("__t", cut(collapse(F.col("sentence"))))
    each = lambda c: F.explode_outer(F.split(c, r"\s*,\s+(?:and\s+)?|\s+and\s+", -1))
    rows = rows.withColumn("__a", each(F.col("__t.subject")))
    rows = rows.withColumn("__b", each(F.col("__t.object")) if objects else F.col("__t.object"))
    return rows.select(*sentences.columns, F.col("__a").alias("subject"), "__t.predicate", F.col("__b").alias("object"))


def unhandled(found: DataFrame) -> DataFrame:
    """The rows of by_patterns that no predicate fits, without their empty parts."""
    return found.where("subject is null").drop("subject", "predicate", "object")


def training_split(rows: DataFrame, share: float = 0.8, by: str = "sentence") -> DataFrame:
    """``rows`` with is_training, by a hash of a column: the same each time and for any partitioning."""
    bound = f"{round(share * 65536):04x}"
    return rows.withColumn("is_training", F.substring(F.md5(F.col(by).cast("binary")), 1, 4) < bound)
