"""The boundary to a model: batches and prompts out, responses in."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..steps import written


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with __own in place of __group: their place, from 0, in a stretch of rows of one group."""
    last, n = None, 0
    for batch in batches:
        if not len(batch):
            continue
        at, group = batch.schema.get_field_index("__group"), batch.column("__group")
        changes = pc.not_equal(group.slice(1), group.slice(0, len(batch) - 1)).to_numpy(zero_copy_only=False)
        begins = np.r_[group[0].as_py() != last, changes]
        turn = np.arange(len(batch))
        own = turn - np.maximum.accumulate(np.where(begins, turn, -n))
        last, n = group[-1].as_py(), int(own[-1]) + 1
        yield batch.set_column(at, "__own", pa.array(own))


def batched(rows: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with batch_id, id within the batch and running: each ``n`` rows in a row of a group.

    Rows are dealt to ranges of group and order, so that a large group is in many tasks; each range counts its own rows,
    after how many of the group lie in ranges before it. A range begins within one group at most, so that there are no
    more such sums than ranges. Ties in ``order`` get numbers in any order. Null is a group like any other.
    """
    if n < 1:
        raise ValueError("a batch holds at least one row")
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order) if by or order else rows
    group = F.to_json(F.struct(*by)) if by else F.lit("")  # names what is null by leaving it out
    dealt = dealt.withColumns({"__range": F.spark_partition_id(), "__group": group})
    # counted where they are, since a window would send every row once more
    dealt = written(dealt.mapInArrow(_counted, dealt.drop("__group").schema.add("__own", "long")))
    sizes = dealt.groupBy("__range", *by).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range")) - F.col("__n")
    later = sizes.select(F.col("__range").alias("__in"), *[F.col(c).alias(f"__{c}") for c in by], before.alias("__before")).where("__before > 0")
    same = F.col("__range") == F.col("__in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    # at most a row per range
    placed = dealt.join(F.broadcast(later), same, "left")
    at = (F.col("__own") + F.coalesce("__before", F.lit(0))).cast("int")
    numbers = {"batch_id": F.floor(at / n), "id": at % n, "running": at}
    return placed.withColumns(numbers).select(*[c for c in rows.columns if c not in numbers], *numbers)


def prompts(batches: DataFrame, stage: str, by: list[str], text_col: str, id_col: str = "id", alone: bool = False) -> DataFrame:
    """stage, the group, batch_id, n, prompt_hash, payload_json: one prompt a batch, its items with their ids.

    ``alone``: each row is a batch of its own, as batched makes them with n = 1; they stay where they are then.
    """
    item = F.struct(F.col(id_col).cast("int").alias("id"), F.col(text_col).alias("text"))
    if alone:
        rows = batches.select(*by, "batch_id", F.array(item).alias("items"))
    else:
        rows = batches.groupBy(*by, "batch_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    payload = F.to_json(F.struct("items"))
    return rows.select(
        F.lit(stage).alias("stage"),
        *by,
        "batch_id",
        F.size("items").alias("n"),
        F.sha2(F.concat_ws("\n", F.lit(stage), payload), 256).alias("prompt_hash"),
        payload.alias("payload_json"),
    )


def _balanced(raw: str, opened: str, closed: str) -> str | None:
    """The first balanced bracket of a text that parses; brackets within strings don't count."""
    body = re.sub(r"```(?:json)?", "", raw)
    start = body.find(opened)
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(body)):
            c = body[i]
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
            elif c == '"':
                quoted = True
            elif c == opened:
                depth += 1
            elif c == closed:
                depth -= 1
                if not depth:
                    try:
                        json.loads(body[start : i + 1])
                        return body[start : i + 1]
                    except ValueError:
                        break
        return None
    return None


def parsed(responses: DataFrame, array: bool = False) -> DataFrame:
    """``responses`` with ``value``: the JSON object (or array) in ``raw``, as text.

    A text that is JSON as a whole is taken as it is, on the JVM; only others, with code fences or
    words around, are cut in Python at the first balanced bracket. Nothing found: {} (or []). With
    ``array``, an object alone counts as an array of one.
    """
    kind = "ARRAY" if array else "OBJECT"
    whole = F.try_parse_json("raw")
    direct = responses.withColumn("__v", F.schema_of_variant(whole))
    plain = F.when(F.startswith("__v", F.lit(kind)), F.trim("raw"))
    if array:
        plain = F.coalesce(plain, F.when(F.startswith("__v", F.lit("OBJECT")), F.concat(F.lit("["), F.trim("raw"), F.lit("]"))))
    direct = direct.withColumn("value", plain).drop("__v")

    @F.pandas_udf("string")
    def cut(raw: pd.Series) -> pd.Series:
        def one(r: str | None) -> str:
            found = _balanced(r or "", "[", "]") if array else None
            if array and found is None and (obj := _balanced(r or "", "{", "}")):
                return f"[{obj}]"
            return found if array and found else (_balanced(r or "", "{", "}") if not array else None) or ("[]" if array else "{}")

        return raw.map(one)

    rest = direct.where("value is null").withColumn("value", cut(F.coalesce("raw", F.lit(""))))
    return direct.where("value is not null").unionByName(rest)


def _strings(items: Column) -> Column:
    """The strings of an array of variants, stripped, without blanks."""
    only = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.filter(F.transform(only, lambda v: strip(F.variant_get(v, "$", "string"))), lambda s: s != "")


def _list(value: Column, name: str) -> Column:
    """The list under a name of a JSON object, as variants; anything else: null."""
    return F.try_variant_get(F.try_parse_json(value), f"$.{name}", "array<variant>")


def qualities_of(value: Column) -> Column:
    """The strings of {"qualities": [...]}; another shape gives none."""
    return F.coalesce(_strings(_list(value, "qualities")), F.array().cast("array<string>"))


def quality_lines(raw: Column) -> Column:
    """The lines of an answer that is no JSON, without list marks and blanks."""
    bare = F.transform(F.split(raw, "\n", -1), lambda x: F.regexp_replace(strip(x), r"^[-•\s]+", ""))
    return F.filter(bare, lambda x: x != "")


def qualities_or_lines(responses: DataFrame) -> DataFrame:
    """``responses`` with qualities: those of the JSON, or else the lines of the answer."""
    rows = parsed(responses).withColumn("qualities", qualities_of(F.col("value")))
    return rows.withColumn("qualities", F.when(F.size("qualities") > 0, F.col("qualities")).otherwise(quality_lines(F.col("raw")))).drop("value")


def _ids(v: Column) -> Column:
    """An id given as a whole number or as its digits; else null."""
    digits = F.regexp_extract(F.try_variant_get(v, "$.id", "string"), r"^\s*(\d+)\s*$", 1)
    kind = F.schema_of_variant(F.try_variant_get(v, "$.id", "variant"))
    return F.when(kind.isin("STRING", "BIGINT"), F.nullif(digits, F.lit("")).try_cast("int"))


def batch_qualities(sent: DataFrame, answers: DataFrame, cap: int = 12, on_error: str = "empty") -> DataFrame:
    """``sent`` (prompt_hash, id, ...) with the qualities that its batch's answer has for the id.

    Ids outside the batch are dropped, of repeated ids the last wins, missing ones get none; at most
    ``cap`` each. A batch without answer gives none, or an error with on_error='fail'.
    """
    got = parsed(answers).select("prompt_hash", F.posexplode_outer(_list(F.col("value"), "results")).alias("pos", "r"))
    items = F.filter(
        F.transform(F.try_variant_get("r", "$.qualities", "array<variant>"), lambda v: strip(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))),
        lambda s: s != "",
    )
    got = got.select("prompt_hash", "pos", _ids(F.col("r")).alias("id"), items.alias("qualities"))
    last = got.where("id is not null").groupBy("prompt_hash", "id").agg(F.max_by("qualities", "pos").alias("qualities"))
    if on_error == "fail":
        known = answers.select("prompt_hash", F.lit(True).alias("__answered")).distinct()
        sent = sent.join(known, "prompt_hash", "left").withColumn(
            "id", F.when(F.col("__answered").isNull(), F.raise_error(F.lit("a batch has no answer"))).otherwise(F.col("id"))
        ).drop("__answered")
    none = F.array().cast("array<string>")
    rows = sent.join(last, ["prompt_hash", "id"], "left")
    return rows.withColumn("qualities", F.slice(F.coalesce("qualities", none), 1, cap))


def _short(prompt_hash: Column) -> Column:
    """A SHA-256 in hexadecimal digits as its 32 bytes, half as long to send; any other text as more bytes than that."""
    return F.when(prompt_hash.rlike(r"^[0-9a-f]{64}\z"), F.unhex(prompt_hash)).otherwise(F.encode(F.concat(F.lit(" " * 33), prompt_hash), "UTF-8"))


def failed_batches(sent: DataFrame, answers: DataFrame, by: list[str]) -> DataFrame:
    """by, batch_id of the prompts without an answer."""
    said = answers.where("raw is not null").select("prompt_hash").distinct()
    return sent.join(said, "prompt_hash", "left_anti").select(*by, "batch_id")


def decomposed(
    rows: DataFrame, answers: DataFrame, n: int, by: list[str], order: list[str], text_col: str,
    cap: int = 12, on_error: str = "empty", mode: str = "chunks", sent: DataFrame | None = None,
) -> DataFrame:
    """by, batch_id, id, pos, quality: the qualities of texts in batches of ``n``, in order.

    ``answers`` holds what a model said to prompts(batched(rows)); a batch without one has failed. With
    on_error='empty' (batches side by side) it has no qualities; with 'stop' (one after the other)
    neither it nor a later batch of its group has; 'fail' makes it an error. With mode='sentences' each
    text is a prompt of its own, answered by {"qualities": [...]}. ``sent``: those prompts, if they lie written, as they
    must to be answered; they are then not made again from ``rows``.
    """
    if on_error not in ("empty", "stop", "fail") or mode not in ("chunks", "sentences"):
        raise ValueError("unknown policy or mode")
    alone = mode == "sentences"
    if sent is None:
        sent = prompts(batched(rows, 1 if alone else n, by, order), "decompose_text" if alone else "decompose", by, text_col, alone=alone)
    items = F.from_json("payload_json", "items array<struct<id:int,text:string>>")["items"]
    asked = sent.select(*by, "batch_id", "prompt_hash", F.explode(items).alias("i")).withColumn("id", F.col("i.id")).drop("i")
    if alone:
        said = parsed(answers.where("raw is not null")).select(_short(F.col("prompt_hash")).alias("key"), F.slice(qualities_of(F.col("value")), 1, cap).alias("qualities"))
        asked = asked.select(*by, "batch_id", "id", _short(F.col("prompt_hash")).alias("key"))
        found = asked.join(said.dropDuplicates(["key"]), "key", "left")  # without an answer: null
        if on_error == "fail":
            found = found.withColumn("qualities", F.coalesce("qualities", F.raise_error(F.lit("a text has no answer")).cast("array<string>")))
    else:
        found = batch_qualities(asked, answers, cap, on_error)
    if on_error == "stop":
        if alone:
            found = written(found.select(*by, "batch_id", "id", "qualities"))
        failed = found.where("qualities is null") if alone else failed_batches(sent, answers, by)
        if not alone or not failed.isEmpty():  # else no text has to go to its group
            first = failed.groupBy(*by).agg(F.min("batch_id").alias("__stop"))
            found = found.join(first, by, "left").where(F.col("__stop").isNull() | (F.col("batch_id") < F.col("__stop")))
    return found.select(*by, "batch_id", "id", F.posexplode("qualities").alias("pos", "quality"))


def answered(sent: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """prompt_hash, raw: what a caller that the user supplies says to each payload; raw is null where it fails.

    Prompts are sent where their partition is; a call is repeated if its task is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said: list[str | None] = []
            for payload in batch["payload_json"]:
                try:
                    said.append(call(payload))
                except Exception:  # the policy for missing answers decides later
                    said.append(None)
            yield pd.DataFrame({"prompt_hash": batch["prompt_hash"], "raw": said})

    return sent.select("prompt_hash", "payload_json").mapInPandas(run, "prompt_hash string, raw string")


def synonyms(answers: DataFrame, most: int = 10) -> DataFrame:
    """keyword, ord, synonym: at most so many strings of {"synonyms": [...]} for each keyword, lower case."""
    rows = parsed(answers).select("keyword", F.posexplode(F.slice(_strings(_list(F.col("value"), "synonyms")), 1, most)).alias("ord", "synonym"))
    return rows.withColumn("synonym", F.lower("synonym"))
