"""Sources: text files, pages, chunks, seed triples, keywords, feedback and run logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..steps import required


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """source, text: one row per file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def text_sentences(texts: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, page_number, sentence: a row per line that is not blank.

    A line is stripped, then loses the punctuation at its end, and may be empty after that;
    page_number counts the lines kept, from 0.
    """
    kept = F.filter(text.lines(F.col(text_col)), lambda x: text.strip(x) != "")
    found = F.posexplode(F.transform(kept, text.bare_line)).alias("page_number", "sentence")
    return texts.select(F.col(source_col).alias("source"), found)


def paragraphs_of(docs: DataFrame, need: bool = False) -> DataFrame:
    """doc_id, ord, body: lines in order, without blank ones; ``need``: an error if none is left."""
    out = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "body"))
    out = out.where(text.strip(F.col("body")) != "")
    return required(out, "no paragraph holds text") if need else out


def pages_of(docs: DataFrame, page_limit: int | None = None) -> DataFrame:
    """title, page_number (from 1), body of pages that were extracted before; at most ``page_limit`` of each."""
    pages = docs.select(
        F.regexp_replace(F.regexp_replace("source", "^.*/", ""), r"(?<=.)\.[^.]*$", "").alias("title"),
        "doc_id",
        F.posexplode(F.split("text", "\n", -1)).alias("at", "body"),
    ).select("title", "doc_id", (F.col("at") + 1).alias("page_number"), "body")
    return pages if page_limit is None else pages.where(F.col("page_number") <= page_limit)


#: Where a text may be cut, best first; the empty string cuts anywhere.
CUTS = ("\n\n", "\n", " ", "")


#: Characters of chunks that are given on at once, about.
GIVEN = 1 << 20


def _cut(body: str, cut: str) -> Iterator[str]:
    """The parts of a text between marks, one after the other, each with the mark before it."""
    if not cut:
        yield from body
        return
    at, to = 0, body.find(cut)
    while to >= 0:
        yield body[at:to]
        at, to = to, body.find(cut, to + len(cut))
    yield body[at:]


def _pieces(body: str, size: int, cuts: tuple[str, ...]) -> Iterator[str]:
    """Pieces of at most ``size`` characters, each with the mark before it."""
    at = next(i for i, c in enumerate(cuts) if c in body)
    cut, finer = cuts[at], cuts[at + 1 :]
    for part in _cut(body, cut):
        if len(part) <= size or not finer:
            if part:
                yield part
        else:
            yield from _pieces(part, size, finer)


def _chunks(body: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """What chunks() gives, one after the other."""
    held: list[tuple[int, str]] = []
    total = at = 0

    def gathered() -> Iterator[tuple[int, str]]:
        whole = "".join(p for _, p in held)
        chunk = whole.strip()
        if chunk:
            yield held[0][0] + whole.index(chunk), chunk

    for piece in _pieces(body, size, CUTS) if body else ():
        if total + len(piece) > size and held:
            yield from gathered()
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0)[1])
        held.append((at, piece))
        total += len(piece)
        at += len(piece)
    if held:
        yield from gathered()


def chunks(body: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk): pieces gathered to at most ``size`` characters, the last ``overlap`` taken over."""
    return list(_chunks(body, size, overlap))


def _chunk_batches(size: int, overlap: int):
    """Chunks of batches (doc_id, page_number, body); a task holds one text and some GIVEN characters of chunks at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])

            def given() -> pa.RecordBatch:
                row = pa.array(found[0], pa.int32())
                columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(found[1], pa.int64()), pa.array(found[2], pa.string())]
                for c in found:
                    c.clear()
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "page_number", "start_index", "chunk"])

            held = 0
            for row, body in enumerate(batch.column(2)):
                for start, chunk in _chunks(body.as_py() or "", size, overlap):
                    for c, value in zip(found, (row, start, chunk), strict=True):
                        c.append(value)
                    held += len(chunk)
                    if held >= GIVEN:
                        yield given()
                        held = 0
            if found[0]:
                yield given()

    return run


def chunked(pages: DataFrame, size: int = 700, overlap: int = 70) -> DataFrame:
    """doc_id, page_number, start_index, chunk: overlapping chunks of each page; doc_id and page_number as in ``pages``."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", F.col("page_number").cast("long").alias("page_number"), "body").mapInArrow(
        _chunk_batches(size, overlap), f"doc_id {kind}, page_number long, start_index long, chunk string"
    )


def cleaned_chunks(pages: DataFrame, size: int = 700, overlap: int = 70) -> DataFrame:
    """chunked() with each chunk cleaned; one that is cleaned away stays as an empty one."""
    rows = chunked(pages, size, overlap)
    return rows.select("doc_id", "page_number", F.col("start_index").alias("chunk_start_index"), text.clean_lines(F.col("chunk")).alias("chunk"))


def chunk_corpus(docs: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """(rows, mode) of a corpus: TEXT gives sentences, PDF_CHUNKS chunks, PDF_PARAGRAPHS paragraphs as chunks."""
    if kind == "TEXT":
        return required(text_sentences(docs, "doc_id"), "no documents"), "sentences"
    if kind == "PDF_CHUNKS":
        pages = docs.select("doc_id", F.lit(1).alias("page_number"), F.col("text").alias("body"))
        return required(cleaned_chunks(pages), "no documents"), "chunks"
    if kind == "PDF_PARAGRAPHS":
        return paragraphs_of(docs, need=True), "chunks"
    raise ValueError(f"unknown kind of source: {kind}")


def seed_edges(rows: DataFrame, source: str, need: bool = False) -> DataFrame:
    """src, label, dst, sentence, source of seed triples; rows with an empty part are left out."""
    tidy = rows.select(
        text.collapse(F.col("source")).alias("src"),
        text.collapse(F.col("relationship")).alias("label"),
        text.collapse(F.col("destination")).alias("dst"),
    ).where("src <> '' and label <> '' and dst <> ''")
    out = tidy.select("src", "label", "dst", F.concat_ws(" ", "src", "label", "dst").alias("sentence"), F.lit(source).alias("source"))
    return required(out, "no valid row in the seed") if need else out


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SEED).csv(path, sep=";", header=True)


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """keyword: the strings of {"keywords": [...]}, stripped, without blanks; another shape is an error."""
    rows = spark.read.schema("keywords array<string>, _corrupt_record string").json(path, multiLine=True)
    checked = rows.select(F.when(F.col("keywords").isNull(), F.raise_error(F.lit("keywords must be a list"))).otherwise(F.col("keywords")).alias("k"))
    return checked.select(F.explode("k").alias("k")).select(text.strip(F.col("k")).alias("keyword")).where("keyword <> ''")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FEEDBACK).csv(path, header=True)


def empty_feedback(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.FEEDBACK)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A family of run logs; a file that is no JSON gives a row with _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE")


def coerced_edges(rows: DataFrame) -> DataFrame:
    """Edges as read: ids as text, '' where missing; the predicate is type, else label, else REL."""
    name = [F.col(c) for c in ("type", "label") if c in rows.columns]
    ids = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source_id", "target_id") if c in rows.columns]
    rest = [c for c in rows.columns if c not in ("type", "label", "source_id", "target_id")]
    return rows.select(*rest, F.coalesce(*name, F.lit("REL")).alias("label"), *ids)
