"""Language-model scoring of whole documents: corpus counts and a gated recurrent model."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored, text_of
from .gru import END, UNKNOWN, Gru


@dataclass(frozen=True)
class Settings:
    """Bounds and sizes of the model.

    dictionary: most frequent words whose counts every worker holds; others are joined by word.
    tokens: those of the recurrent model, the most frequent words, the end and one for all others.
    window: steps of truncated backpropagation; the state goes on from window to window.
    rounds: how often every window of every training document is used.
    streams: documents side by side. together: tokens that a task holds and orders by length for that.
    """

    dictionary: int = 200_000
    tokens: int = 1024
    per_class: int = 32
    hidden: int = 16
    window: int = 16
    rounds: int = 1
    streams: int = 256
    together: int = 4_000_000


def held_out(id_col: str) -> Column:
    """Whether the CRC-32 of the id as text leaves 2 modulo 7; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found: Counter = Counter()
        for text in batch["text"]:
            found.update(_words(text))
        yield pd.DataFrame({"word": [w.decode() for w in found], "n": list(found.values())})


class Dictionary:
    """The frequent words on a worker: place by falling count, log10 of each smoothed share."""

    def __init__(self, words: bytes, counts: np.ndarray, total: int, distinct: int, ends: int, settings: Settings) -> None:
        self.place = {w: i for i, w in enumerate(words.split(b"\n"))} if words else {}
        self.shares = np.log10((counts + 1) / (total + distinct + 1))
        self.never = float(np.log10(1 / (total + distinct + 1)))
        self.end = float(np.log10((ends + 1) / (total + distinct + 1)))
        self.end_known = int(ends > 0)
        self.top = min(settings.tokens - 2, len(self.place))
        named = 10.0 ** self.shares[: self.top]
        #: log10 of the share that words outside the model's tokens have together
        self.rest = float(np.log10(max(1 - named.sum() - 10.0**self.end, 10.0**self.never)))
        self.counts = np.r_[ends, max(total - ends - int(counts[: self.top].sum()), 0), counts[: self.top]]

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def tokens(self, places: np.ndarray) -> np.ndarray:
        """The model's ids, with the end."""
        return np.append(np.where((places >= 0) & (places < self.top), places + 2, UNKNOWN), END)


_held: dict[tuple, Dictionary] = {}


def _dictionary(shared: Broadcast, settings: Settings) -> Dictionary:
    words, counts, *rest = shared.value
    key = hashlib.sha256(words + counts.tobytes()).digest(), *rest, settings
    if key not in _held:
        _held.clear()
        _held[key] = Dictionary(*shared.value, settings)
    return _held[key]


def _together(batches: Iterator[pd.DataFrame], words: Dictionary, settings: Settings, each) -> Iterator[list]:
    """Lists of (row, token ids) of about ``together`` tokens; long ones come first, so that none runs on alone at the end."""

    def ordered(held: list, size: int) -> list:
        long = size // (2 * settings.streams)
        return sorted(held, key=lambda x: -max(len(x[1]) - long, 0))

    held, size = [], 0
    for batch in batches:
        for row, text in each(batch):
            split = _words(text)
            places = words.places(split)
            held.append((row(split, places) if row else None, words.tokens(places).astype(np.int32)))
            size += len(places) + 1
            if size >= settings.together:
                yield ordered(held, size)
                held, size = [], 0
    if held:
        yield ordered(held, size)


def _train(shared: Broadcast, start: bytes | None, settings: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen = _dictionary(shared, settings), 0
        model = Gru(words.counts, settings.hidden, settings.per_class)
        if start:
            model.load(start)
        for docs in _together(batches, words, settings, lambda batch: ((None, t) for t in batch["text"])):
            seen += model.train([ids for _, ids in docs], settings.window, settings.streams)
        if seen:
            yield pd.DataFrame({"weights": [model.dump()], "n": [seen]})

    return run


def _average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, n = None, 0
    for batch in batches:
        for weights, count in zip(batch["weights"], batch["n"], strict=True):
            part = np.frombuffer(weights, dtype=np.float32).astype(np.float64) * count
            total, n = part if total is None else total + part, n + count
    if n:
        yield pd.DataFrame({"weights": [(total / n).astype(np.float32).tobytes()], "n": [n]})


def _frequent(counts: DataFrame, most: int, buckets: int = 1024) -> tuple[bytes, np.ndarray]:
    """The most frequent words, at most ``most``, by falling count, and their counts.

    Two histograms, of bounded size, say which words fit: one of counts, eight bins to a doubling, and of the bin that
    does not fit as a whole one of counts and ``buckets`` parts of the words by hash. Only the words that fit come to the driver.
    """
    place = F.floor(F.log2("n") * 8)
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets))
    fits, left, over = F.lit(False), most, None
    for r in sorted(counts.groupBy(place.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
        if r["count"] > left:
            over = r["bin"]
            break
        fits, left = place >= r["bin"], left - r["count"]
    if over is not None:
        parts = counts.where(place == over).groupBy("n", bucket.alias("part")).count().collect()
        for r in sorted(parts, key=lambda r: (-r["n"], r["part"])):
            if r["count"] > left:
                break
            last, left = r, left - r["count"]
            fits = (place > over) | (F.col("n") > last["n"]) | ((F.col("n") == last["n"]) & (bucket <= last["part"]))
    top = counts.where(fits).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words = b"\n".join(w.encode() for w in top["word"].to_pylist())
    return words, top["n"].to_numpy().astype(np.int64)


def fit(training: DataFrame, shared: Broadcast, settings: Settings, merges: int = 8) -> bytes:
    """Weights of the recurrent model.

    In each round every task trains a copy on all windows of its documents, and copies are averaged by
    their tokens, first in ``merges`` tasks, then here: the driver gets ``merges`` models.
    """
    weights = None
    for _ in range(settings.rounds):
        models = training.mapInPandas(_train(shared, weights, settings), "weights binary, n long")
        parts = [r.asDict() for r in models.repartition(merges).mapInPandas(_average, "weights binary, n long").collect()]
        merged = list(_average(iter([pd.DataFrame(sorted(parts, key=lambda r: r["weights"]), columns=["weights", "n"])])))
        weights = merged[0]["weights"].iloc[0] if merged else weights
    return weights or b""


NAMES = ["doc_id", "held_out", "n_tokens", "known", "base", "model", "rare"]


def _score(shared: Broadcast, weights: bytes, settings: Settings, id_type: pa.DataType):
    types = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _dictionary(shared, settings)
        model = Gru(words.counts, settings.hidden, settings.per_class)
        if weights:
            model.load(weights)

        def row(name, held: bool):
            def of(split: list[bytes], places: np.ndarray) -> tuple:
                inside = places >= 0
                shares = words.shares[places[inside]]
                far = shares[places[inside] >= words.top]
                outside = float(far.sum()) - (len(far) + int((~inside).sum())) * words.rest
                rare = [w.decode() for w in compress(split, (~inside).tolist())]
                known = int(inside.sum()) + words.end_known
                return name, held, len(split) + 1, known, float(shares.sum()) + words.end, outside, rare

            return of

        def each(batch: pa.RecordBatch) -> Iterator[tuple]:
            for name, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                yield row(name, held), text

        for docs in _together(batches, words, settings, each):
            found = list(model.score(ids for _, ids in docs))
            for at in range(0, len(found), 10_000):
                rows = []
                for number, log in found[at : at + 10_000]:
                    *start, outside, rare = docs[number][0]
                    rows.append((*start, log / np.log(10) + outside, rare))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=NAMES)

    return run


def score_documents(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Words lie between 0x20 and 0x09-0x0D, ASCII letters in lower case; each document ends with one
    end token. Counts come from all training documents, those not held out. base_score: the sum of
    log10((c + 1) / (N + V + 1)). score: log10 probability under a gated recurrent model over the
    most frequent words, whose state goes on through the whole document; a word outside its tokens
    has the probability of the token for others times its smoothed share among them.

    Counts of the ``dictionary`` most frequent words are broadcast; rarer words meet theirs in a
    join. A null text counts as empty: the end alone. Without training documents all counts are
    zero. Repeated rows are scored each. Empty table: empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    training = base.where("not held_out").select("text")

    counts = stored(training.mapInPandas(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    total, distinct = (whole["n"] or 0) + ends, whole["v"] + int(ends > 0)
    shared = spark.sparkContext.broadcast((*_frequent(counts, settings.dictionary), total, distinct, ends))
    weights = fit(training, shared, settings)

    scored = stored(
        base.mapInArrow(
            _score(shared, weights, settings, to_arrow_type(docs.schema[id_col].dataType)),
            f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double, rare array<string>",
        ).withColumn("row", F.monotonically_increasing_id())
    )
    share = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total + distinct + 1)))
    rest = (
        scored.select("row", F.explode("rare").alias("word"))
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(share).alias("rare_base"), F.count("n").alias("rare_known"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.drop("rare").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("rare_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("model") + zero("rare_base")).alias("score"),
    )
