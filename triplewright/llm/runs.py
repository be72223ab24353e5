"""Periodic runs of words in documents, found on a grammar of each text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .repair import runs_of
from .rolling import Powers

#: Words of the texts that are looked through together; a longer text is alone.
TOGETHER = 1 << 18
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(texts: list[bytes], powers: Powers, least: int, times: int) -> Iterator[tuple[int, list[dict], dict | None, str]]:
    """(words, runs, strongest run, text without repetitions) of each text."""
    split = [t.split() for t in texts]  # bytes split at 0x20 and 0x09-0x0D alone
    bounds = np.cumsum([0, *map(len, split)])
    fresh, ids = count(), []
    for words in split:
        known: dict[bytes, int] = defaultdict(fresh.__next__)
        ids += [known[w] for w in words]
    rows = runs_of(np.array(ids, np.int64), bounds, powers, least, times)
    first = np.searchsorted(rows[:, 0], bounds)
    for d, words in enumerate(split):
        own = rows[first[d] : first[d + 1]] - [bounds[d], bounds[d], 0]
        runs = [{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()]
        best = None
        for r in runs:
            if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
                best = r
        if runs:
            keep = np.ones(len(words), bool)
            for r in runs:
                keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
            words = [words[i] for i in np.flatnonzero(keep)]
        yield len(split[d]), runs, best, b" ".join(words).decode()


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (the columns of ``docs``, or those of ``carry``), words, runs, best, text without repetitions.

    ``words`` counts the words between blanks (0x20, 0x09-0x0D). A run is a stretch of words with smallest
    period q and a length of ``least`` and ``times`` * q at least (``times``: 3 or more) that no word
    beside it extends; ``runs`` has start, length and period of each by start, then period. ``best``
    has the greatest length / period, ties to the smaller start, then period; null without runs. Of each
    run the first q words stay in ``text``, whose words are joined by one space.

    A null or empty text has no words. Very long texts are looked through whole, in memory that grows
    with their words. Rows are apart from each other, so repeated rows, ties and null ids are no
    matter; columns of any name stay in ``row``. Empty table: empty result.
    """
    if times < 3:
        raise ValueError("runs are found from three repetitions on")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), text_of(text_col).alias("text"))
    kind = base.schema["row"]
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    out = T.StructType([kind, T.StructField("words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("best", run), T.StructField("text", T.StringType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts, i = batch.column(1), 0
            sizes = np.array([len(x) for x in texts.cast(pa.binary()).to_pylist()]) if len(texts) else np.zeros(0, int)
            ends = np.cumsum(sizes)
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 8 * TOGETHER, "right")))
                part = [x or b"" for x in texts.slice(i, j - i).cast(pa.binary()).to_pylist()]
                n, runs, best, kept = zip(*_found(part, powers, least, times), strict=True)
                columns = [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(best, RUN), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "words", "runs", "best", "text"])
                i = j

    return base.mapInArrow(look, out)
