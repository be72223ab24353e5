"""Language of a text by the nearest of several centroids per language, over TF-IDF vectors of byte n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, text_of

#: Places of a vector; n-grams of these many bytes are hashed to them.
DIM, SIZES = 4096, (1, 2, 3)
#: Texts, and bytes of them, that become vectors at once; a longer text is alone.
ROWS, BYTES = 256, 1 << 20
#: Parts of a vector that are added apart, and lanes in which sums of tasks are added first.
BLOCK, LANES = 512, 32
#: Vectors are summed as whole numbers, so that the order of tasks can't matter.
SCALE = 1 << 20
UNKNOWN = "und"

_letters = np.array([c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)


def counts(texts: list[bytes]) -> np.ndarray:
    """The number of each hashed n-gram in each text; what is no letter in ASCII counts as a space, spaces in a row as one."""
    body = np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)  # a space before and after each
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    body = _letters[body]
    keep = ~((body == 32) & np.r_[False, (body[1:] == 32) & (body[:-1] == 32) & (doc[1:] == doc[:-1])])
    body, doc = body[keep].astype(np.uint32), doc[keep]
    out, code = np.zeros(len(texts) * DIM, np.int64), np.zeros(len(body), np.uint32)
    for n in range(1, max(SIZES) + 1):
        code = (code[: len(body) - n + 1] << np.uint32(8)) | body[n - 1 :]
        if n in SIZES and len(code):
            place = ((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(20)
            own = doc[: len(code)] == doc[n - 1 :]
            out += np.bincount(doc[: len(code)][own] * DIM + place[own], minlength=len(out))
    return out.reshape(len(texts), DIM)


def cosines(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of unit vectors, rounded, so that which are multiplied together can't decide a tie."""
    return np.round(x @ c.T, 9)


def vectors(n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """TF-IDF at unit length: 1 + log of the counts, times the weights. No n-gram: zeros."""
    x = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * weights
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most ``k`` centroids of unit vectors by cosine: the farthest vectors first, then means in turn."""
    x = x[(x != 0).any(1)]
    if not len(x):
        return np.zeros((0, x.shape[1]))
    chosen = [int(np.argmax(np.round(x @ x.mean(0), 9)))]
    near = cosines(x, x[chosen[0]])
    while len(chosen) < k and near.min() < 1 - 1e-9:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, cosines(x, x[chosen[-1]]))
    c = x[chosen]
    for _ in range(rounds):
        which = np.argmax(cosines(x, c), axis=1)
        sums = np.stack([x[which == j].sum(0) for j in range(len(c))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        new = np.where(norm > 0, sums / np.where(norm == 0, 1, norm), c)
        if np.allclose(new, c, atol=1e-9):
            break
        c = new
    return c


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of a column, so many and so long at once."""
    i, part, size = 0, [], 0
    for k, t in enumerate(texts.cast(pa.binary()).to_pylist()):
        if part and (len(part) == ROWS or size + len(t) > BYTES):
            yield i, part
            i, part, size = k, [], 0
        part.append(t)
        size += len(t)
    if part:
        yield i, part


def _sums(key_and_values: Callable[[list[bytes], np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> Callable:
    """A task's sums of vectors of whole numbers by key, in blocks: key, block, lane, part. Columns: lang (a number), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_numpy()
            for i, part in _chunks(batch.column(1)):
                for key, values in key_and_values(part, langs[i : i + len(part)]):
                    total[key] = total[key] + values if key in total else values
        lane = TaskContext.get().partitionId() % LANES
        rows = [(k, b, lane, v[b * BLOCK : (b + 1) * BLOCK]) for k, v in total.items() for b in range(-(-len(v) // BLOCK))]
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "block", "lane", "part"])

    return run


def _added(rows: DataFrame) -> dict[int, np.ndarray]:
    """The vector of each key: parts are added in lanes, then the lanes."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return group.iloc[:1].assign(part=[np.sum(np.stack(group["part"].to_numpy()), axis=0)])

    for by in (["key", "block", "lane"], ["key", "block"]):
        rows = rows.groupBy(*by).applyInPandas(add, rows.schema)
    out: dict[int, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["key"], r["block"])):  # as many as keys times blocks
        out.setdefault(r["key"], []).extend(r["part"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


@dataclass
class Model:
    """Weights of the places; centroids with the language of each and the distance beyond which a text is far."""

    weights: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    far: np.ndarray


def fit(texts: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", clusters: int = 4, sample_rows: int = 2000) -> Model:
    """A model of all rows with a language and a letter in their text.

    Document frequencies and the final centroids are of all these rows; only where centroids start from
    is clustered on a sample by hash of about ``sample_rows`` texts a language (at most twice as many).
    ``far`` is the mean distance of a centroid's texts and four standard deviations. The model holds
    ``clusters`` vectors of DIM a language and is kept by the driver; languages are a bounded list.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{id_col}`").cast("string").alias("id"), F.lower(text_of(text_col)).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return Model(np.zeros(DIM), np.zeros((0, DIM)), [], np.zeros(0))
    number = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])[F.col("lang")].cast("int")
    numbered = rows.select(number.alias("lang"), "text", F.xxhash64("id", "text").alias("h"))

    def present(part: list[bytes], langs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, (counts(part) > 0).sum(0)

    schema = "key int, block int, lane int, part array<long>"
    df = _added(numbered.select("lang", "text").mapInArrow(_sums(present), schema))[0]
    weights = np.log((1 + sum(sizes.values())) / (1 + df)) + 1

    share = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (i, min(1.0, sample_rows / sizes[n]))])[F.col("lang")]
    sample = numbered.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = sample.withColumn("rank", rank).where(F.col("rank") <= 2 * sample_rows).select("lang", "h", "text")

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "text"])  # the same start for any partitioning
        x = np.concatenate([vectors(counts(p), weights) for _, p in _chunks(pa.array(group["text"], pa.string()))])
        found = clustered(x, clusters)
        return pd.DataFrame({"lang": int(group["lang"].iloc[0]), "vec": list(found)})

    start = sample.groupBy("lang").applyInPandas(cluster, "lang int, vec array<double>").collect()
    start = sorted(start, key=lambda r: (r["lang"], r["vec"]))
    near, owner = np.array([r["vec"] for r in start]).reshape(-1, DIM), np.array([r["lang"] for r in start], int)
    sent = spark.sparkContext.broadcast((near, owner))

    def assigned(part: list[bytes], langs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        centroids, of = sent.value
        x = vectors(counts(part), weights)
        cosine = np.where(of[None, :] == langs[:, None], cosines(x, centroids), -1)
        which, best = cosine.argmax(1), cosine.max(1)
        whole = np.rint(x * SCALE)
        for key in np.unique(which[best >= 0]).tolist():
            own = (which == key) & (best >= 0)
            apart = np.rint((1 - best[own]) * SCALE)
            tail = np.zeros(BLOCK, np.int64)
            tail[:3] = own.sum(), apart.sum(), np.rint(apart * apart / SCALE).sum()
            yield key, np.r_[whole[own].sum(0).astype(np.int64), tail]

    sums = _added(numbered.select("lang", "text").mapInArrow(_sums(assigned), schema))
    centroids, langs, far = [], [], []
    for key in sorted(sums):
        v, (n, one, two) = sums[key][:DIM].astype(float), sums[key][DIM : DIM + 3] / [1, SCALE, SCALE]
        if norm := np.linalg.norm(v):
            mean = one / n
            centroids.append(v / norm)
            langs.append(names[owner[key]])
            far.append(mean + 4 * max(0.0, two / n - mean * mean) ** 0.5)
    return Model(weights, np.array(centroids).reshape(-1, DIM), langs, np.array(far))


def has_letter(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\p{L}"))


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (the columns of ``docs``, or those of ``carry``), lang, nearest, score, far of each document.

    ``nearest`` is the language of the centroid with the highest cosine, ties to the first language,
    ``score`` that cosine, 0 to 1. ``far``: the text is farther from it than the centroid's own texts are.
    ``lang`` is ``nearest``, or und if the text is far. A null or empty text, or one without a letter,
    has und, score 0 and is far; so has each text if nothing was learned.

    Very long texts are read whole. Rows don't matter to each other, so repeated rows get the same;
    columns of any name stay in ``row``, null ids too. Empty table: empty result.
    """
    base = docs.select((F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else rows_of(docs)).alias("row"), F.lower(text_of(text_col)).alias("text"))
    base = base.withColumn("text", F.when(has_letter(F.col("text")), F.col("text")))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(1)
            names, scores, fars = [], [], []
            for _, part in _chunks(texts.fill_null("")):
                if m.langs:
                    cosine = cosines(vectors(counts(part), m.weights), m.centroids)
                    which, best = cosine.argmax(1), np.clip(cosine.max(1), 0, 1)
                    names += [m.langs[k] for k in which]
                    scores.append(best)
                    fars.append(1 - best > m.far[which])
                else:
                    names += [UNKNOWN] * len(part)
                    scores.append(np.zeros(len(part)))
                    fars.append(np.ones(len(part), bool))
            score, far = (np.concatenate(x) if x else np.zeros(0) for x in (scores, fars))
            none = texts.is_null().to_numpy(zero_copy_only=False)
            score, far = np.where(none, 0.0, score), far.astype(bool) | none
            nearest = [UNKNOWN if z else x for x, z in zip(names, none, strict=True)]
            langs = [UNKNOWN if f else x for x, f in zip(nearest, far, strict=True)]
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(nearest, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang", "nearest", "score", "far"])

    from pyspark.sql import types as T

    kinds = [("lang", T.StringType()), ("nearest", T.StringType()), ("score", T.DoubleType()), ("far", T.BooleanType())]
    return base.mapInArrow(run, T.StructType([base.schema["row"], *[T.StructField(c, t) for c, t in kinds]]))
