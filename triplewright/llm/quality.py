"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialize, rows_of, stored, text_of

#: Hashed features that words add to the nine shares.
BUCKETS = 256
#: Bounds of a probability before its log-odds are taken.
LEAST = 1e-6


def _features(text: Column) -> list[Column]:
    """Shares of kinds of characters and words; all are finite for an empty text."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), BLANKS, -1)
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / size
    return [
        share(r"\p{Lu}"),
        share(r"[0-9]"),
        share(r"[^\p{L}\p{N}\x20\x09-\x0D.,!?|]"),
        share(r"[!?]"),
        share(r"[|]"),
        share(r"[.,]"),
        F.size(words) / size,
        F.size(F.array_distinct(words)) / F.size(words),
        F.log1p(size),
    ]


def _buckets(text: Column) -> Column:
    """The hashed feature of each different word, ASCII letters in lower case."""
    words = F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r")), BLANKS, -1)
    return F.transform(F.array_distinct(words), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


@dataclass(frozen=True)
class Model:
    """Weights of a logistic model over _features, and over the shares of _buckets among different words."""

    bias: float
    weights: tuple[float, ...]
    words: tuple[float, ...]
    rows: int

    def log_odds(self, text: Column) -> Column:
        total = F.lit(self.bias)
        for f, w in zip(_features(text), self.weights, strict=True):
            total = total + f * w
        table, zero = F.array(*[F.lit(w) for w in self.words]), F.lit(0.0)
        of = lambda found: F.aggregate(found, zero, lambda acc, i: acc + F.get(table, i)) / F.size(found)
        return total + F.get(F.transform(F.array(_buckets(text)), of), F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str, label_col: str) -> Model:
    """A ridge logistic model by Newton's method on at most ``sample_rows`` labelled documents.

    The sample is the labelled ids with the smallest hashes. Ids with several labels count once,
    with their best; null ids and labels are left out.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.select("label", F.array(*_features(F.col("text"))).alias("x"), _buckets(F.col("text")).alias("b"))
    sample = rows.limit(sample_rows).toPandas()
    if not len(sample):
        return Model(0.0, (), (), 0)
    x, y = np.stack(sample["x"].to_numpy()), (sample["label"].to_numpy() > 0).astype(float)
    hashed = np.stack([np.bincount(b, minlength=BUCKETS) / len(b) for b in sample["b"]])
    order = np.lexsort((*x.T, y))  # rows come in any order; sums should not depend on it
    x, y = np.c_[x, hashed][order], y[order]
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    n = x.shape[1] - BUCKETS
    w, ridge = np.zeros(z.shape[1]), np.r_[1e-3, np.ones(n), np.full(BUCKETS, 20.0)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / sd
    return Model(float(w[0] - weights @ mean), tuple(map(float, weights[:n])), tuple(map(float, weights[n:])), len(sample))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(LEAST)), F.lit(1 - LEAST))
    return F.log(p / (1 - p))


def _precision(groups: DataFrame, mean: Column) -> float:
    """How many documents' worth the prior counts, by the method of moments.

    ``groups``: n, s (sum of probabilities). What group means vary beyond what their sizes explain
    is true spread between groups; little spread makes a strong prior.
    """
    row = groups.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.pow(F.col("s") / F.col("n") - mean, 2) * F.col("n")).alias("ss"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("v"),
    ).first()
    if not row["n"] or row["k"] < 2:
        return 10.0
    within = row["v"] / row["n"]
    size = row["n"] - row["nn"] / row["n"]
    spread = (row["ss"] - (row["k"] - 1) * within) / size if size > 0 else 0.0
    return float(np.clip(within / spread - 1, 1.0, 1e4)) if spread > 0 else 1e4


def classify(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 20_000,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    carry: list[str] | None = None,
) -> DataFrame:
    """row (the columns of ``docs``, or those of ``carry``), doc (the text's own probability), host, path, score and keep.

    A logistic model is fitted on at most ``sample_rows`` labelled documents and applied to all; what it
    says is written with each row, so that texts are read once. Its probabilities are summed by host and path over all
    documents. A host's posterior shrinks to the global mean, a path's to its host's, by precisions estimated from the
    spread between groups; score adds the path's log-odds against the global ones to the text's. keep: the
    score reaches ``threshold``.

    Null texts count as empty, null hosts and paths as groups of their own. Without labels every
    text has probability 0.5 and is kept. Rows are neither merged nor dropped, repeated ones
    too. Columns of any name stay in ``row``. Very long texts are read whole. Empty table: empty result.
    """
    model = fit(docs, labels, sample_rows, id_col, text_col, label_col)
    kept = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else rows_of(docs)
    odds = model.log_odds(text_of(text_col)) if model.weights else F.lit(0.0)
    site = F.col(f"`{host_col}`").alias("h"), F.col(f"`{path_col}`").alias("p")
    scored = stored(docs.select(kept.alias("row"), *site, odds.alias("odds")))
    scored = scored.withColumn("doc", 1 / (1 + F.exp(-F.col("odds"))))
    paths = materialize(scored.groupBy("h", "p").agg(F.count("*").alias("n"), F.sum("doc").alias("s")))
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = whole["s"] / whole["n"] if whole["n"] else 0.5
    of_host = _precision(hosts, F.lit(mean))
    hosts = hosts.select(F.col("h").alias("hh"), ((F.col("s") + of_host * mean) / (F.col("n") + of_host)).alias("host"))
    placed = paths.join(hosts, F.col("h").eqNullSafe(F.col("hh"))).drop("hh")
    of_path = _precision(placed, F.col("host"))
    path = (F.col("s") + of_path * F.col("host")) / (F.col("n") + of_path)
    # written, so that Spark knows its size: it is broadcast where it is small, and else a hot site can be split
    sites = stored(placed.select(F.col("h").alias("sh"), F.col("p").alias("sp"), "host", path.alias("path")))
    same = F.col("h").eqNullSafe(F.col("sh")) & F.col("p").eqNullSafe(F.col("sp"))
    odds = F.col("odds") + _logit(F.col("path")) - _logit(F.lit(mean))
    score = 1 / (1 + F.exp(-odds))
    return scored.join(sites, same, "left").select(
        "row", "doc", "host", "path", score.alias("score"), (score >= threshold).alias("keep")
    )
