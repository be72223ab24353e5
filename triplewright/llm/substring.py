"""Substring de-duplication: suffix automata of reference shards, documents' runs streamed for matching statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import stored, text_of

#: Bytes that are hashed together.
BLOB = 500_000
#: Words of an owner that one reference passage's shard key covers; a larger owner has several.
BLOCK = 4096
MASK = (1 << 64) - 1
#: For each of two independent hashes, an odd number whose powers modulo 2**64 weigh the bytes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    out, have = np.ones(n, dtype=np.uint64), 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0x94D049BB133111EB)


class Hashes:
    """Hashes of runs of words of several texts at once, by prefix sums of weighted bytes."""

    weight = [_mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) | np.uint64(1) for b in BASES]
    up = [_powers(b, 1 << 12) for b in BASES]
    down = [_powers(pow(b, -1, 1 << 64), 1 << 12) for b in BASES]

    def __init__(self, texts: list[str]) -> None:
        blob = b"\n".join([b" ".join(t.encode().split()) for t in texts])
        self.data = data = np.frombuffer(blob, dtype=np.uint8)
        gap = np.flatnonzero((data == 0x20) | (data == 0x0A))
        start, end = np.r_[0, gap + 1], np.r_[gap, len(data)]
        text = np.r_[0, np.cumsum(data[gap] == 0x0A)]
        word = end > start
        self.start, self.end, self.text = start[word], end[word], text[word]
        self.sums: dict[int, np.ndarray] = {}

    def _sums(self, which: int) -> np.ndarray:
        size = len(self.data)
        if which not in self.sums:
            if len(Hashes.up[which]) < size:
                Hashes.up[which] = _powers(BASES[which], 2 * size)
                Hashes.down[which] = _powers(pow(BASES[which], -1, 1 << 64), 2 * size)
            sums = self.sums[which] = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(self.weight[which][self.data] * self.up[which][:size], out=sums[1:])
        return self.sums[which]

    def whole(self, n: int) -> np.ndarray:
        """For each run of n words, whether it is of one text."""
        last = max(len(self.start) - n + 1, 0)
        return self.text[n - 1 :] == self.text[:last]

    def runs(self, n: int, which: int = 0) -> np.ndarray:
        """The hash of the n words from each word on."""
        last = max(len(self.start) - n + 1, 0)
        s, sums = self.start[:last], self._sums(which)
        return _mix((sums[self.end[n - 1 :]] - sums[s]) * self.down[which][s])

    def anchors(self, window: int, gram: int) -> np.ndarray:
        """For each window the smallest hash of its runs of ``gram`` words."""
        low = self.runs(gram)
        width, span = window - gram + 1, 1
        while span < width and len(low):
            step = min(span, width - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        return low[: max(len(self.start) - window + 1, 0)]


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOB bytes together."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= BLOB:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _over(work: Callable, columns: list[str], schema: pa.Schema) -> Callable:
    """For mapInArrow: ``work(rows, texts)`` for groups of texts of bounded size; it gives the columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            for a, b in _groups(pc.binary_length(column).to_pylist()):
                found = work([r[a:b] for r in rows], column.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(found, schema, strict=True)], schema=schema)

    return run


def _digests(rows: list[np.ndarray], texts: list[str]) -> tuple:
    words = [t.encode().split() for t in texts]
    digests = [hashlib.sha256(b" ".join(w)).digest() for w in words]
    return rows[0], [int.from_bytes(d[:8], "little", signed=True) for d in digests], digests, [len(w) for w in words]


def _anchors(window: int, gram: int, hot: Broadcast | None) -> Callable:
    """Distinct (h, doc, part) of the anchors that are not among the hot ones."""

    def work(rows: list[np.ndarray], texts: list[str]) -> tuple:
        h = Hashes(texts)
        whole = h.whole(window)
        low, text = h.anchors(window, gram)[whole].view(np.int64), h.text[: len(whole)][whole]
        # an anchor stays the smallest of several windows in a row, so most repeats are neighbours
        new = np.r_[True, (low[1:] != low[:-1]) | (text[1:] != text[:-1])] if len(low) else np.zeros(0, dtype=bool)
        low, text = low[new], text[new]
        if hot is not None and len(hot.value):
            cold = ~np.isin(low, hot.value)
            low, text = low[cold], text[cold]
        return low, rows[0][text], rows[1][text]

    return work


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of h, those whose h two or more documents have.

    The last hash of a batch may go on in the next one. Once two documents have it, its rows leave at once.
    """
    known, held = None, None
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(3)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        h, doc, _ = cols
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        shared = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        shared[0] |= known is not None and h[0] == known
        out = np.repeat(shared, np.diff(np.r_[start, len(h)]))
        known, held = (h[-1], None) if shared[-1] else (None, [x[start[-1] :] for x in cols])
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in cols], names=["h", "doc", "part"])


def _pack(rows: list[np.ndarray], texts: list[str]) -> tuple:
    press = zstandard.ZstdCompressor(level=1)
    return rows[0], rows[1], [press.compress(t.encode()) for t in texts]


def _regions(window: int, gram: int, hot: Broadcast) -> Callable:
    """Of each document, its maximal runs of windows with shared anchors: where they start, and their words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            doc, part, shared = batch["doc"].to_numpy(), batch["part"].to_numpy(), batch["shared"].tolist()
            for a, b in _groups([3 * len(p) for p in batch["packed"]]):
                h = Hashes([open_.decompress(p).decode() for p in batch["packed"].iloc[a:b]])
                low, whole = h.anchors(window, gram).view(np.int64), h.whole(window)
                # an anchor that is shared for one document is shared for all
                some = np.concatenate([hot.value, *(np.asarray(x, dtype=np.int64) for x in shared[a:b] if x is not None)])
                hit = whole & np.isin(low, some)
                edge = np.diff(np.r_[False, hit, False].astype(np.int8))
                first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                cut = np.flatnonzero(np.r_[False, h.text[1:] != h.text[:-1]])  # first words of texts; runs end before them
                text, zero = h.text[first], np.r_[0, cut]
                zero = zero[np.searchsorted(zero, first, side="right") - 1] if len(first) else first
                raw = h.data.tobytes()
                if not len(first):
                    continue
                words = [raw[s:e].decode() for s, e in zip(h.start[first].tolist(), h.end[stop + window - 2].tolist(), strict=True)]
                frame = pd.DataFrame({"at": text, "start": first - zero, "words": words})
                frame = frame.groupby("at", sort=False).agg(list).reset_index()
                at = frame["at"].to_numpy() + a
                yield pd.DataFrame({"doc": doc[at], "part": part[at], "starts": frame["start"], "words": frame["words"]})

    return run


def _windows(window: int, key_bits: int) -> Callable:
    """(k1, k2, doc, part, pos) of each window of the regions: a key of 128 bits, and the word it starts at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = np.uint64(MASK >> (64 - key_bits))
        for batch in batches:
            texts = [w for ws in batch["words"] for w in ws]
            starts = np.concatenate([np.zeros(0, dtype=np.int64), *batch["starts"]]).astype(np.int64)
            row = np.repeat(np.arange(len(batch)), [len(w) for w in batch["words"]])
            doc, part = batch["doc"].to_numpy()[row], batch["part"].to_numpy()[row]
            for a, b in _groups(list(map(len, texts))):
                h = Hashes(texts[a:b])
                whole = h.whole(window)
                k1, k2 = (h.runs(window, i)[whole] for i in (0, 1))
                at = h.text[: len(whole)]
                first = np.searchsorted(h.text, np.arange(b - a))
                pos = (starts[a:b][at] + np.arange(len(at)) - first[at])[whole]
                at = at[whole]
                yield pd.DataFrame(
                    {"k1": (k1 & mask).view(np.int64), "k2": k2.view(np.int64), "doc": doc[a:b][at], "part": part[a:b][at], "pos": pos}
                )

    return run


def _cut(window: int) -> Callable:
    """Runs of windows with one owner and block: the owner's own are reference passages, others are to be checked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                found = np.stack([r.pos, r.owner, r.owner_part, r.block], axis=1).astype(np.int64)
                new = np.r_[True, (found[1:, 0] != found[:-1, 0] + 1) | (found[1:, 1:] != found[:-1, 1:]).any(axis=1)]
                first = np.flatnonzero(new)
                regions = np.asarray(r.starts)
                held: tuple = (-1, [])
                for i, j in zip(first.tolist(), np.r_[first[1:], len(found)].tolist(), strict=True):
                    pos, owner, owner_part, block = found[i].tolist()
                    k = int(np.searchsorted(regions, pos, side="right")) - 1
                    if held[0] != k:
                        held = (k, r.words[k].encode().split(b" "))
                    at, size = pos - int(regions[k]), j - i + window - 1
                    words = b" ".join(held[1][at : at + size]).decode()
                    out.append((owner, owner_part, block, r.doc, r.part, pos, size, words))
            yield pd.DataFrame(out, columns=["owner", "owner_part", "block", "doc", "part", "start", "n", "words"])

    return run


def _match(window: int) -> Callable:
    def run(passages: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton(w.encode().split() for w in passages["passage"].drop_duplicates())
        out, known = [], {}
        for doc, part, start, words in zip(runs["doc"], runs["part"], runs["start"], runs["words"], strict=True):
            if words not in known:
                known[words] = automaton.spans(words.encode().split(), window)
            out += [(doc, part, start + a, start + b) for a, b in known[words]]
        return pd.DataFrame(out, columns=["doc", "part", "start", "stop"]).astype("int64")

    return run


def _remove(texts: bool) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, digests, left = [], [], [], []
            for packed, spans in zip(batch["packed"], batch["spans"], strict=True):
                words = open_.decompress(packed).split()
                keep = np.ones(len(words), dtype=bool)
                for s in spans if spans is not None else ():
                    keep[s["start"] : s["stop"]] = False
                sizes.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k] if removed[-1] else words)
                digests.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    left.append(kept.decode())
            found = {"doc_id": batch["doc"], "n_words": sizes, "n_removed": removed, "kept_sha256": digests}
            yield pd.DataFrame(found | ({"kept": left} if texts else {}))

    return run


def _hot(named: DataFrame, rows: int, window: int, gram: int, sample_docs: int) -> np.ndarray:
    """Anchors that at least 1 in 250 of about ``sample_docs`` documents have; two or more have each, so all are shared.

    They are bounded in number by the sample's size, and need not meet in one task to be counted. Whether an
    anchor is among them changes how it is found to be shared, not the result.
    """
    if rows < 1000:
        return np.zeros(0, dtype=np.int64)
    least = max(8, min(rows, sample_docs) // 250)
    sample = named.sample(min(1.0, sample_docs / rows), seed=5)
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("part", pa.int64())])
    found = sample.mapInArrow(_over(_anchors(window, gram, None), ["doc", "part"], schema), "h long, doc long, part long")
    found = found.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"))
    return np.sort(found.where((F.col("n") >= least) & (F.col("a") < F.col("b"))).select("h").toPandas()["h"].to_numpy(dtype=np.int64))


def substring_dedup(
    docs: DataFrame,
    window: int = 13,
    gram: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_words: int = 100_000,
    group_words: int = 100_000,
    sample_docs: int = 5_000,
    key_bits: int = 64,
    texts: bool = True,
) -> DataFrame:
    """Take out the words of windows that also start in a document with a smaller id.

    doc_id, n_words, n_removed, kept_sha256 (of the kept words, a space between) and, with
    ``texts``, kept. Words lie between 0x20 and 0x09-0x0D; a window is ``window`` words in a row;
    windows are judged on the input.

    Candidates: each window has an anchor, the smallest hash of its runs of ``gram`` words, so equal
    windows have equal anchors. Runs of windows whose anchors occur in several documents are the
    regions; only they go on. A window of a region is known by 64 + ``key_bits`` bits, and its owner is the
    smallest id that has it. References: the owner's runs of windows that others repeat, in blocks
    of BLOCK words, dealt to shards of about ``shard_words`` words; a shard's suffix automaton is built
    where the runs to check arrive, in groups of about ``group_words`` words, so one popular passage is
    spread over many tasks. Maximal spans of ``window`` or more matching words are removed. A document
    whose words are an earlier one's, by SHA-256 and count, is one span as a whole. The reference grows with the
    corpus, so automata are dealt with their shard instead of being broadcast whole.

    A null text has no words. Rows with a null id are left whole and own nothing. Rows that share an id
    are judged each for itself and never against one another. Very long texts are cut into no pieces, but
    hashed about BLOB bytes at a time with others. Empty table: empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    named = base.where("doc is not null")

    schema = pa.schema([("doc", pa.int64()), ("body", pa.int64()), ("digest", pa.binary()), ("n", pa.int64())])
    narrow = stored(named.mapInArrow(_over(_digests, ["doc"], schema), "doc long, body long, digest binary, n long"))
    # rows of one id with different words are told apart by a hash of the words; else ``part`` is zero
    again = narrow.groupBy("doc").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b")
    again = stored(again.select("doc", F.lit(True).alias("again")))
    first = narrow.where(F.col("n") >= window).groupBy("digest", "n").agg(F.min("doc").alias("leader"), F.max("doc").alias("last"))
    first = stored(first.where("leader < last").drop("last"))
    copies = narrow.join(first, ["digest", "n"]).where("doc > leader")
    # where ids repeat, rows are looked into each for itself
    copies = stored(copies.select("doc", "n")).join(again, "doc", "left_anti").distinct()
    copies = copies.select("doc", F.lit(0).cast("long").alias("part"), "n")
    if again.limit(1).count():
        part = F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0))
        named = named.join(again, "doc", "left").select("doc", part.cast("long").alias("part"), "text")
    else:
        named = named.select("doc", F.lit(0).cast("long").alias("part"), "text")

    hot = spark.sparkContext.broadcast(_hot(named, narrow.count(), window, gram, sample_docs))
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("part", pa.int64())])
    anchors = named.mapInArrow(_over(_anchors(window, gram, hot), ["doc", "part"], schema), "h long, doc long, part long")
    shared = anchors.repartition("h").sortWithinPartitions("h").mapInArrow(_shared, "h long, doc long, part long")
    shared = shared.groupBy("doc", "part").agg(F.collect_set("h").alias("shared"))

    schema = pa.schema([("doc", pa.int64()), ("part", pa.int64()), ("packed", pa.binary())])
    packed = named.mapInArrow(_over(_pack, ["doc", "part"], schema), "doc long, part long, packed binary")
    key = ["doc", "part"]
    regions = stored(
        packed.join(shared, key, "left")
        .join(copies.select(*key), key, "left_anti")
        .mapInPandas(_regions(window, gram, hot), "doc long, part long, starts array<int>, words array<string>")
    )
    windows = regions.mapInPandas(_windows(window, key_bits), "k1 long, k2 long, doc long, part long, pos int")
    owners = windows.groupBy("k1", "k2").agg(F.min(F.struct("doc", "part", "pos")).alias("first"), F.max("doc").alias("last"))
    owners = stored(
        owners.where(F.col("first.doc") < F.col("last")).select(
            "k1", "k2", F.col("first.doc").alias("owner"), F.col("first.part").alias("owner_part"), F.col("first.pos").alias("at")
        )
    )
    own = (F.col("doc") == F.col("owner")) & (F.col("part") == F.col("owner_part")) & (F.col("pos") == F.col("at"))
    block = F.floor(F.col("at") / BLOCK).cast("int").alias("block")
    verdict = windows.join(owners, ["k1", "k2"]).where((F.col("doc") > F.col("owner")) | own)
    verdict = verdict.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("pos", "owner", "owner_part", block))).alias("v"))
    verdict = verdict.select(*key, "v.pos", "v.owner", "v.owner_part", "v.block")
    fields = "owner long, owner_part long, block int, doc long, part long, start long, n long, words string"
    cut = stored(regions.join(verdict, key).mapInPandas(_cut(window), fields))

    mine = (F.col("owner") == F.col("doc")) & (F.col("owner_part") == F.col("part"))
    total = cut.where(mine).agg(F.sum("n")).first()[0] or 0
    shards = F.lit(max(1, -(-total // shard_words)))
    sharded = cut.withColumn("shard", F.pmod(F.xxhash64("owner", "owner_part", "block"), shards))
    passages, runs = sharded.where(mine), sharded.where(~mine)
    load = runs.groupBy("shard").agg(F.ceil(F.sum("n") / group_words).alias("groups"))
    each = F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)
    passages = passages.join(load, "shard").select(
        F.col("shard").alias("to_shard"), F.explode(each).alias("to_part"), F.col("words").alias("passage")
    )
    runs = runs.join(load, "shard").withColumn("piece", F.pmod(F.xxhash64("doc", "part", "start"), F.col("groups")))
    runs = runs.select("shard", "piece", "doc", "part", "start", "words")
    spans = (
        passages.groupBy("to_shard", "to_part")
        .cogroup(runs.groupBy("shard", "piece"))
        .applyInPandas(_match(window), "doc long, part long, start long, stop long")
        .union(copies.select("doc", "part", F.lit(0).cast("long"), F.col("n")))
        .groupBy(*key)
        .agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    )
    fields = f"doc_id long, n_words long, n_removed long, kept_sha256 string{', kept string' if texts else ''}"
    zero = F.lit(0).cast("long")
    nameless = base.where("doc is null").select(zero.alias("doc"), zero.alias("part"), "text")
    nameless = nameless.mapInArrow(_over(_pack, key, schema), "doc long, part long, packed binary")
    nameless = nameless.withColumn("spans", F.lit(None).cast("array<struct<start:long,stop:long>>"))
    nameless = nameless.mapInPandas(_remove(texts), fields).withColumn("doc_id", F.lit(None).cast("long"))
    return packed.join(spans, key, "left").mapInPandas(_remove(texts), fields).union(nameless)
