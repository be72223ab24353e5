"""Phrase collocations: Rabin-Karp fingerprints of word sequences, counted by shuffle, verified against the text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .rolling import Powers, mixed, prefixes

#: Bytes that end a piece, and those between words; each is one byte of UTF-8 and never part of another character.
BREAKS, BLANKS = b".,;:!?\n\x0b\f\r", b" \t"
#: Bytes of text that are hashed at once, and word sequences that are counted together in a task.
SLICE, TOGETHER = 1 << 18, 1 << 21
#: Bits of a sieve at most: 16 MB, whatever the corpus.
MOST_BITS = 1 << 27

_rng = np.random.Generator(np.random.PCG64(20))
#: What a byte counts in the two polynomials; A-Z count as a-z.
VALUES = _rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
VALUES[:, 65:91] = VALUES[:, 97:123]
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(BREAKS)] = 1, 2

COUNTED = "size int, fp long, n long, low int, high int, at long"


class Words:
    """The words of a slice of texts: byte ranges, piece and document of each, and two hashes."""

    def __init__(self, body: np.ndarray, bounds: np.ndarray, powers: Powers) -> None:
        kind = KIND[body]
        first = np.zeros(len(body) + 1, bool)
        first[bounds] = True  # documents meet without a byte between
        word = kind == 0
        before = np.r_[False, word[:-1]] & ~first[:-1]
        after = np.r_[word[1:], False] & ~first[1:]
        self.start, self.stop = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.piece = np.cumsum((kind == 2) | first[:-1], dtype=np.int64)[self.start]
        self.doc = np.searchsorted(bounds, self.start, "right") - 1
        _, down = powers.upto(len(body) + 1)
        size = (self.stop - self.start).astype(np.uint64)
        self.hash = []
        for values in VALUES:
            at = prefixes(values[body], powers)
            self.hash.append(mixed((at[self.stop] - at[self.start]) * down[self.start] + size))

    def grams(self, size: int, lang: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, fingerprint, check) of each ``size`` words in a row within a piece; ``lang``: a hash for each word."""
        n = len(self.start)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        at = np.flatnonzero(self.piece[: n - size + 1] == self.piece[size - 1 :])
        _, down = powers.upto(n + 1)
        found = []
        for hashes in self.hash:
            sums = prefixes(hashes, powers)
            found.append(mixed(((sums[at + size] - sums[at]) * down[at]) ^ lang[at] ^ mixed(np.uint64([size]))))
        return at, found[0], (found[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def lang_hashes(langs: list[str]) -> np.ndarray:
    """A hash for each language name."""
    powers = Powers()
    known = {x: mixed(prefixes(VALUES[1][np.frombuffer(b"\0" + x.encode() + b"\0", np.uint8)], powers)[-1:])[0] for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(bytes, where each document starts in them, row of each, hash of its language, languages) of whole documents, about SLICE bytes at once.

    ``batch``: at, lang, text without nulls. A longer document comes in slices of its own, cut where a piece ends.
    """
    texts = batch.column(2).cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    langs = batch.column(1).to_pylist()
    hashes = lang_hashes(langs)
    i = 0
    while i < len(texts):
        if bounds[i + 1] - bounds[i] > SLICE:
            own, at = body[bounds[i] : bounds[i + 1]], 0
            cuts = np.r_[np.flatnonzero(KIND[own] == 2) + 1, len(own)]
            while at < len(own):
                to = int(cuts[max(np.searchsorted(cuts, at + SLICE, "right") - 1, np.searchsorted(cuts, at, "right"))])
                yield own[at:to], np.zeros(1, np.int64), np.array([i]), hashes[i : i + 1], langs
                at = to
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE, "right")) - 1)
        rows = np.arange(i, j)[np.diff(bounds[i : j + 1]) > 0]
        if len(rows):
            yield body[bounds[i] : bounds[j]], bounds[rows] - bounds[i], rows, hashes[rows], langs
        i = j


def passes(sieve: np.ndarray | None, fps: np.ndarray) -> np.ndarray:
    """Which fingerprints a sieve lets through; it may let others through, never hold back one of its own."""
    if sieve is None:
        return np.ones(len(fps), bool)
    bits, out = np.uint64(len(sieve) * 64 - 1), np.ones(len(fps), bool)
    for shift in (0, 27):
        p = (fps >> np.uint64(shift)) & bits
        out &= (sieve[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def sieve_of(fps: DataFrame) -> np.ndarray:
    """A Bloom filter of the column fp, two bits each, 16 bits or more to each of them up to MOST_BITS in all."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (16 * fps.count()).bit_length()))
    places = fps.select(F.explode(F.array(*[F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 27)])).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    found = words.toArrow()  # MOST_BITS / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _counted(sizes: tuple[int, ...], sieve: Broadcast | None, bits: int) -> Callable:
    """Rows of COUNTED for the word sequences of a task's texts, summed as far as they are together.

    Of a sequence, its first and last part (a word less) must pass the sieve. Size 0 stands for a language and counts its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, waiting = Powers(), [], 0
        names = ["size", "fp", "n", "low", "high", "at"]
        width = np.uint64((1 << bits) - 1)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            for size in sorted({h[0] for h in held}):
                mine = [h for h in held if h[0] == size]
                held[:] = [h for h in held if h[0] != size]

                def column(k: int, mine: list = mine) -> np.ndarray:
                    return np.concatenate([h.pop(k) for h in mine])  # one is whole at a time

                at, check, n, fp = column(4), column(3), column(2) if size == 0 else None, column(1)
                if not len(fp):
                    continue
                order = np.argsort(fp, kind="stable")
                fp = fp[order]
                edge = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
                fp = fp[edge].view(np.int64)
                n = np.diff(np.r_[edge, len(order)]) if n is None else np.add.reduceat(n[order], edge)
                check = check[order]
                low, high = np.minimum.reduceat(check, edge), np.maximum.reduceat(check, edge)
                at = np.minimum.reduceat(at[order], edge)
                del check, order
                rows = (np.full(len(edge), size, np.int32), fp, n, low, high, at)
                for k in range(0, len(edge), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 65536]) for c in rows], names)
            held.clear()
            waiting = 0

        for batch in batches:
            ats = batch.column(0).to_numpy()
            for body, bounds, rows, langs, _ in slices(batch):
                words = Words(body, bounds, powers)
                if not len(words.start):
                    continue
                lang, doc_at = langs[words.doc], ats[rows]
                for size in sizes:
                    if size == 0:
                        n = np.bincount(words.doc, minlength=len(rows))
                        held.append([0, mixed(langs), n, (langs >> np.uint64(32)).astype(np.uint32).view(np.int32), doc_at])
                        continue
                    first, fp, check = words.grams(size, lang, powers)
                    if sieve is not None and len(first):
                        part_at, part, _ = words.grams(size - 1, lang, powers)
                        where = np.zeros(len(words.start) + 1, bool)
                        where[part_at] = passes(sieve.value, part & width)
                        live = where[first] & where[first + 1]
                        first, fp, check = first[live], fp[live], check[live]
                    held.append([size, fp & width, None, check, doc_at[words.doc[first]]])
                    waiting += len(fp)
                if waiting >= TOGETHER:
                    yield from flush()
        yield from flush()

    return run


def _materialised(bits: int) -> Callable:
    """(size, fp, lang, phrase, check) of the wanted fingerprints in each document: columns at, lang, text, wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, width = Powers(), np.uint64((1 << bits) - 1)
        for batch in batches:
            wanted = batch.column(3)  # read document by document: lists of dicts take many times the memory
            for body, bounds, rows, hashes, langs in slices(batch):
                words, out = Words(body, bounds, powers), []
                lang = hashes[words.doc]
                by_size: dict[int, tuple[list, list]] = {}
                for d, r in enumerate(rows):
                    for w in wanted[int(r)].as_py():
                        if w["size"] == 0:
                            if int(mixed(hashes[d : d + 1]).view(np.int64)[0]) == w["fp"]:
                                out.append((0, w["fp"], langs[r], "", int((hashes[d] >> np.uint64(32)).astype(np.uint32).view(np.int32))))
                        else:
                            fps, docs = by_size.setdefault(w["size"], ([], []))
                            fps.append(w["fp"])
                            docs.append(d)
                raw = body.tobytes()
                for size, (fps, docs) in by_size.items():
                    first, fp, check = words.grams(size, lang, powers)
                    fp = (fp & width).view(np.int64)
                    asked = np.sort(mixed(np.array(fps, np.int64).view(np.uint64)) + np.array(docs, np.uint64))
                    mine = mixed(fp.view(np.uint64)) + words.doc[first].astype(np.uint64)
                    at = np.searchsorted(asked, mine)
                    hit = np.flatnonzero(asked[np.minimum(at, len(asked) - 1)] == mine)
                    seen = np.unique(np.stack([mine[hit], check[hit].view(np.uint32).astype(np.uint64)], 1), axis=0, return_index=True)[1]
                    for k in hit[seen]:
                        i = first[k]
                        phrase = b" ".join(raw[words.start[i + j] : words.stop[i + j]] for j in range(size)).lower()
                        out.append((size, int(fp[k]), langs[rows[words.doc[i]]], phrase.decode(), int(check[k])))
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["size", "fp", "lang", "phrase", "check"])

    return run


def _recounted(sieve: Broadcast, most_words: int, bits: int) -> Callable:
    """(size, fp, lang, phrase, n) of every sequence whose fingerprint passes a sieve, by its words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, width = Powers(), np.uint64((1 << bits) - 1)
        for batch in batches:
            for body, bounds, rows, hashes, langs in slices(batch):
                words, found = Words(body, bounds, powers), {}
                raw, lang = body.tobytes(), hashes[words.doc]
                for size in range(1, most_words + 1):
                    first, fp, _ = words.grams(size, lang, powers)
                    for k in np.flatnonzero(passes(sieve.value, fp & width)):
                        i = first[k]
                        phrase = b" ".join(raw[words.start[i + j] : words.stop[i + j]] for j in range(size)).lower()
                        key = size, int((fp[k] & width).view(np.int64)), langs[rows[words.doc[i]]], phrase.decode()
                        found[key] = found.get(key, 0) + 1
                if found:
                    cols = [*zip(*found, strict=True), list(found.values())]
                    kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["size", "fp", "lang", "phrase", "n"])

    return run


def frequent_phrases(
    docs: DataFrame, most_words: int = 3, least: int = 10, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", bits: int = 64
) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, size, phrase, n of each phrase of up to ``most_words`` words that occurs ``least`` times; lang, n.

    Sizes are counted one after the other: a sequence is counted only if both its parts of one word
    less may be frequent, as a Bloom filter of bounded size tells. Each count carries the document of
    an occurrence. There the words are read, with a second hash that all occurrences must share;
    fingerprints that don't are counted again by their words. ``bits`` narrows fingerprints for tests.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.xxhash64(text)).alias("at"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        text.alias("text"),
    )
    kept, sieve, got = [], None, None
    for size in range(1, most_words + 1):
        rows = base.mapInArrow(_counted((0, 1) if size == 1 else (size,), sieve, bits), COUNTED)
        found = rows.groupBy("size", "fp").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("at").alias("at"))
        got = stored(found.where((F.col("n") >= least) | (F.col("size") == 0)))
        kept.append(got)
        if size < most_words:
            sieve = spark.sparkContext.broadcast(sieve_of(got.where("size > 0").select("fp")))
    counted = kept[0]
    for part in kept[1:]:
        counted = counted.unionByName(part)
    wanted = counted.groupBy("at").agg(F.collect_list(F.struct("size", "fp")).alias("wanted"))
    held = base.join(wanted, "at").select("at", "lang", "text", "wanted")
    read = held.mapInArrow(_materialised(bits), "size int, fp long, lang string, phrase string, check int").distinct()
    sure = (F.col("low") == F.col("high")) & (F.col("check") == F.col("low"))
    rows = read.join(counted.drop("at"), ["size", "fp"]).withColumn("sure", sure)
    rows = stored(rows.groupBy("size", "fp").agg(F.count("*").alias("texts"), F.every("sure").alias("sure"), F.min_by("lang", "phrase").alias("lang"), F.min("phrase").alias("phrase"), F.max("n").alias("n")))
    good = rows.where("sure and texts = 1")
    mixed_up = rows.where("not (sure and texts = 1) and size > 0").select("size", "fp")
    phrases = good.where("size > 0").select("lang", "size", "phrase", "n")
    if not mixed_up.isEmpty():
        sieve = spark.sparkContext.broadcast(sieve_of(mixed_up.select("fp")))
        again = base.mapInArrow(_recounted(sieve, most_words, bits), "size int, fp long, lang string, phrase string, n long")
        again = again.groupBy("size", "fp", "lang", "phrase").agg(F.sum("n").alias("n")).join(mixed_up, ["size", "fp"], "left_semi")
        phrases = phrases.unionByName(again.where(F.col("n") >= least).select("lang", "size", "phrase", "n"))
    return phrases, good.where("size = 0").select("lang", "n")


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, share: int = 50, most: int = 2000, **columns: object) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of each language whose words belong together most.

    Text is lower-cased in A-Z and cut at ``.,;:!?`` and line ends into pieces, these at blanks into
    words. ``a`` counts a phrase of 2 to ``most_words`` words that occurs ``least`` times or more; cut
    in two, ``l`` and ``r`` count its parts, ``n`` all words, and the score is floor(10**6 * a * a / (l * r))
    of the worst cut (ties: the first). A phrase goes if a longer one that holds it occurs in
    ``share`` percent of its places. Of each language the ``most`` best stay, ties by a, then phrase.
    Counts must stay under 10**16.

    A null language counts as und; a null text is empty, so that it and an empty one have no words.
    Very long texts are read whole, slice by slice. Repeated rows count as often as they occur; a
    null id is no hindrance. Empty table: empty result. Other columns are not read.
    """
    phrases, totals = frequent_phrases(docs, most_words, least, **columns)
    phrases = stored(phrases.withColumn("w", F.split("phrase", " ", -1)))
    longer = phrases.where("size > 2").select(
        "lang", F.col("n").alias("by"), F.explode(F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> array_join(slice(w, i, k), ' '))))")).alias("phrase")
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    own = phrases.where("size > 1").join(longer, ["lang", "phrase"], "left")
    own = own.where(~F.coalesce(F.col("by") * 100 >= F.col("n") * share, F.lit(False)))
    cut = own.select("lang", "phrase", F.col("n").alias("a"), "w", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("one"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("two"))
    count = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cut = cut.join(count("one", "l"), ["lang", "one"]).join(count("two", "r"), ["lang", "two"])
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    product = lambda x, y: (x * y).cast("decimal(38,0)")
    top = product(product(whole("a"), whole("a")), F.lit(1000000).cast("decimal(38,0)"))
    scored = cut.withColumns({"__top": top, "__low": product(whole("l"), whole("r"))}).withColumn("score", F.expr("__top div __low"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    rows = best.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).join(totals, "lang")
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
