"""SimHash near-duplicates by a grid range-join of per-segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, stored, text_of
from .components import components, roots

#: Every second bit; a segment is two bits, and its count 0, 1 or 2 takes their place.
LOW_BITS = 0x5555555555555555
#: Most fingerprints of a grid cell that meet in one piece; larger cells are cut into tiles.
TILE = 1024
#: Shingles whose bits are counted at once.
BLOCK = 200_000
#: Tiles of up to so many points are compared pair by pair at once; in larger ones, leader by leader.
SMALL = 256


def shingles_of(text: str, words: int) -> list[bytes]:
    """ASCII letters in lower case; words between 0x20 and 0x09-0x0D; ``words`` of them joined by a space, or all of a shorter text."""
    w = text.encode().lower().split()
    if len(w) < words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Another 64 bits for each hash."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def fingerprints_of(texts: list[str], words: int = 3, lanes: int = 1) -> np.ndarray:
    """The fingerprint of each text: ``lanes`` columns of 64 bits.

    A bit is set if set in over half the shingles' hashes: XXH64 (seed 42), for further lanes mixed on. No words: zero.
    """
    from xxhash import xxh64_intdigest

    sizes, hashes, out = [], [], np.zeros((len(texts), lanes), dtype=np.uint64)

    def counted() -> None:
        starts, half = np.cumsum([0, *sizes[:-1]]), np.array(sizes)[:, None]
        whole = np.array(hashes, dtype="<u8")
        for lane in range(lanes):
            total = np.zeros((len(sizes), 64), dtype=np.int64)
            for at in range(0, len(whole), BLOCK):
                part = whole[at : at + BLOCK]
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                live = np.flatnonzero((starts < at + len(part)) & (starts + sizes > at))
                total[live] += np.add.reduceat(bits, np.maximum(starts[live] - at, 0), axis=0, dtype=np.int64)
            out[places, lane] = np.packbits((total * 2 > half).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()
            whole = _mixed(whole) if lane + 1 < lanes else whole

    places = []
    for i, text in enumerate(texts):
        found = shingles_of(text, words)
        if not found:
            continue
        hashes.extend([xxh64_intdigest(s, 42) for s in found])
        sizes.append(len(found))
        places.append(i)
        if len(hashes) >= BLOCK:
            counted()
            places, sizes, hashes = [], [], []
    if places:
        counted()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, lanes: int = 1) -> DataFrame:
    """doc_id, body (a digest of the whole text) and fingerprint (``fp``, ``fp2``...: signed longs) of each row."""
    names = ["fp", *(f"fp{i}" for i in range(2, lanes + 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for at in range(0, len(text), 1000):
                found = fingerprints_of(text.slice(at, 1000).to_pylist(), words, lanes).view(np.int64)
                columns = [batch.column(c).slice(at, 1000) for c in ("doc_id", "body")]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, found.T.copy())], names=["doc_id", "body", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), body_of(text_col), text_of(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, body binary, " + ", ".join(f"{n} long" for n in names))


def body_of(text_col: str) -> Column:
    return F.unhex(F.md5(text_of(text_col).cast("binary"))).alias("body")


def masks(radius: int, free: int) -> list[int]:
    """Bit masks of the grid's tables.

    The 32 segments form radius + free groups. Two fingerprints within ``radius`` have bit counts
    within ``radius`` in Manhattan distance, so at least ``free`` groups agree in all counts; there
    is a table for each choice of so many groups.
    """
    groups = np.array_split(np.arange(32), radius + free)
    mask = [sum(3 << 2 * int(s) for s in g) for g in groups]
    return [sum(c) for c in combinations(mask, free)]


def counts_of(x: np.ndarray) -> np.ndarray:
    """The embedding: in place of each two-bit segment, how many of its bits are set."""
    return x - ((x >> np.uint64(1)) & np.uint64(LOW_BITS))


def near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which fingerprints are within ``radius``: first by the bound that their bit counts give, then exactly."""
    z = counts_of(x) ^ counts_of(y)
    low, high = z & np.uint64(LOW_BITS), (z >> np.uint64(1)) & np.uint64(LOW_BITS)
    bound = np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)
    close = bound <= radius
    close &= np.bitwise_count(x ^ y) <= radius
    return close


def _stars(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that hold together what is linked among the fingerprints of one cell or tile."""
    a, b = [], []
    close = np.concatenate([near(x[i : i + 256, None], x[None, :], radius) for i in range(0, len(x), 256)])
    open_ = close.sum(axis=1) > 1
    while open_.any():
        start = int(np.argmax(open_))
        inside = np.zeros(len(x), dtype=bool)
        front = np.array([start])
        inside[start] = True
        while len(front):
            fresh = close[front].any(axis=0) & ~inside
            inside |= fresh
            front = np.flatnonzero(fresh)
        open_ &= ~inside
        inside[start] = False
        b.append(x[inside])
        a.append(np.full(len(b[-1]), x[start]))
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _tiles(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Of rows in the order of the key, whole tiles, some thousand rows at a time."""
    held: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = (rows[key] != rows[key].iloc[-1]).any(axis=1).to_numpy() if len(rows) else np.zeros(0, dtype=bool)
        stop = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        held = rows.iloc[stop:]
        if stop:
            yield rows.iloc[:stop]
    if held is not None and len(held):
        yield held


def _starts(rows: pd.DataFrame, key: list[str]) -> tuple[np.ndarray, np.ndarray]:
    values = rows[key].to_numpy()
    starts = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(axis=1)])
    return starts, np.diff(np.r_[starts, len(rows)])


TILE_KEY = ["table", "cell", "i", "j"]


def _links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _tiles(batches, TILE_KEY):
            rows = rows.drop_duplicates()
            x = rows["fp"].to_numpy().view(np.uint64)
            starts, sizes = _starts(rows, TILE_KEY)
            group = np.repeat(np.arange(len(starts)), sizes)
            a, b = [], []
            small = np.repeat(sizes <= 64, sizes)
            for shift in range(1, min(64, int(sizes.max()))):
                at = np.flatnonzero(small[:-shift] & (group[:-shift] == group[shift:]))
                if not len(at):
                    continue
                at = at[near(x[at], x[at + shift], radius)]
                a.append(x[at])
                b.append(x[at + shift])
            for start, size in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
                left, right = _stars(x[start : start + size], radius)
                a.append(left)
                b.append(right)
            if a:
                edges = pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})
                yield edges.drop_duplicates()

    return run


def _tiled(cells: DataFrame, name: str) -> DataFrame:
    """Rows of (table, cell) dealt to tiles; cells of more than TILE rows are cut into blocks, each pair of which is one."""
    size = cells.groupBy("table", "cell").count().where(F.col("count") > TILE)
    # written, so that the few large cells are broadcast and the others need not be dealt twice
    blocks = stored(size.select("table", "cell", F.ceil(F.col("count") / TILE).alias("blocks")))
    cells = cells.join(blocks, ["table", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(name), F.col("blocks"))
    cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "blocks")
    return cells.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)


def _counts_of(fp: str) -> Column:
    """The embedding, as a column."""
    high = F.shiftrightunsigned(fp, 1)
    one = F.col(fp).bitwiseXOR(high).bitwiseAND(F.lit(LOW_BITS))
    two = F.col(fp).bitwiseAND(high).bitwiseAND(F.lit(LOW_BITS))
    return one.bitwiseOR(F.shiftleft(two, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(points: DataFrame, radius: int = 3, free: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that join all within ``radius`` of each other.

    Grid range-join: each fingerprint enters a cell of every table, keyed by its bit counts in the
    table's groups of segments. Cells of more than TILE fingerprints are cut into blocks, and each
    pair of blocks is a tile of its own. Of a dense cell a star leaves, not all pairs. More ``free``
    groups make more tables with finer cells, for larger inputs.
    """
    signed = [_signed(m) for m in masks(radius, free)]
    table = F.posexplode(F.array(*[F.col("p").bitwiseAND(F.lit(m)) for m in signed])).alias("table", "cell")
    cells = points.select("fp", _counts_of("fp").alias("p")).select("fp", table)
    return _tiled(cells, "fp").mapInPandas(_links(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    radius: int = 3,
    free: int = 2,
) -> DataFrame:
    """doc_id, body, fingerprint (16 hex digits), component_id, keep for each row.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest id that
    links reach from the row, itself included. ``keep`` marks the rows of one id and text in each
    component: the smallest id, then the smallest body. Null text: empty; texts without words
    share fingerprint zero. A null id never beats another; a component of null ids alone has a null component_id. Repeated rows
    are all returned. Empty table: empty result. Other columns are not read.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, words))
    points = materialize(
        marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "body")).alias("first"))
    )
    roots = components(links(points.select("fp"), radius, free))
    member = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    member = materialize(member.select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    lead = member.groupBy("root").agg(F.min("first").alias("lead"))
    of = member.join(lead, "root").select("fp", "lead")
    return marked.join(of, "fp").select(
        "doc_id",
        "body",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("lead.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("body") == F.col("lead.body"))).alias("keep"),
    )


# ---- five-word shingles at a similarity of 0.8


def samples(tables: int, segments: int, lanes: int = 2, seed: int = 17) -> list[list[int]]:
    """For each table a mask per lane that covers ``segments`` two-bit segments picked at random."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        found = [0] * lanes
        for s in rng.choice(32 * lanes, segments, replace=False).tolist():
            found[s // 32] |= 3 << 2 * (s % 32)
        out.append(found)
    return out


def _within(x: np.ndarray, y: np.ndarray, counts_x: np.ndarray, counts_y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two lanes are within ``radius``, by the bound of their counts and then exactly, and how far they are."""
    z = counts_x ^ counts_y
    low, high = z & np.uint64(LOW_BITS), (z >> np.uint64(1)) & np.uint64(LOW_BITS)
    bound = np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)
    close = np.flatnonzero(bound[:, 0] + bound[:, 1] <= radius)
    far = np.bitwise_count(x[close] ^ (y if len(y) == 1 else y[close]))
    far = far[:, 0] + far[:, 1]
    return close[far <= radius], far[far <= radius]


def _mated(x: np.ndarray, counts: np.ndarray, group: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Which points may have another within ``radius`` in their tile; in tiles of over SMALL points all may."""
    small = np.repeat(sizes <= SMALL, sizes)
    mated, at = ~small, np.flatnonzero(small)
    for shift in range(1, SMALL):
        at = at[at + shift < len(x)]
        at = at[group[at] == group[at + shift]]
        if not len(at):
            break
        close, _ = _within(x[at], x[at + shift], counts[at], counts[at + shift], radius)
        mated[at[close]] = mated[at[close] + shift] = True
    return mated


def _leaders(radius: int):
    """In each tile the first point that has none yet leads all within the radius; a pair for each leader of a point."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _tiles(batches, TILE_KEY):
            rows = rows.drop_duplicates()
            x = np.stack([rows["fp"].to_numpy(), rows["fp2"].to_numpy()], axis=1).view(np.uint64)
            ids, table, found = rows["point"].to_numpy(), rows["table"].to_numpy(), []
            counts = counts_of(x)
            _, sizes = _starts(rows, TILE_KEY)
            group = np.repeat(np.arange(len(sizes)), sizes)
            # most points of small tiles are alone there: all are compared at once, and no leader is sought for these
            left = np.flatnonzero(_mated(x, counts, group, sizes, radius))
            for inside in np.split(left, np.flatnonzero(np.diff(group[left])) + 1):
                if len(inside) < 2:
                    continue
                # another order in each table, so that other points lead; of the fingerprints alone, so that a task done again finds the same
                inside = inside[np.argsort(_mixed(x[inside, 0] ^ _mixed(x[inside, 1]) ^ np.uint64(int(table[inside[0]]))))]
                y, c, free = x[inside], counts[inside], np.ones(len(inside), dtype=bool)
                for k in range(len(inside)):
                    if not free[k]:
                        continue
                    close, far = _within(y, y[k : k + 1], c, c[k : k + 1], radius)
                    free[close] = False
                    other = close != k
                    found.append((np.full(int(other.sum()), ids[inside[k]]), ids[inside[close[other]]], far[other]))
            if found:
                a, b, far = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "far": far.astype(np.int32)}).drop_duplicates()

    return run


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            found = [np.unique(np.array([xxh64_intdigest(s, 42) for s in set(shingles_of(t, words))], dtype="<u8")).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"point": batch["point"], "shingles": found})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, also: list[str] = []) -> DataFrame:  # noqa: B006
    """The pairs (a, b and the long columns ``also``) whose sets of shingles have at least that Jaccard similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for s, t in zip(batch["s"], batch["t"], strict=True):
                s, t = np.frombuffer(s, dtype="<u8"), np.frombuffer(t, dtype="<u8")
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both >= similarity * (len(s) + len(t) - both))
            yield batch.loc[keep, ["a", "b", *also]]

    of = lambda end, name: sets.select(F.col("point").alias(end), F.col("shingles").alias(name))
    both = pairs.select("a", "b", *also).join(of("a", "s"), "a").join(of("b", "t"), "b")
    return both.mapInPandas(run, ", ".join(f"{c} long" for c in ["a", "b", *also]))


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    radius: int = 30,
    tables: int = 64,
    segments: int = 10,
) -> DataFrame:
    """doc_id, body, keep for each row: near-duplicates by shingles of ``words`` words and their Jaccard ``similarity``.

    Fingerprints have 128 bits; texts at a similarity of 0.8 differ in some 19 of them, standard deviation 4. A
    table of the grid joins fingerprints that agree in the bit counts of ``segments`` random segments; in a cell those
    within ``radius`` of a leader are candidates, first by the Manhattan distance of counts, then exactly. Candidates count only
    if the shingles themselves reach the similarity: first each point's closest one, then those that
    lie in different groups still. Groups are the components of the links; ``keep`` marks the rows
    of one id and text in each. ``segments`` grows with the logarithm of the table, and ``tables`` with it, to keep cells small.

    Rows of equal fingerprints count as one text. Null text: empty; texts without words are alike. A null id never beats
    another. Repeated rows are all returned. Empty table: empty result. Other columns are not read.
    """
    marked = stored(fingerprints(docs, id_col, text_col, words, 2))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "body")).alias("first")
    points = stored(marked.groupBy("fp", "fp2").agg(first).withColumn("point", F.monotonically_increasing_id()))
    chosen = samples(tables, segments)
    cell = [F.hash(*[F.col(p).bitwiseAND(F.lit(_signed(m))) for p, m in zip(("p", "p2"), pair, strict=True)]) for pair in chosen]
    cells = points.select("point", "fp", "fp2", _counts_of("fp").alias("p"), _counts_of("fp2").alias("p2"))
    cells = cells.select("point", "fp", "fp2", F.posexplode(F.array(*cell)).alias("table", "cell"))
    pairs = stored(_tiled(cells, "point").mapInPandas(_leaders(radius), "a long, b long, far int").distinct())

    involved = pairs.select(F.col("a").alias("point")).union(pairs.select("b")).distinct().join(points, "point")
    involved = stored(involved.select("point", F.col("first.doc_id").alias("of"), F.col("first.body").alias("of_body")))
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), body_of(text_col), text_of(text_col).alias("text"))
    texts = named.join(involved, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("body") == F.col("of_body")))
    sets = stored(texts.select("point", "text").mapInPandas(_sets(words), "point long, shingles binary").dropDuplicates(["point"]))
    closest = pairs.groupBy("b").agg(F.min(F.struct("far", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    # a pair's a is the smaller, so that the closest ones make a forest
    tree = roots(_verified(closest, sets, similarity).select(F.col("b").alias("node"), F.col("a").alias("root")))
    root = lambda end: tree.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    rest = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    rest = rest.withColumns({"a_root": F.coalesce("a_root", "a"), "b_root": F.coalesce("b_root", "b")}).where("a_root <> b_root")
    # groups of trees: a link between two counts as one between their roots
    links = _verified(rest, sets, similarity, ["a_root", "b_root"])
    groups = components(links.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    member = points.join(tree.select(F.col("node").alias("point"), F.col("root").alias("of")), "point", "left")
    member = member.withColumn("of", F.coalesce("of", "point")).join(groups.withColumnRenamed("node", "of"), "of", "left")
    member = stored(member.select("fp", "fp2", F.coalesce("root", "of").alias("root"), "first"))
    lead = member.groupBy("root").agg(F.min("first").alias("lead"))
    of = member.join(lead, "root").select("fp", "fp2", "lead")
    same = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("body") == F.col("lead.body"))
    return marked.join(of, ["fp", "fp2"]).select("doc_id", "body", same.alias("keep"))
