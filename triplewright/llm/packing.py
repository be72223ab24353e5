"""Packing of documents into fixed windows by minimum bin slack."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import text_of

#: Tokens that a task holds before it fills windows from them.
POOL = 1 << 20


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length together come closest to ``room`` without passing it.

    Subset-sum by dynamic programming: bit s of ``reach`` says that a sum s can be made. Copies of
    a length enter as 1, 2, 4, ... at a time; each layer keeps the bits before it, from which the
    counts are traced back.
    """
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            layers.append((length, step, reach))
            reach |= (reach << (length * step)) & mask
            left, step = left - step, step * 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, step, before in reversed(layers):
        if not before >> total & 1:
            total -= length * step
            taken[length] += step
    return dict(taken)


class Packer:
    """Fills the windows of one task; ``out`` gets (document, start, ids, window, offset)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.windows, self.held = capacity, 0, 0
        self.pool: dict[int, list[tuple[int, int, bytes]]] = defaultdict(list)
        self.out: list[tuple[int, int, bytes, int, int]] = []

    def _hold(self, doc: int, start: int, ids: bytes) -> None:
        if ids:
            self.pool[len(ids) // 4].append((doc, start, ids))
            self.held += len(ids) // 4

    def _take(self, length: int) -> tuple[int, int, bytes]:
        stack = self.pool[length]
        piece = stack.pop()
        if not stack:
            del self.pool[length]
        self.held -= length
        return piece

    def _window(self, pieces: list[tuple[int, int, bytes]]) -> None:
        at = 0
        for doc, start, ids in pieces:
            self.out.append((doc, start, ids, self.windows, at))
            at += len(ids) // 4
        self.windows += 1

    def add(self, doc: int, ids: bytes) -> None:
        """Whole windows of a long document leave at once; its rest is held."""
        whole, start = self.capacity * 4, 0
        while len(ids) - start >= whole:
            self._window([(doc, start // 4, ids[start : start + whole])])
            start += whole
        self._hold(doc, start // 4, ids[start:])

    def flush(self, keep: int = 0) -> None:
        """Fill windows until at most ``keep`` tokens are held."""
        while self.held > keep and self.held >= self.capacity:
            first = max(self.pool)
            counts = {n: len(p) for n, p in self.pool.items()}
            counts[first] -= 1
            chosen = fill({n: c for n, c in counts.items() if c}, self.capacity - first)
            chosen[first] = chosen.get(first, 0) + 1
            slack = self.capacity - sum(n * c for n, c in chosen.items())
            times = 1 if slack else min(len(self.pool[n]) // c for n, c in chosen.items())
            for _ in range(times):
                pieces = [self._take(n) for n, c in chosen.items() for _ in range(c)]
                if slack:  # no sum fits: the longest one that is left is cut
                    doc, start, ids = self._take(max(self.pool))
                    pieces.append((doc, start, ids[: slack * 4]))
                    self._hold(doc, start + slack, ids[slack * 4 :])
                self._window(pieces)
        if not keep:
            self._tail()

    def _tail(self) -> None:
        """What no window is full of goes to sequences of a power of two tokens, which need no padding."""
        size = 1 << (self.held.bit_length() - 1) if self.held else 0
        pieces: list[tuple[int, int, bytes]] = []
        room = size
        while self.held:
            doc, start, ids = self._take(max(self.pool))
            pieces.append((doc, start, ids[: room * 4]))
            self._hold(doc, start + room, ids[room * 4 :])
            room -= len(pieces[-1][2]) // 4
            if not room:
                self._window(pieces)
                pieces, room = [], 1 << (self.held.bit_length() - 1) if self.held else 0


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids (u32 little-endian), doc_tokens, sequence_id, offset.

    Every document becomes its token ids and ``end_id``; its whole windows of ``capacity`` tokens
    become sequences of their own, and what is left over is packed with the rests of other
    documents of the same input partition, so nothing is shuffled and a task holds a bounded pool.
    Each window takes the longest rest and the set of others that comes closest to filling it;
    slack is filled by cutting one more rest. At the end of a partition fewer than ``capacity``
    tokens are left; they go to sequences of 2**k tokens, at most one for each k.

    A null or empty text is a document of ``end_id`` alone. Repeated rows and null ids are
    documents like any other. An empty table gives no pieces. Other columns, whatever their names, are not read.
    """
    end = end_id.to_bytes(4, "little")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = bpe.load(path), Packer(capacity)
        base = TaskContext.get().partitionId() << 40
        ids_of: dict[int, tuple] = {}
        count, id_type = 0, pa.null()

        def rows() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            doc, start, ids, window, offset = zip(*out, strict=True) if out else ([], [], [], [], [])
            columns = {
                "doc_id": pa.array([ids_of[d][0] for d in doc], type=id_type),
                "start": pa.array(start, pa.int64()),
                "length": pa.array([len(i) // 4 for i in ids], pa.int64()),
                "ids": pa.array(ids, pa.binary()),
                "doc_tokens": pa.array([ids_of[d][1] for d in doc], pa.int64()),
                "sequence_id": pa.array([base + w for w in window], pa.int64()),
                "offset": pa.array(offset, pa.int64()),
            }
            held = {p[0] for stack in packer.pool.values() for p in stack}
            for d in [d for d in ids_of if d not in held]:
                del ids_of[d]
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            id_type = batch.column("doc_id").type
            for at, n in bpe.grouped(texts):
                for name, ids in zip(names[at : at + n], encoder.encode(texts.slice(at, n).to_pylist()), strict=True):
                    ids_of[count] = (name, len(ids) // 4 + 1)
                    packer.add(count, ids + end)
                    count += 1
                packer.flush(POOL)
                if packer.out:
                    yield rows()
        packer.flush()
        if packer.out:
            yield rows()

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(
        run,
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
