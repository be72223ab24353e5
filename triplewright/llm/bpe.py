"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Larger than any rank * width + position.
NONE = np.iinfo(np.int64).max
#: Different pieces of text whose encoding a worker remembers.
CACHE = 500_000
#: Words of a width below which, and width above which, each word is merged by itself.
FEW, LONG = 16, 256
#: The UTF-8 bytes with which characters from U+0300 on begin: marks that combine, case that depends on neighbours.
FAR = 0xCC
HIGH = bytes(range(FAR, 256))


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """Byte pair encoding of words with an end mark, from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end, letters = model["vocab"], model["end_of_word_suffix"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split)
        # Characters from U+0300 on are normalised and split by the tables of the library itself: Unicode versions differ.
        small = spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}  # its normaliser alone
        self.far, self.normal = Split(Regex(split), "removed", invert=True), Tokenizer.from_str(json.dumps(small)).normalizer
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left << 20 | right
        self.rank_of = np.argsort(keys, kind="stable")
        self.rank_by_pair = {k: i for i, k in enumerate(keys.tolist())}
        self.pair_keys = keys[self.rank_of]
        words = dict(vocab) | self.special
        self.names = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.names[i] = word.encode()
        self.known: dict[bytes, bytes] = {}
        self.shown: dict[bytes, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
        """Leaf values: rank * width + position, so that the smallest is the leftmost lowest rank."""
        key = left << 20 | right
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.rank_of[i] * width + at, NONE)

    def _merge(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has.

        raw: a row of bytes per word, as wide as a power of two. Each word has a tree of 2 * width
        nodes; all words take their next merge at the same time.
        """
        n, width = raw.shape
        rows, place = np.arange(n), np.arange(width)
        ids = self.inner[raw]
        ids[rows, size - 1] = self.final[raw[rows, size - 1]]
        alive = place[None, :] < size[:, None]
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        if width > 1:
            live = alive[:, 1:]
            leaves = np.full((n, width - 1), NONE)
            at = np.broadcast_to(place[:-1], live.shape)[live]
            leaves[live] = self._ranks(ids[:, :-1][live], ids[:, 1:][live], width, at)
            tree[:, width : 2 * width - 1] = leaves
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        flat = tree.reshape(-1)

        def point(r: np.ndarray, at: np.ndarray, value) -> None:
            """Set one leaf of each of some words and the nodes above it."""
            base, node = r * (2 * width), at + width
            flat[base + node] = value
            left = width
            while left > 1:
                pair = base + (node & -2)
                node, left = node >> 1, left >> 1
                flat[base + node] = np.minimum(flat[pair], flat[pair + 1])

        r = rows[tree[:, 1] < NONE] if width > 1 else rows[:0]
        while len(r):
            root = tree[r, 1]
            rank, at = root // width, root % width
            gone = after[r, at]
            new, then, prior = self.merged[rank], after[r, gone], before[r, at]
            ids[r, at] = new
            alive[r, gone] = False
            after[r, at] = then
            more = then < size[r]
            before[r[more], then[more]] = at[more]
            value = np.full(len(r), NONE)
            value[more] = self._ranks(new[more], ids[r[more], then[more]], width, at[more])
            point(r, gone, NONE)
            point(r, at, value)
            first = prior >= 0
            b = prior[first]
            point(r[first], b, self._ranks(ids[r[first], b], new[first], width, b))
            r = r[tree[r, 1] < NONE]
        return ids[alive], alive.sum(axis=1)

    def _merge_one(self, word: bytes) -> bytes:
        """The ids of one word, its tree a flat list: for long words, and where few have a width."""
        size, width = len(word), 1 << max(len(word) - 1, 0).bit_length()
        ids = self.inner[np.frombuffer(word, dtype=np.uint8)].tolist()
        ids[-1] = int(self.final[word[-1]])
        rank_of, merged, none = self.rank_by_pair, self.merged, int(NONE)
        tree = [none] * (2 * width)

        def leaf(left: int, right: int, at: int) -> int:
            rank = rank_of.get(left << 20 | right)
            return none if rank is None else rank * width + at

        for i in range(size - 1):
            tree[width + i] = leaf(ids[i], ids[i + 1], i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def point(at: int, value: int) -> None:
            node = at + width
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        alive = bytearray(b"\1" * size)
        while tree[1] < none and width > 1:
            rank, at = divmod(tree[1], width)
            gone, new = after[at], int(merged[rank])
            then, prior = after[gone], before[at]
            ids[at], alive[gone], after[at] = new, 0, then
            point(gone, none)
            if then < size:
                before[then] = at
                point(at, leaf(new, ids[then], at))
            else:
                point(at, none)
            if prior >= 0:
                point(prior, leaf(ids[prior], new, prior))
        return np.array([i for i, a in zip(ids, alive, strict=True) if a], dtype="<u4").tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        widths = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for width in np.unique(widths[sizes > 0]).tolist():
            places = np.flatnonzero((widths == width) & (sizes > 0))
            if width > 1 and (len(places) < FEW or width > LONG):
                for i in places.tolist():
                    out[i] = self._merge_one(words[i])
                continue
            step = max(1, (1 << 19) // width)
            for at in range(0, len(places), step):
                some, size = places[at : at + step].tolist(), sizes[places[at : at + step]]
                raw = np.zeros((len(some), width), dtype=np.uint8)
                raw[np.arange(width)[None, :] < size[:, None]] = np.frombuffer(
                    b"".join([words[i] for i in some]), dtype=np.uint8
                )
                ids, counts = self._merge(raw, size)
                flat = ids.astype("<u4").tobytes()
                start = 0
                for i, e in zip(some, (np.cumsum(counts) * 4).tolist(), strict=True):
                    out[i] = flat[start:e]
                    start = e
        return out

    def _parts(self, chunk: bytes) -> list[bytes]:
        """The pieces of a chunk without ASCII blanks, in lower case."""
        text = chunk.decode()
        if max(chunk) < FAR:
            text = text.lower()
            if text.isalpha():
                return [text.encode()]
            if text[-1] in ".,!?;:" and text[:-1].isalpha():
                return [text[:-1].encode(), chunk[-1:]]
        else:
            return [p.encode() for p, _ in self.far.pre_tokenize_str(self.normal.normalize_str(text))]
        return [p.encode() for p in self.pieces.findall(text)]

    def _learn(self, chunks: set[bytes]) -> None:
        known = self.known
        rest = {c: self._parts(c) for c in chunks if not c.isalpha()}
        words = {c for c in chunks if c not in rest}
        words.update(*rest.values())
        new = list(words.difference(known))
        known.update(zip(new, self.words(new), strict=True))
        for chunk, ps in rest.items():
            known[chunk] = known[ps[0]] + known[ps[1]] if len(ps) == 2 else b"".join([known[p] for p in ps])

    def _chunks(self, text: str) -> list[bytes]:
        """Pieces between ASCII blanks, which no token crosses; ASCII letters in lower case."""
        if "<|" not in text:
            raw = text.encode()
            near = raw.isascii() or len(raw.translate(None, HIGH)) == len(raw)
            return text.lower().encode().split() if near else raw.lower().split()
        out = []
        for chunk in text.encode().split():
            if b"<|" not in chunk:
                out.append(chunk.lower())
                continue
            key = b"\n" + chunk  # an entry of its own, where case counts
            if key not in self.known:
                ids = b""
                for s in self.cut.split(chunk.decode()):
                    if s in self.special:
                        ids += self.special[s].to_bytes(4, "little")
                    elif s:
                        self._learn({s.encode().lower()})
                        ids += self.known[s.encode().lower()]
                self.known[key] = ids
            out.append(key)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.known.__getitem__, c)) for c in self.chunks(texts)]

    def chunks(self, texts: list[str]) -> list[list[bytes]]:
        """The chunks of each text; all are in ``known`` until the next call."""
        if len(self.known) > CACHE:
            self.known.clear()
            self.shown.clear()
        cut = [self._chunks(t) for t in texts]
        missing = set().union(*cut).difference(self.known)
        if missing:
            self._learn(missing)
        return cut

    def decode_chunk(self, chunk: bytes) -> bytes:
        got = self.shown.get(chunk)
        if got is None:
            ids = np.frombuffer(self.known[chunk], dtype="<u4").tolist()
            got = self.shown[chunk] = b" ".join([self.names[i] for i in ids])
        return got

    def decode(self, ids: bytes) -> str:
        """As a tokenizer without decoder does: the tokens' names with a space between."""
        return b" ".join([self.names[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode()


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One encoder a worker and file, kept for its later tasks."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def grouped(texts: pa.Array, size: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about so many bytes together."""
    start = total = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        total += n
        if total >= size:
            yield start, i + 1 - start
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts) - start


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode it again: doc_id, ids (u32 little-endian), decoded.

    A null text counts as empty and gives no ids and an empty string. One row out per row in,
    repeated and null ids too. A long word takes time by its length times the logarithm of that.
    Empty table: empty result. Other columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            names, texts = batch.column("doc_id"), batch.column("text")
            for at, n in grouped(texts):
                cut = bpe.chunks(texts.slice(at, n).to_pylist())
                ids = [b"".join(map(bpe.known.__getitem__, c)) for c in cut]
                shown = [b" ".join([s for s in map(bpe.decode_chunk, c) if s]).decode() for c in cut]
                columns = [names.slice(at, n), pa.array(ids, pa.binary()), pa.array(shown, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids binary, decoded string"
    )


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of bpe_round_trip: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = bpe_round_trip(docs, path, id_col, text_col)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

