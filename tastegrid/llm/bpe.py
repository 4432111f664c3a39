"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A tree's leaf i holds the rank of the pair that begins at byte i (none: NO_RANK); an inner node holds
the position of its leftmost minimum. The root names the next merge; the merge updates the leaves of
the merged pair, of its live left neighbour and of the swallowed byte, each in O(log n). Live
neighbours are linked both ways. Words of like length are merged side by side: row r of the arrays is
the tree of word r, and each word follows its own root. A long piece is a batch of its own.

Every worker keeps the ids of pieces it has met, up to a fixed number of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

NO_RANK = np.int64(1) << 40
#: A single space between two characters that are not white space always begins a new match.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Pieces whose ids a worker keeps, and the longest piece it keeps.
KEPT_PIECES, KEPT_CHARS = 400_000, 64
#: Up to this many bytes, pieces are merged side by side; longer ones one at a time.
SIDE_BY_SIDE = 64
ROWS = 20_000
ROUND_CHARS = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks, the bytes of every id, and the rank of every pair of ids whose bytes together are a token."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {
            (self.ranks[t[:i]], self.ranks[t[i:]]): r
            for t, r in self.ranks.items() for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        }
        codes = np.array([(a << 32) | b for a, b in self.pairs], np.int64)
        order = np.argsort(codes)
        self._codes, self._merged = codes[order], np.array(list(self.pairs.values()), np.int64)[order]
        self.kept: dict[str, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = (left << 32) | right
        at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return np.where(self._codes[at] == code, self._merged[at], NO_RANK)


def merge_long(piece: bytes, vocab: Vocabulary) -> list[int]:
    """Ids of one piece; the tree is a flat list of positions, leaf i at ``size + i``."""
    n = len(piece)
    ids = [int(vocab.byte_id[b]) for b in piece]
    none = int(NO_RANK)
    size = 1 << max(0, (n - 1).bit_length())
    rank = [vocab.pairs.get((ids[i], ids[i + 1]), none) for i in range(n - 1)] + [none] * (size - n + 1)
    tree = [0] * size + list(range(size))
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = b if rank[b] < rank[a] else a
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        rank[i] = value
        k = (size + i) >> 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = b if rank[b] < rank[a] else a
            k >>= 1

    while n > 1 and rank[tree[1]] < none:
        i = tree[1]
        j = after[i]
        ids[i] = rank[i]
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        put(j, none)
        put(i, vocab.pairs.get((ids[i], ids[k]), none) if k < n else none)
        h = before[i]
        if h >= 0:
            put(h, vocab.pairs.get((ids[h], ids[i]), none))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def merge_rows(pieces: list[bytes], width: int, vocab: Vocabulary) -> list[bytes]:
    """Packed ids of pieces of at most ``width`` bytes (a power of two), all merged side by side.

    ``levels[0]`` holds the ranks of the leaves, packed with their positions so that the smaller
    number is the leftmost minimum; ``levels[d]`` holds the minima of 2^d leaves.
    """
    m = len(pieces)
    size = np.array([len(p) for p in pieces])
    filled = np.arange(width) < size[:, None]
    ids = np.full((m, width + 1), -1, np.int64)
    ids[:, :width][filled] = vocab.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
    at = np.arange(width)
    rank = np.full((m, width), NO_RANK)
    pair = at[None, :] + 1 < size[:, None]
    rows, cols = np.nonzero(pair)
    rank[rows, cols] = vocab.pair_ranks(ids[rows, cols], ids[rows, cols + 1])
    levels = [(rank << 8) | at]
    while levels[-1].shape[1] > 1:
        levels.append(np.minimum(levels[-1][:, 0::2], levels[-1][:, 1::2]))
    after = np.tile(np.arange(1, width + 2), (m, 1))
    before = np.tile(np.arange(-1, width), (m, 1))
    alive = filled.copy()
    top = NO_RANK << 8

    def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        levels[0][r, i] = (value << 8) | i
        for d in range(1, len(levels)):
            i = i >> 1
            levels[d][r, i] = np.minimum(levels[d - 1][r, 2 * i], levels[d - 1][r, 2 * i + 1])

    active = np.nonzero(levels[-1][:, 0] < top)[0]
    while len(active):
        root = levels[-1][active, 0]
        i = root & 255
        j = after[active, i]
        k = after[active, j]
        ids[active, i] = root >> 8
        alive[active, j] = False
        after[active, i] = k
        before[active, k] = i
        put(active, j, np.full(len(active), NO_RANK))
        inside = k < size[active]
        right = np.where(inside, vocab.pair_ranks(ids[active, i], ids[active, np.minimum(k, width)]), NO_RANK)
        put(active, i, right)
        h = before[active, i]
        has = h >= 0
        r, h, i = active[has], h[has], i[has]
        put(r, h, vocab.pair_ranks(ids[r, h], ids[r, i]))
        active = active[levels[-1][active, 0] < top]
    packed = ids[:, :width][alive].astype("<u4").tobytes()
    ends = (4 * np.cumsum(alive.sum(1))).tolist()
    return [packed[a:b] for a, b in zip([0, *ends], ends)]


def encode_pieces(pieces: list[bytes], vocab: Vocabulary) -> dict[bytes, bytes]:
    """Ids of distinct pieces as little-endian unsigned 32-bit integers. A piece that is a token is that token."""
    out, by_width = {}, {}
    for p in pieces:
        if p in vocab.ranks:
            out[p] = vocab.ranks[p].to_bytes(4, "little")
        elif len(p) <= SIDE_BY_SIDE:
            by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(p)
        else:
            out[p] = np.array(merge_long(p, vocab), "<u4").tobytes()
    for width, some in by_width.items():
        for lo in range(0, len(some), ROWS):
            part = some[lo:lo + ROWS]
            out.update(zip(part, merge_rows(part, width, vocab)))
    return out


def encode_texts(texts: list[str | None], vocab: Vocabulary) -> Iterator[bytes]:
    """Packed ids of every text, in order; a null text has none."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < ROUND_CHARS):
            size += len(texts[hi] or "")
            hi += 1
        cut = []
        for t in texts[lo:hi]:
            first, *rest = SAFE_CUT.split(t or "")
            cut.append([first, *[" " + p for p in rest]])
        if len(vocab.kept) > KEPT_PIECES:
            vocab.kept.clear()
        new = {c: [m.encode() for m in vocab.pattern.findall(c)] for c in set().union(*cut).difference(vocab.kept)}
        ids = encode_pieces(list(set().union(*new.values())), vocab)
        kept = vocab.kept
        for c, parts in new.items():
            kept[c] = ids[parts[0]] if len(parts) == 1 else b"".join([ids[p] for p in parts])
        for c in cut:
            yield b"".join(map(kept.__getitem__, c))
        for c in new:
            if len(c) > KEPT_CHARS:
                del kept[c]
        lo = hi


def decode_ids(packed: bytes, vocab: Vocabulary) -> bytes:
    table = vocab.table
    return b"".join([table[i] for i in np.frombuffer(packed, "<u4").tolist()])


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    if (path, pattern) not in _vocabularies:
        _vocabularies[path, pattern] = Vocabulary(path, pattern)
    return _vocabularies[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, n_tokens) of every row: ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. No shuffle. ``path`` names the ranks file at every executor.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for b in _slices(batches):
            packed = list(encode_texts(b.column(1).to_pylist(), vocab))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())],
                names=["id", "ids", "n_tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary, n_tokens long").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) of every row of packed ids; null ids decode to nothing."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for b in _slices(batches):
            texts = [decode_ids(x or b"", vocab) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], names=["id", "bytes"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass over the texts."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for b in _slices(batches):
            n, ids, back = [], [], []
            for packed in encode_texts(b.column(1).to_pylist(), vocab):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(decode_ids(packed, vocab)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                           ).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, same) of documents: ``same`` says that the ids decode to the text."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for b in _slices(batches):
            texts = b.column(3).to_pylist()
            packed = list(encode_texts(texts, vocab))
            same = [decode_ids(p, vocab) == (t or "").encode() for p, t in zip(packed, texts)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()),
                 pa.array(same, pa.bool_())], names=["doc_id", "lang", "source", "n_tokens", "ids", "same"])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(
        run, f"{kinds}, n_tokens long, ids binary, same boolean")


def op7_byte_bpe(spark, folder: str) -> DataFrame:
    """All documents through the public multilingual 50k byte-level vocabulary and back."""
    import public_tokenizers as public

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return digests(docs, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
