"""Token counts with a byte-level tokenizer, encoded in batches inside Arrow functions.

Only lengths leave the Python workers. A text is cut at safe boundaries: a single space between two
characters that are not white space. The tokenizer's pattern begins a new match at such a space
whatever stands around it, so the counts of the pieces add up to that of the text. Words
recur, so a worker keeps the counts of the pieces it has met, up to a fixed number of them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of new pieces that one call of the tokenizer gets at most (but one piece at least).
BATCH_BYTES = 1 << 18
#: Pieces whose counts a worker keeps, and the longest piece it keeps.
KEPT_PIECES, KEPT_CHARS = 600_000, 64

_counts: dict[str, dict[str, int]] = {}
_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def pieces(text: str) -> list[str]:
    """The text cut at its safe boundaries; every piece but the first begins with its space."""
    cut = SAFE_CUT.split(text)
    return [cut[0], *[" " + p for p in cut[1:]]]


def _batches(new: list[str]) -> Iterator[list[str]]:
    batch, size = [], 0
    for p in new:
        if batch and size + len(p) > BATCH_BYTES:
            yield batch
            batch, size = [], 0
        batch.append(p)
        size += len(p)
    if batch:
        yield batch


def count_batch(texts: list[str | None], path: str) -> list[int]:
    """Token counts of texts, in order; null counts as empty."""
    tokenizer, kept = _tokenizer(path), _counts.setdefault(path, {})
    out, lo = [], 0
    while lo < len(texts):
        hi, size = lo, 0  # texts of one round: about 2 MB, one text at least
        while hi < len(texts) and (hi == lo or size < 2_000_000):
            size += len(texts[hi] or "")
            hi += 1
        cut = [pieces(t) if t else [] for t in texts[lo:hi]]
        if len(kept) > KEPT_PIECES:
            kept.clear()
        new = list(set().union(*cut).difference(kept))
        extra = {}
        for batch in _batches(new):
            for p, e in zip(batch, tokenizer.encode_batch(batch, add_special_tokens=False)):
                (kept if len(p) <= KEPT_CHARS else extra)[p] = len(e)
        if extra:
            out += [sum(kept[p] if p in kept else extra[p] for p in c) for c in cut]
        else:
            out += [sum(map(kept.__getitem__, c)) for c in cut]
        lo = hi
    return out


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; a null text counts as empty.

    Texts are encoded as the tokenizers library does by default: special strings inside a text are
    recognised, nothing is added, cut off or padded. ``path`` is the tokenizer file; every executor
    needs it at that place. No shuffle: a row is counted where it is read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(count_batch(b.column(2).to_pylist(), path), pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark, folder: str) -> DataFrame:
    """Counts of all documents with the public 50k byte-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
