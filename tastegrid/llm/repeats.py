"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over ``HASH`` bytes picks triggers: the trigger of position i is the leftmost minimum of
the hashes at i .. i + REACH - 1. Neighbouring positions with the same trigger are a phrase's run; the run
and the ``length`` bytes that its last position reaches are the phrase's content. Which trigger a
position has follows from its next ``length`` bytes alone, so equal strings are parsed alike wherever
they stand, and two equal strings have their triggers at the same place.

Only equality at depth ``length`` is asked for, so the corpus order need not be written out: the
order's classes are enough. The dictionary holds the distinct contents and how often each occurs; the
parse of a document is its list of runs. In that order,
* suffixes that begin in contents that occur twice are repeated (classes of the parse);
* suffixes of contents that occur once are compared with the suffixes of the other contents around
  an equal trigger, each distinct content once (classes of the dictionary's suffixes).
Before all that, runs whose trigger context (the bytes behind the trigger that every string of the run
holds) is met only once are dropped: nothing equal to their strings exists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tastegrid.llm.common import bit_filter, has_bit, keep, parted
from tastegrid.session import drop

LENGTH = 200
HASH = 16
REACH = 128

_EMPTY = np.zeros(0, np.int64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at every position as one number; data has at least 8 bytes."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        out[o::8] = data[o:o + 8 * ((n - o + 7) // 8)].view("<u8")
    return out


def parse(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a text: first and last position, trigger, and a hash of the trigger's context."""
    n = len(text) - length + 1  # positions where a string of that length begins
    if n <= 0:
        return _EMPTY, _EMPTY, _EMPTY, _EMPTY
    words = _words8(np.frombuffer(text, np.uint8))
    h = words[:-8] * _MIX[0] ^ (words[8:] + _MIX[2]) * _MIX[1]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    key = (h[:n + REACH - 1] & np.uint64(0xFFFFFFFF00000000)) | np.arange(n + REACH - 1, dtype=np.uint64)
    step = 1
    while step < REACH:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.flatnonzero(at[1:] != at[:-1])
    lo, hi = np.concatenate([[0], edge + 1]), np.concatenate([edge, [n - 1]])
    trigger = at[lo]
    context = length - REACH + 1  # bytes behind the trigger that all strings of a run hold
    code = np.full(len(lo), context, np.uint64)
    for o in [*range(0, context - 8, 8), context - 8]:
        code = (code ^ words[trigger + o]) * _MIX[0]
        code ^= code >> np.uint64(31)
        code *= _MIX[1]
        code ^= code >> np.uint64(28)
    return lo, hi, trigger, code.view(np.int64)


def _halves(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, text): rid depends on id and text, so rows that share an id but not the text differ."""
    return docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(id_col).alias("id"),
        F.col(text_col).alias("text"))


def _contexts(rows: DataFrame, length: int) -> DataFrame:
    """(code): the context hashes of the runs of every text."""
    def run(batches):
        for b in _slices(batches):
            codes = [parse((t or "").encode(), length)[3] for t in b.column(0).to_pylist()]
            if codes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes))], names=["code"])

    return rows.filter(F.octet_length("text") >= length).select("text").mapInArrow(run, "code long")


def _phrases(rows: DataFrame, kind: str, seen: np.ndarray, length: int) -> DataFrame:
    """Texts with the runs whose context passes the filter: code, 128-bit hash of the content and the
    trigger's place in it, lo, hi. Texts without such runs are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(seen)
    runs_type = pa.list_(pa.struct([("code", pa.int64()), ("xa", pa.int64()), ("xb", pa.int64()),
                                    ("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches):
        for b in _slices(batches):
            out, rows_ = [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                raw = (text or "").encode()
                lo, hi, trigger, code = parse(raw, length)
                picked = np.flatnonzero(has_bit(shared.value, code))
                if not len(picked):
                    continue
                runs = []
                for a, z, t, c in zip(*(x[picked].tolist() for x in (lo, hi, trigger, code))):
                    xa, xb = _halves(raw[a:z + length] + (t - a).to_bytes(4, "little"))
                    runs.append({"code": c, "xa": xa, "xb": xb, "lo": a, "hi": z})
                out.append(runs)
                rows_.append(k)
            part = b.take(pa.array(rows_, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, runs_type)],
                                             names=["rid", "id", "text", "runs"])

    return rows.filter(F.octet_length("text") >= length).mapInArrow(
        run, f"rid long, id {kind}, text string, "
             "runs array<struct<code: long, xa: long, xb: long, lo: int, hi: int>>")


def _lists(column: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """Where the list of each row begins and the last one ends, and fields of the structs in the lists."""
    flat = column.flatten()
    ends = column.offsets.to_numpy()
    return ends - ends[0], *(flat.field(f).to_numpy() for f in fields)


def _pieces(contents: DataFrame, length: int) -> DataFrame:
    """(piece, todo) of (text, todo): the bytes of the texts that contents hold, overlapping contents as one
    piece. ``lo`` and ``hi`` count from the piece's begin. What no content holds is left behind."""
    todo_type = pa.list_(pa.struct([("xa", pa.int64()), ("xb", pa.int64()), ("lo", pa.int32()),
                                    ("hi", pa.int32()), ("n", pa.int64())]))

    def run(batches):
        for b in _slices(batches):
            pieces, todos = [], []
            for text, todo in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode()
                todo.sort(key=lambda x: x["lo"])
                begin = upto = -1
                for x in todo:
                    if x["lo"] >= upto:
                        if upto >= 0:
                            pieces.append(raw[begin:upto])
                        begin = x["lo"]
                        todos.append([])
                    upto = x["hi"] + length
                    todos[-1].append(x | {"lo": x["lo"] - begin, "hi": x["hi"] - begin})
                pieces.append(raw[begin:upto])
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), pa.array(todos, todo_type)],
                                             names=["piece", "todo"])

    return contents.select("text", "todo").mapInArrow(
        run, "piece binary, todo array<struct<xa: long, xb: long, lo: int, hi: int, n: long>>")


def _suffixes(pieces: DataFrame, length: int, seen: np.ndarray | None = None) -> DataFrame:
    """The strings that begin in each content of (piece, todo): (wa, wb) 128-bit hash.

    With a filter, only those whose hash passes it, and besides xa, xb, off: where in which content.
    """
    shared = pieces.sparkSession.sparkContext.broadcast(seen)

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for b in _slices(batches, 64):
            ends, lo, hi, xa, xb = _lists(b.column(1), "lo", "hi", "xa", "xb")
            hashes = []
            for raw, first, last in zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                for z, y in zip(lo[first:last].tolist(), hi[first:last].tolist()):
                    hashes += [digest(raw[i:i + length]) for i in range(z, y + 1)]
            w = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            wa, wb = w[:, 0].copy(), w[:, 1].copy()
            if shared.value is None:
                yield pa.RecordBatch.from_arrays([pa.array(wa), pa.array(wb)], names=["wa", "wb"])
                continue
            at = np.flatnonzero(has_bit(shared.value, wa))
            n = hi - lo + 1
            own = np.repeat(np.arange(len(n)), n)[at]  # the content of each string
            off = at - (np.cumsum(n, dtype=np.int64) - n)[own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(wa[at]), pa.array(wb[at]), pa.array(xa[own]), pa.array(xb[own]),
                 pa.array(off.astype(np.int32))], names=["wa", "wb", "xa", "xb", "off"])

    return pieces.select("piece", "todo").mapInArrow(
        run, "wa long, wb long" + ("" if seen is None else ", xa long, xb long, off int"))


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(texts, starts) of the documents that share a trigger context with another place.

    texts: rid, id, text. starts: rid, starts, where ``starts`` lists ranges {lo, hi} of positions whose
    next ``length`` bytes also start anywhere else in the table, the same document and repeated
    rows included. Null and short texts have none; an empty table gives empty results.
    """
    if length < REACH + HASH:
        raise ValueError(f"length must be at least {REACH + HASH}")
    rows = _keyed(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    twice = keep(_contexts(rows, length).groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                 .select("code"), "twice")
    texts = keep(_phrases(rows, kind, bit_filter(twice, "code", _bits(twice.count())), length), "phrases")
    drop(twice)

    runs = texts.select("rid", F.explode("runs").alias("r")).select("rid", "r.*")
    contents = keep(runs.groupBy("code", "xa", "xb").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("rid", "lo", "hi"), F.struct("rid", "lo")).alias("one")),
        "dictionary")
    # contexts around which contents differ, one of them met once
    mixed = keep(contents.groupBy("code").agg(
        F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter("k > 1 AND least = 1").select("code"), "mixed")
    open_ = keep(contents.join(mixed, "code", "left_semi").select("xa", "xb", "n", "one.*"), "open")

    todo = open_.select("rid", F.struct("xa", "xb", "lo", "hi", "n").alias("x")).groupBy("rid").agg(
        F.collect_list("x").alias("todo"))
    # a repeated row has the same text under the same rid: one of them is enough
    pieces = keep(_pieces(texts.select("rid", "text").join(todo, "rid").dropDuplicates(["rid"]), length), "pieces")

    shared = keep(_suffixes(pieces, length).groupBy("wa", "wb").agg(F.count(F.lit(1)).alias("n"))
                  .filter("n > 1").drop("n"), "shared")
    seen = bit_filter(shared, "wa", _bits(shared.count()))
    once = pieces.withColumn("todo", F.filter("todo", lambda x: x["n"] == 1)).filter(F.size("todo") > 0)
    parts = (
        _suffixes(once, length, seen).join(shared, ["wa", "wb"], "left_semi")
        .groupBy("xa", "xb").agg(F.collect_list("off").alias("offs"))
    )
    known = keep(
        contents.filter("n > 1").select("xa", "xb", F.lit(None).cast("array<int>").alias("offs"))
        .unionByName(parts), "known")
    drop(contents, mixed, open_, pieces, shared)
    ranges = F.when(F.col("offs").isNull(), F.array(F.struct("lo", "hi"))).otherwise(
        F.transform("offs", lambda o: F.struct((F.col("lo") + o).alias("lo"), (F.col("lo") + o).alias("hi"))))
    starts = (
        runs.join(known, ["xa", "xb"]).select("rid", ranges.alias("ranges"))
        .groupBy("rid").agg(F.flatten(F.collect_set("ranges")).alias("starts"))
    )
    return texts.select("rid", "id", "text"), keep(starts, "starts")


def _bits(n: int) -> int:
    """Bits of a filter for n keys: about 16 to a key, 64 MB at most."""
    return min(1 << 29, max(1 << 20, 1 << (16 * max(1, n) - 1).bit_length()))


def cut_text(raw: bytes, lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> tuple[bytes, int]:
    """The text without the bytes that strings starting in the ranges cover, and the number of runs removed."""
    n = len(raw) + 1
    depth = np.bincount(lo, minlength=n) - np.bincount(hi.astype(np.int64) + length, minlength=n)
    gone = np.cumsum(depth[:-1]) > 0
    begins = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), begins


def removed(texts: DataFrame, starts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, id, kept binary, n_removed, n_spans) of the texts that lose bytes; one row per row of ``texts``."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for b in _slices(batches):
            kept, n, spans = [], [], []
            ends, lo, hi = _lists(b.column(3), "lo", "hi")
            for text, first, last in zip(b.column(2).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                raw = text.encode()
                rest, k = cut_text(raw, lo[first:last], hi[first:last], length)
                kept.append(rest)
                n.append(len(raw) - len(rest))
                spans.append(k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(kept, pa.binary()), pa.array(n, pa.int64()),
                 pa.array(spans, pa.int64())], names=["rid", "id", "kept", "n_removed", "n_spans"])

    return texts.join(starts, "rid").select("rid", "id", "text", "starts").mapInArrow(
        run, f"rid long, id {kind}, kept binary, n_removed long, n_spans long")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    texts, starts = repeated_starts(docs, id_col, text_col, length)
    # equal rows share a rid and have equal results
    changed = keep(removed(texts, starts, length).select(
        "rid", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).dropDuplicates(["rid"]), "removed")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = _keyed(docs, id_col, text_col).select(
        "rid", "id", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"))
    return whole.join(changed, "rid", "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents (doc_id, text, lang, source, n_chars) without the repeated bytes; n_chars is counted anew.

    Where a cut goes through a character, what is left of it goes too. Every row stays, with an empty
    text if nothing is left.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    texts, starts = repeated_starts(docs, length=length)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), *columns)
    same, other = parted(rows, starts, "rid")

    def run(batches):
        for b in _slices(batches):
            kept = []
            ends, lo, hi = _lists(b.column(5), "lo", "hi")  # no ranges: nothing was found
            for text, first, last in zip(b.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                if first == last:
                    kept.append(text)
                else:
                    kept.append(cut_text((text or "").encode(), lo[first:last], hi[first:last], length)[0].decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), *b.columns[2:5]], names=columns)

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    cut = other.join(starts, "rid", "left").select(*columns, "starts").mapInArrow(run, kinds)
    return same.select(*columns).unionByName(cut).withColumn(
        "n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def op8_suffix_dedup(spark, folder: str) -> DataFrame:
    """All documents without the 200-byte strings that also start elsewhere."""
    return digests(spark.read.parquet(f"{folder}/documents.parquet"))
