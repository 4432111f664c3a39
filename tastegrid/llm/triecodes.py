"""Vector code compression: every part of a vector becomes the index of the nearest entry of a codebook.

The distinct values of each part position are one lexicographic trie, written once in its order: every task holds
a run of consecutive leaves. A walk in depth-first order carries the distances to all entries that the components
so far add up to, so a prefix that many parts share is worked out once; large subtrees are entered child by child,
small ones are laid out level by level. At a leaf the least distance gives the code, and the part times its number
of vectors is added to that entry's sums. Only sums by entry leave a task.

All arithmetic is in 64-bit whole numbers: exact for scaled components below 2^28 and 2^34 vectors, at a width of
8 a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastegrid.session import stage

#: Leaves of a subtree that is laid out at once.
LEAVES = 1 << 13
#: Parts of a task that are walked at once.
RUN = 1 << 17


def whole_vectors(vectors: DataFrame, parts: int = 8, scale: int = 4096) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of every component; unusable rows are left out.

    Rows whose vector is null or empty or has a null, infinite or NaN component are dropped. So are rows of
    another width than the most frequent one that ``parts`` divides (the larger of two as frequent), as they
    have no place in the codebooks. Rows with a null id stay, after all others in the order of ids; repeated
    rows count each.
    """
    x = F.col("embedding").cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("string").alias("label")
    rows = stage(vectors.filter(F.coalesce(usable, F.lit(False)) & (F.size(x) > 0) & (F.size(x) % parts == 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), label,
        F.transform(x, lambda c: F.floor(c * scale)).alias("v")), "whole-vectors")
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return rows.filter(F.size("v") == (width["w"] if width else 0))


def walk(tree: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row of ``tree``, distinct and in lexicographic order."""
    n, dims = tree.shape
    code, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # splits[i]: the first component in which row i differs from row i - 1
    differs = tree[1:] != tree[:-1]
    splits = np.concatenate([[0], differs.argmax(1)]) if n else np.zeros(0, np.int64)

    def visit(lo: int, hi: int, depth: int, above: np.ndarray) -> None:
        """Leaves lo..hi of one node; ``above``: what its ``depth`` components add to the distance of each entry."""
        if depth == dims:
            code[lo:hi], far[lo:hi] = above.argmin(), above.min()
            return
        if hi - lo <= LEAVES:
            below(lo, hi, depth, above)
            return
        starts = lo + np.flatnonzero(splits[lo:hi] <= depth)
        if not len(starts) or starts[0] != lo:
            starts = np.concatenate([[lo], starts])
        for a, b in zip(starts, np.append(starts[1:], hi)):
            visit(a, b, depth + 1, above + (tree[a, depth] - book[:, depth]) ** 2)

    def below(lo: int, hi: int, depth: int, above: np.ndarray) -> None:
        at, sums = np.zeros(hi - lo, np.int64), above[None, :]  # of each leaf, its node; of each node, its distances
        for d in range(depth, dims):
            first = splits[lo:hi] <= d
            first[0] = True
            starts = np.flatnonzero(first)
            sums = sums[at[starts]] + (tree[lo + starts, d][:, None] - book[None, :, d]) ** 2
            at = np.cumsum(first) - 1
        code[lo:hi], far[lo:hi] = sums.argmin(1)[at], sums.min(1)[at]

    visit(0, n, 0, np.zeros(len(book), np.int64))
    return code, far


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _as_tree(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, of each row its place among them)."""
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]) if len(rows) else np.zeros(0, bool)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    return rows[new], place


def distinct_parts(rows: DataFrame, parts: int) -> DataFrame:
    """(position, part, n) for each distinct part, in the order of the tries over all files."""
    size = (F.size("v") / parts).cast("int")
    cut = rows.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice(
        "v", k * size + 1, size))).alias("position", "part"))
    return cut.groupBy("position", "part").agg(F.count(F.lit(1)).alias("n"))


def entry_sums(tries: DataFrame, books: np.ndarray) -> np.ndarray:
    """For every (position, entry): the number of its parts, and their sum by component."""
    width = books.shape[2]

    def add(total: np.ndarray, held: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(held)
        position, n, part = rows["position"].to_numpy(), rows["n"].to_numpy(), _matrix(rows["part"], width)
        for k in np.unique(position):
            own = np.flatnonzero(position == k)
            code, _ = walk(part[own], books[k])
            for c in np.unique(code):
                mine = own[code == c]
                total[k, c, 0] += n[mine].sum()
                total[k, c, 1:] += (part[mine] * n[mine][:, None]).sum(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((*books.shape[:2], width + 1), np.int64)
        held = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= RUN:
                add(total, held)
                held = []
        if held:
            add(total, held)
        k, c, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array(d), pa.array(total[k, c, d])],
                                         names=["position", "entry", "place", "total"])

    found = tries.mapInArrow(run, "position long, entry long, place long, total long").groupBy(
        "position", "entry", "place").agg(F.sum("total").alias("total"))
    out = np.zeros((*books.shape[:2], width + 1), np.int64)
    for r in found.collect():  # parts * entries * (width + 1) rows
        out[r["position"], r["entry"], r["place"]] = r["total"]
    return out


def learn(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray:
    """Codebooks (parts, entries, width): from the parts of the ``entries`` least ids, then ``rounds`` of nearest
    assignment and floored means; entries that nothing is assigned to stay. Fewer rows give fewer entries."""
    first = rows.select("v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.array([r["v"] for r in first], np.int64)
    if not len(start):
        return np.zeros((parts, 0, 0), np.int64)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    tries = stage(distinct_parts(rows, parts).repartitionByRange("position", "part").sortWithinPartitions(
        "position", "part"), "tries")
    for _ in range(rounds):
        sums = entry_sums(tries, books)
        used = sums[:, :, 0] > 0
        books[used] = sums[used][:, 1:] // sums[used][:, :1]  # // goes down
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): the parts of each Arrow batch as tries of their own, so nothing is shuffled."""
    shape = books.shape
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(2), shape[0] * shape[2]).reshape(-1, shape[0], shape[2])
            codes, error = np.empty(v.shape[:2], np.uint8), np.zeros(len(v), np.int64)
            for k in range(shape[0]):
                tree, place = _as_tree(v[:, k])
                code, far = walk(tree, books[k])
                codes[:, k] = code[place]
                error += far[place]
            text = codes.tobytes().hex()
            step = 2 * shape[0]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([text[i:i + step] for i in range(0, len(text), step)], pa.string()),
                pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def trie_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row.

    ``error`` is the squared distance to the entries; ``label_error`` its sum over the rows of the same label,
    null labels together. No usable row: no rows. At most 256 entries.
    """
    rows = whole_vectors(vectors, parts, scale)
    books = learn(rows, parts, entries, rounds)
    if not books.shape[1]:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = stage(encode(rows, books), "codes")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(labels, coded["label"].eqNullSafe(labels["_label"])).select(
        "vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def op13_trie_codes(spark, folder: str) -> DataFrame:
    return trie_codes(spark.read.parquet(f"{folder}/embeddings.parquet"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """One row per component, one CTE pair per round; whole numbers throughout."""
    def nearest(r: int) -> str:
        return f"""dist{r} AS (
  SELECT x.r, x.k, e.e, sum((x.c - e.c) * (x.c - e.c)) AS d
  FROM x JOIN e{r} e ON x.k = e.k AND x.j = e.j GROUP BY x.r, x.k, e.e),
near{r} AS MATERIALIZED (
  SELECT r, k, min(e) AS e, min(d) AS d FROM (
    SELECT *, min(d) OVER (PARTITION BY r, k) AS least FROM dist{r}) WHERE d = least GROUP BY r, k)"""

    def moved(r: int) -> str:
        return f"""sums{r} AS (
  SELECT n.k, n.e, x.j, CAST(sum(x.c) AS BIGINT) AS s, count(*) AS m FROM near{r} n JOIN x ON x.r = n.r AND x.k = n.k
  GROUP BY n.k, n.e, x.j),
e{r + 1} AS MATERIALIZED (
  SELECT e.k, e.e, e.j, CASE WHEN s.m IS NULL THEN e.c ELSE (s.s - ((s.s % s.m) + s.m) % s.m) // s.m END AS c
  FROM e{r} e LEFT JOIN sums{r} s ON e.k = s.k AND e.e = s.e AND e.j = s.j)"""

    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding AS v, len(embedding) // {parts} AS w
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
i AS (SELECT r, v, w, unnest(range(len(v))) AS i FROM v),
x AS MATERIALIZED (
  SELECT r, i // w AS k, i % w AS j, CAST(floor({scale} * CAST(v[i + 1] AS DOUBLE)) AS BIGINT) AS c FROM i),
e0 AS MATERIALIZED (SELECT k, r AS e, j, c FROM x WHERE r < {entries}),
{", ".join(f"{nearest(r)}, {moved(r)}" for r in range(rounds))}, {nearest(rounds)},
books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY k, e, j)) AS codebooks_sha256 FROM e{rounds}),
coded AS (
  SELECT r, string_agg(lpad(printf('%x', e), 2, '0'), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v ON coded.r = v.r CROSS JOIN books
"""


OP13_SQL = _sql()
