"""Exact top-k by inner product as a Voronoi join.

Vectors become points at which the best inner product is the least distance: with M the greatest squared
length, x gets the coordinate sqrt(M - |x|^2) and a query gets 0, so |q - x|^2 = |q|^2 + M - 2 q.x. Pivots cut
the points into cells, and the queries into groups. A cell's summary has its size and its radius; crowded
cells are dealt into blocks of bounded size. Every group takes, from the summaries alone, a radius within
which each of its queries has at least k data points, and gets only the cells that reach into it.
Each (group, block) is solved where it is, and only k rows per query and block go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tastegrid.session import stage

#: Pivots: a sample whose size does not grow with the data. They shape the work, not the result.
PIVOTS = 128
#: Rows of a block at most (by expectation: blocks are drawn by hash), and of a group of queries.
BLOCK_ROWS = 4096
SLACK = 1e-6


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of every component as a double; unusable rows are left out.

    Rows with a null id, a null vector, or a null, infinite or NaN component take no part.
    """
    v = F.col(vec_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _cells(rows: DataFrame, pivots: np.ndarray, most: float, queries: bool) -> DataFrame:
    """Rows with the nearest pivot and the distance to it, in the space with one more coordinate."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS rows

    def run(batches):
        p = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), p.shape[1] - 1)
            extra = np.zeros(len(x)) if queries else np.sqrt(np.maximum(most - (x * x).sum(1), 0))
            cell = np.empty(len(x), np.int32)
            far = np.empty(len(x))
            for lo in range(0, len(x), 2048):
                y = np.column_stack([x[lo:lo + 2048], extra[lo:lo + 2048]])
                d = np.sqrt(np.maximum((y * y).sum(1)[:, None] + (p * p).sum(1) - 2 * y @ p.T, 0))
                cell[lo:lo + 2048] = d.argmin(1)
                far[lo:lo + 2048] = d.min(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cell), pa.array(far)], names=["id", "v", "cell", "far"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, cell int, far double")


def top_k(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from (id, v) tables of whole-number vectors.

    Rows of another width than most data rows have take no part (of two equally frequent widths the
    greater counts), and empty vectors do not either.

    The k best inner products of every query over all data rows of another id, ties to the smaller id;
    all rows if there are fewer. Equal vectors under different ids all count. A repeated (id, v) row counts
    once. Scores are exact as long as they stay below 2^53. Empty tables give no rows.
    """
    spark = data.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    shape = data.filter(F.size("v") > 0).groupBy(F.size("v").alias("width")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most")
    ).orderBy(F.desc("n"), F.desc("width")).first()
    if shape is None:
        return spark.createDataFrame([], schema)
    width, most = shape["width"], float(shape["most"])
    data, queries = data.filter(F.size("v") == width), queries.filter(F.size("v") == width)
    # the pivots: PIVOTS distinct vectors with the least digests
    sample = (data.select("v").withColumn("_h", F.xxhash64("v")).groupBy("_h").agg(F.first("v").alias("v"))
              .orderBy("_h").limit(PIVOTS).collect())
    p = np.array([r["v"] for r in sample])
    p = np.column_stack([p, np.sqrt(np.maximum(most - (p * p).sum(1), 0))])

    placed = stage(_cells(data, p, most, False), "data-cells")
    summary = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    cells = [(r["cell"], r["n"], r["radius"]) for r in summary.collect()]  # PIVOTS rows
    blocks = {c: max(1, -(-n // BLOCK_ROWS)) for c, n, _ in cells}
    asked = stage(_cells(queries, p, most, True), "query-cells")
    groups = {r["cell"]: (r["radius"], max(1, -(-r["n"] // BLOCK_ROWS))) for r in asked.groupBy("cell").agg(
        F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}

    # k + 1 points, as a query's own row is no candidate
    gap = np.sqrt(np.maximum(((p[:, None, :] - p[None, :, :]) ** 2).sum(2), 0))
    plan = []
    for g, (radius, parts) in groups.items():
        reach, have = np.inf, 0
        for upper, n in sorted((radius + gap[g, c] + r, n) for c, n, r in cells):
            have += n
            if have > k:
                reach = upper
                break
        for c, _, r in cells:
            if gap[g, c] - radius - r <= reach * (1 + SLACK) + SLACK:
                plan.append((g, parts, c, blocks[c]))
    # at most PIVOTS^2 pairs of cells come from the driver; their parts and blocks are written out on Spark
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = spark.createDataFrame(plan, "grp int, parts int, cell int, blocks int").select(
        "grp", upto("parts").alias("part"), "cell", "blocks").select("grp", "part", "cell", upto("blocks").alias("block"))
    n_blocks = F.create_map(*[F.lit(x) for c, n in blocks.items() for x in (c, n)])
    n_parts = F.create_map(*[F.lit(x) for g, (_, n) in groups.items() for x in (g, n)]) if groups else None
    if n_parts is None:
        return spark.createDataFrame([], schema)
    homes = placed.select("id", "v", "cell", F.pmod(F.xxhash64("id"), n_blocks[F.col("cell")]).cast("int").alias("block"))
    askers = asked.select("id", "v", F.col("cell").alias("grp"),
                          F.pmod(F.xxhash64("id"), n_parts[F.col("cell")]).cast("int").alias("part"))
    # a plan grows with the blocks, so it is joined, not broadcast by hand
    keys = ["grp", "part", "cell", "block"]
    left = askers.join(pairs, ["grp", "part"]).select(*keys, F.col("id"), "v")
    right = homes.join(pairs, ["cell", "block"]).select(*keys, F.col("id"), "v")

    def solve(key, q: pa.Table, x: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                          "score": pa.array([], pa.int64())})
        if not q.num_rows or not x.num_rows:
            return empty
        qi, xi = q.column("id").to_numpy(), x.column("id").to_numpy()
        qm = _matrix(q.column("v").combine_chunks(), width)
        xm = _matrix(x.column("v").combine_chunks(), width)
        order = np.argsort(xi, kind="stable")
        xi, xm = xi[order], xm[order]
        out = []
        for lo in range(0, len(qi), 256):
            s = qm[lo:lo + 256] @ xm.T
            s[qi[lo:lo + 256, None] == xi[None, :]] = -np.inf
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]  # stable: ties keep the order of ids
            for r, row in enumerate(best):
                row = row[s[r, row] > -np.inf]
                out.append((np.full(len(row), qi[lo + r]), xi[row], s[r, row].astype(np.int64)))
        return pa.table({n: pa.array(np.concatenate([o[i] for o in out]))
                         for i, n in enumerate(("query_id", "vec_id", "score"))})

    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        solve, "query_id long, vec_id long, score long").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark, folder: str) -> DataFrame:
    """The 5 best of all embeddings for every vec_id divisible by 50."""
    rows = stage(whole_numbers(spark.read.parquet(f"{folder}/embeddings.parquet")), "vectors")
    return top_k(rows, rows.filter("id % 50 = 0"), 5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.id AS query_id, x.id AS vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.id % 50 = 0 AND q.id <> x.id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
