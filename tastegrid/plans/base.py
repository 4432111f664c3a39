"""Shared inputs of the registered queries, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.operators import similarity as S, splits as P, topk as K
from tastegrid.session import drop, stage
from tastegrid.sources import tables as T

ITEM_NEIGHBORS = 20
USER_NEIGHBORS = 20
COSINE_BOUND, JACCARD_BOUND = 0.05, 0.03  # of neighbours


# --- DataFrames ------------------------------------------------------------------

def ratings(spark: SparkSession, d: str) -> DataFrame:
    """The rating table, staged because several steps of a query read it."""
    return stage(T.ratings(spark, d), "ratings")


def titled(spark: SparkSession, d: str) -> DataFrame:
    """The rating table with titles, staged."""
    return stage(T.titled_ratings(spark, d), "titled")


def sequential(spark: SparkSession, d: str) -> DataFrame:
    """Time split of the rating table, staged for its train and test readers."""
    rows = titled(spark, d)
    split = P.split_sequential(rows)
    out = stage(split, "sequential")
    drop(rows, split)  # the rows, and the ranges that the split reads
    return out


def side(split: DataFrame, name: str) -> DataFrame:
    return split.filter(F.col("split") == name).drop("split")


def user_neighbors(train: DataFrame, k: int) -> DataFrame:
    return K.top_weighted_pearson(train, k, axis="user", min_sim=0.0)


def neighbors_by(train: DataFrame, k: int, similarity: str) -> DataFrame:
    """The k nearest users by ``weighted`` or plain ``pearson``, ``cosine`` or ``jaccard``; positive ones count."""
    if similarity == "weighted":
        return user_neighbors(train, k)
    if similarity == "pearson":
        edges = S.pearson(train, axis="user")
    elif similarity == "cosine":
        edges = S.cosine(train, axis="user", min_sim=COSINE_BOUND)
    elif similarity == "jaccard":
        edges = S.jaccard(train, axis="user", min_sim=JACCARD_BOUND)
    else:
        raise ValueError(f"unknown similarity: {similarity}")
    return S.top_neighbors(edges, k, min_sim=0.0)


def item_neighbors(train: DataFrame, k: int = ITEM_NEIGHBORS) -> DataFrame:
    return K.top_weighted_pearson(train, k, axis="item", min_sim=0.0)


# --- SQL text --------------------------------------------------------------------

def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def digest(*cols: str) -> str:
    return "md5('2002|' || " + " || '|' || ".join(cols) + ")"


def digest_int(expr: str) -> str:
    return f"CAST('0x' || substr({expr}, 1, 7) AS BIGINT)"


UI = digest("user_id", "item_id")

RAW = """raw AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(ceil(l_quantity / 10) AS DOUBLE) AS rating,
         o_orderdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RATINGS = RAW + """,
ratings AS (
  SELECT user_id, item_id, avg(rating) AS rating, min(ts) AS ts FROM raw GROUP BY 1, 2)"""
TITLED = RATINGS + """,
titled AS (SELECT r.*, p_name AS title FROM ratings r JOIN part ON item_id = p_partkey)"""
SEQ = TITLED + f""",
seq AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, {UI})
      <= floor(count(*) OVER (PARTITION BY user_id) * CAST(0.8 AS DOUBLE))
    THEN 'train' ELSE 'test' END AS split FROM titled),
train AS (SELECT user_id, item_id, rating, ts, title FROM seq WHERE split = 'train'),
test AS (SELECT user_id, item_id, rating, ts, title FROM seq WHERE split = 'test')"""
# rows per user in digest order: row 1 is held out, rows 2.. are its history
DRAWN = TITLED + f""",
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {UI}) AS rn,
         count(*) OVER (PARTITION BY user_id) AS n_rows FROM titled)"""
LOO = DRAWN + """,
train AS (SELECT user_id, item_id, rating, ts, title FROM drawn WHERE rn > 1),
test AS (SELECT user_id, item_id, rating, ts, title FROM drawn WHERE rn = 1)"""


def pair_cte(name: str, src: str, axis: str, min_common: int = 1, value: str = "rating") -> str:
    key, feat = ("user_id", "item_id") if axis == "user" else ("item_id", "user_id")
    return f"""{name} AS (
  SELECT l.{key} AS a, r.{key} AS b, count(*) AS n_common,
         sum(l.{value}) AS sx, sum(r.{value}) AS sy, sum(l.{value} * l.{value}) AS sxx,
         sum(r.{value} * r.{value}) AS syy, sum(l.{value} * r.{value}) AS sxy
  FROM {src} l JOIN {src} r ON l.{feat} = r.{feat} AND l.{key} < r.{key}
  GROUP BY 1, 2 HAVING count(*) >= {min_common})"""


NUM = "(sxy - sx * sy / n_common)"
VX = "greatest(sxx - sx * sx / n_common, 0)"
VY = "greatest(syy - sy * sy / n_common, 0)"
VARIES = f"({VX} > 1e-9 AND {VY} > 1e-9)"
WEIGHTED = r6(f"{NUM} / (sqrt({VX}) * sqrt({VY})) * least(n_common, 25) / CAST(25 AS DOUBLE)")
PEARSON = r6(f"CASE WHEN {VARIES} THEN {NUM} / (sqrt({VX}) * sqrt({VY}) + 1e-9) ELSE 0 END")


def top_cte(name: str, edges: str, k: int, where: str = "sim > 0") -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT a, b, n_common, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn
    FROM (SELECT a, b, n_common, sim FROM {edges} UNION ALL SELECT b, a, n_common, sim FROM {edges})
    WHERE {where}) WHERE rn <= {k})"""


def weighted_neighbors(axis: str, k: int) -> str:
    """CTEs ``{axis}_nb`` with the k best neighbours by weighted Pearson on train."""
    return f"""{pair_cte(axis + '_pairs', 'train', axis, 2)},
{axis}_edges AS (SELECT a, b, n_common, {WEIGHTED} AS sim FROM {axis}_pairs WHERE {VARIES}),
{top_cte(axis + '_nb', axis + '_edges', k)}"""


def item_edges() -> str:
    """CTE ``item_sims`` with all positive weighted similarities of items on train, a < b."""
    return f"""{pair_cte('item_pairs', 'train', 'item', 2)},
item_sims AS (SELECT a, b, sim FROM (SELECT a, b, {WEIGHTED} AS sim FROM item_pairs WHERE {VARIES}) WHERE sim > 0)"""


def neighbors_cte(similarity: str, k: int) -> str:
    """CTEs up to ``user_nb`` for :func:`neighbors_by` on train."""
    pairs = pair_cte("user_pairs", "train", "user", 2 if similarity == "pearson" else 1)
    if similarity == "pearson":
        edges = f"user_edges AS (SELECT a, b, n_common, {PEARSON} AS sim FROM user_pairs)"
    elif similarity == "cosine":
        edges = f"""lengths AS (SELECT user_id AS k, sqrt(sum(rating * rating)) AS len FROM train GROUP BY 1),
user_edges AS (SELECT * FROM (SELECT a, b, n_common, {r6('sxy / (x.len * y.len)')} AS sim
  FROM user_pairs JOIN lengths x ON x.k = a JOIN lengths y ON y.k = b) WHERE sim >= {COSINE_BOUND})"""
    else:
        edges = f"""sizes AS (SELECT user_id AS k, count(*) AS n FROM train GROUP BY 1),
user_edges AS (SELECT * FROM (SELECT a, b, n_common, {r6('n_common / CAST(x.n + y.n - n_common AS DOUBLE)')} AS sim
  FROM user_pairs JOIN sizes x ON x.k = a JOIN sizes y ON y.k = b) WHERE sim >= {JACCARD_BOUND})"""
    return f"{pairs},\n{edges},\n{top_cte('user_nb', 'user_edges', k)}"


VECTORS = """vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"""


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def norm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda z: z * z)))"
