"""Registered queries: similarity edge lists and neighbour selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid.operators import (
    context as X, neighbors as N, similarity as S, vectorsim as VS,
)
from tastegrid.plans.base import (
    LOO, PEARSON, RATINGS, RAW, SEQ, UI, VARIES, VECTORS, WEIGHTED, dot, norm,
    item_edges, pair_cte, r6, ratings, sequential, side, titled, top_cte, user_neighbors, weighted_neighbors,
)
from tastegrid.session import stage
from tastegrid.sources import tables as T

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


# --- rating similarities --------------------------------------------------------------

@query(f"WITH {RATINGS}, {pair_cte('p', 'ratings', 'user', 2)} SELECT a, b, n_common, {PEARSON} AS sim FROM p")
def sim_user_pcc(spark, d):
    return S.pearson(ratings(spark, d), axis="user")


@query(f"WITH {RATINGS}, {pair_cte('p', 'ratings', 'item', 2)} SELECT a, b, n_common, {PEARSON} AS sim FROM p")
def sim_item_pcc(spark, d):
    return S.pearson(ratings(spark, d), axis="item")


DEV = """means AS (SELECT item_id, sum(rating) / (sum(least(rating, 1)) + 1e-9) AS m FROM ratings GROUP BY 1),
dev AS (SELECT user_id, r.item_id, rating - m AS rating FROM ratings r JOIN means USING (item_id))"""


@query(f"""WITH {RATINGS}, {DEV}, {pair_cte('p', 'dev', 'item')},
e AS (SELECT a, b, n_common, {r6('sxy / (sqrt(sxx) * sqrt(syy) + 1e-9) * least(n_common, 25) / CAST(25 AS DOUBLE)')} AS sim FROM p)
SELECT * FROM e""")
def sim_item_pcc_global(spark, d):
    """Every pair of items that a user has rated both of."""
    return S.global_mean_pearson(ratings(spark, d), axis="item")


@query(f"""WITH {RATINGS}, {pair_cte('p', 'ratings', 'user', 2)}
SELECT a, b, n_common, {WEIGHTED} AS sim FROM p WHERE {VARIES}""")
def sim_weighted_pcc(spark, d):
    return S.weighted_pearson(ratings(spark, d), axis="user")


@query(f"""WITH {RATINGS}, {pair_cte('p', 'ratings', 'item', 2)}
SELECT a, b, n_common, {WEIGHTED} AS sim FROM p WHERE {VARIES}""")
def sim_weighted_pcc_item(spark, d):
    return S.weighted_pearson(ratings(spark, d), axis="item")


def _cosine_sql(axis: str, src: str, base: str, min_sim: float | None = None) -> str:
    key = f"{axis}_id"
    bound = "" if min_sim is None else f" WHERE sim >= {min_sim}"
    return f"""{base}, {pair_cte('p', src, axis)},
nr AS (SELECT {key} AS k, sqrt(sum(rating * rating)) AS len FROM {src} GROUP BY 1),
cos AS (SELECT a, b, n_common, {r6('sxy / (x.len * y.len)')} AS sim
  FROM p JOIN nr x ON x.k = a JOIN nr y ON y.k = b),
edges AS (SELECT * FROM cos{bound})"""


@query(f"WITH {_cosine_sql('user', 'ratings', RATINGS)} SELECT * FROM edges")
def sim_user_cosine(spark, d):
    """Every pair of users with a common item."""
    return S.cosine(ratings(spark, d), axis="user")


@query(f"WITH {_cosine_sql('item', 'ratings', RATINGS, 0.05)} SELECT * FROM edges")
def sim_item_cosine(spark, d):
    return S.cosine(ratings(spark, d), axis="item", min_sim=0.05)


def _jaccard_sql(axis: str, min_sim: float) -> str:
    key = f"{axis}_id"
    return f"""WITH {RATINGS}, {pair_cte('p', 'ratings', axis)},
c AS (SELECT {key} AS k, count(*) AS n FROM ratings WHERE rating <> 0 GROUP BY 1),
j AS (SELECT a, b, n_common, {r6('n_common / CAST(x.n + y.n - n_common AS DOUBLE)')} AS sim
  FROM p JOIN c x ON x.k = a JOIN c y ON y.k = b)
SELECT * FROM j WHERE sim >= {min_sim}"""


@query(_jaccard_sql("user", 0.03))
def sim_user_jaccard(spark, d):
    return S.jaccard(ratings(spark, d), axis="user", min_sim=0.03)


@query(_jaccard_sql("item", 0.03))
def sim_item_jaccard(spark, d):
    return S.jaccard(ratings(spark, d), axis="item", min_sim=0.03)


@query(f"WITH {RATINGS}, {pair_cte('p', 'ratings', 'user', 3)} SELECT a, b, n_common FROM p")
def corated_items(spark, d):
    return S.corated_items(ratings(spark, d), axis="user", min_common=3)


@query(f"""WITH {RATINGS}, {pair_cte('p', 'ratings', 'user', 3)},
e AS (SELECT a, b, {PEARSON} AS sim FROM p),
s AS (SELECT a, b, sim FROM e UNION ALL SELECT b, a, sim FROM e)
SELECT a, b, sim FROM s WHERE sim > 0.6 UNION ALL
SELECT DISTINCT user_id, user_id, CAST(1 AS DOUBLE) FROM ratings""")
def valid_neighbors(spark, d):
    r = ratings(spark, d)
    edges = S.pearson(r, axis="user", min_common=3)
    return S.valid_neighbors(edges, keys=r.select("user_id").distinct())


@query(f"""WITH {_cosine_sql('user', 'bin', RAW + ''', bin AS (
  SELECT user_id, item_id, CAST(1 AS DOUBLE) AS rating FROM raw GROUP BY 1, 2 HAVING sum(rating) >= 3)''', 0.05)},
{top_cte('nb', 'edges', 4)} SELECT a, b, {r6('1 - sim')} AS distance, CAST(rn AS INTEGER) AS rn FROM nb""")
def knn_binary(spark, d):
    """k nearest users on the thresholded 0/1 matrix."""
    rows = S.interactions_binary(T.rating_lines(spark, d), "user_id", "item_id", "rating", 3.0)
    ones = stage(rows.select("user_id", "item_id", F.lit(1.0).alias("rating")), "binary")
    nearest = S.top_neighbors(S.cosine(ones, axis="user", min_sim=0.05), 4)
    return nearest.select("a", "b", F.round(1 - F.col("sim"), 6).alias("distance"), "rn")


@query(f"""WITH {RATINGS}, {pair_cte('p', 'ratings', 'user', 2)},
e AS (SELECT a, b, n_common, {WEIGHTED} AS sim FROM p WHERE {VARIES}), {top_cte('nb', 'e', 4)}
SELECT a, b, n_common, sim, CAST(rn AS INTEGER) AS rn FROM nb""")
def topk_users(spark, d):
    return user_neighbors(ratings(spark, d), 4)


PROFILES = """traits AS (SELECT p_partkey AS item_id, 'brand' AS attribute, p_brand AS value FROM part
  UNION ALL SELECT p_partkey, 'category', p_type FROM part
  UNION ALL SELECT p_partkey, 'price', CAST(CAST(floor(p_retailprice / 100) AS BIGINT) AS VARCHAR) FROM part
  UNION ALL SELECT DISTINCT p_partkey, 'title', unnest(regexp_split_to_array(lower(p_name), ' ')) FROM part),
w AS (SELECT user_id, attribute, value, sum(rating) AS w FROM ratings JOIN traits USING (item_id) GROUP BY 1, 2, 3),
len AS (SELECT user_id, attribute, sqrt(sum(w * w)) AS len FROM w GROUP BY 1, 2),
prof AS (SELECT user_id, attribute, value, w / len AS w FROM w JOIN len USING (user_id, attribute)),
ps AS (SELECT x.user_id AS a, y.user_id AS b, sum(x.w * y.w) / 4 AS ps FROM prof x
  JOIN prof y ON x.user_id < y.user_id AND x.attribute = y.attribute AND x.value = y.value GROUP BY 1, 2)"""


@query(f"""WITH {RATINGS}, {pair_cte('p', 'ratings', 'user')}, e AS (SELECT a, b, n_common, {PEARSON} AS sim FROM p), {PROFILES}
SELECT a, b, coalesce(n_common, 0) AS n_common, {r6('coalesce(ps, 0)')} AS profile_sim,
  {r6('0.5 * coalesce(sim, 0) + 0.5 * coalesce(ps, 0)')} AS sim FROM e FULL JOIN ps USING (a, b)""")
def sim_user_features(spark, d):
    """Rating similarity blended with the users' profiles by brand, category, price and title, for all pairs
    of users with a common item or a common trait."""
    r = ratings(spark, d)
    items = T.items(spark, d)
    traits = S.item_traits(items.select(
        "item_id", "brand", "category", F.floor(F.col("price") / 100).cast("string").alias("price"),
        F.array_distinct(F.split(F.lower("title"), " ")).alias("title")), "item_id")
    profiles = S.feature_profiles(r, traits)
    return S.feature_augmented(S.pearson(r, axis="user", min_common=1), profiles)


# --- vector similarities -----------------------------------------------------------------

REPS = VECTORS + """,
reps AS (SELECT min(vec_id) AS id, v FROM vecs GROUP BY v),
copies AS (SELECT id AS a, vec_id AS b, CAST(1 AS DOUBLE) AS sim FROM vecs JOIN reps ON vecs.v = reps.v WHERE vec_id <> id)"""


def _latent_sql(prepared: str, sim: str, min_sim: float) -> str:
    return f"""WITH {REPS}, m AS MATERIALIZED (SELECT id, v, list_avg(v) AS mean FROM reps),
t AS MATERIALIZED (SELECT id, {prepared} AS u FROM m),
e AS (SELECT x.id AS a, y.id AS b, {sim} AS sim FROM t x JOIN t y ON x.id < y.id)
SELECT a, b, sim FROM e WHERE sim >= {min_sim} UNION ALL SELECT * FROM copies"""


_COS = r6(f"{dot('x.u', 'y.u')} / nullif({norm('x.u')} * {norm('y.u')}, 0)")


@query(_latent_sql("v", _COS, 0.2))
def sim_latent_cosine(spark, d):
    return VS.latent_similarity(T.vectors(spark, d), "vec_id", "vector", "cosine", 0.2)


@query(_latent_sql("list_transform(v, lambda z: z - mean)", _COS, 0.2))
def sim_latent_pearson(spark, d):
    return VS.latent_similarity(T.vectors(spark, d), "vec_id", "vector", "pearson", 0.2)


@query(f"""WITH {VECTORS},
t AS (SELECT vec_id AS id, list_transform(v, lambda z: CASE WHEN z > 0 THEN 1 ELSE 0 END) AS u FROM vecs),
g AS (SELECT min(id) AS id, u FROM t GROUP BY u),
e AS (SELECT x.id AS a, y.id AS b, {dot('x.u', 'y.u')} AS shared, list_sum(x.u) AS na, list_sum(y.u) AS nb FROM g x JOIN g y ON x.id < y.id),
s AS (SELECT a, b, {r6('shared / CAST(na + nb - shared AS DOUBLE)')} AS sim FROM e)
SELECT a, b, sim FROM s WHERE sim >= 0.4 UNION ALL
SELECT g.id, t.id, CAST(1 AS DOUBLE) FROM t JOIN g ON t.u = g.u WHERE t.id <> g.id""")
def sim_latent_jaccard(spark, d):
    return VS.latent_similarity(T.vectors(spark, d), "vec_id", "vector", "jaccard", 0.4)


@query(f"""WITH {VECTORS}, src AS (SELECT vec_id AS id, v AS u FROM vecs WHERE vec_id = (SELECT min(vec_id) FROM vecs))
SELECT vec_id, {r6(f"1 - {dot('v', 'u')} / nullif({norm('v')} * {norm('u')}, 0)")} AS distance
FROM vecs, src WHERE vec_id <> id AND label <> (SELECT label FROM vecs, src WHERE vec_id = id)
ORDER BY 2, 1 LIMIT 10""")
def knn_embeddings(spark, d):
    """Nearest rows to one source row; rows with the source's own label are skipped."""
    v = T.vectors(spark, d)
    source = v.filter(F.col("vec_id") == v.agg(F.min("vec_id").alias("m")).scalar())
    return VS.nearest_to_source(v, "vec_id", "vector", source, 10, same_text="label")


def _knn_sql(where: str) -> str:
    return f"""WITH {VECTORS}, t AS MATERIALIZED (SELECT vec_id AS id, v AS u FROM vecs),
e AS (SELECT x.id AS a, y.id AS b, {_COS} AS sim FROM t x JOIN t y ON x.id <> y.id),
nb AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM e WHERE {where})
SELECT a, b, {r6('1 - sim')} AS distance, CAST(rn AS INTEGER) AS rn FROM nb WHERE rn <= 5"""


@query(_knn_sql("sim >= 0.2"))
def knn_within(spark, d):
    """Every vector's nearest rows within a distance bound, exactly."""
    return VS.knn_within(T.vectors(spark, d), "vec_id", "vector", 5, 0.2)


@query(_knn_sql("true"))
def knn_all(spark, d):
    """Every vector's nearest rows."""
    return VS.knn_all(T.vectors(spark, d), "vec_id", "vector", 5)


@query()
def knn_lsh(spark, d):
    return VS.knn_lsh(T.vectors(spark, d), "vec_id", "vector", 5, 0.2, bits=5)


ITEM_VECS = """vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
iv AS (SELECT p_partkey AS item_id, v FROM part, (SELECT count(*) AS n FROM embeddings) JOIN vecs ON vec_id = p_partkey % n)"""


def item_vectors(spark, d):
    """A vector per item, assigned by item number."""
    vecs = T.vectors(spark, d).select("vec_id", "vector")
    n = vecs.agg(F.count(F.lit(1)).alias("n")).scalar()
    ids = T.items(spark, d).select("item_id").withColumn("vec_id", F.pmod("item_id", n))
    return ids.join(vecs, "vec_id").select("item_id", "vector")


HISTORY_SIM = f"""hs AS (SELECT t.user_id, t.item_id AS target,
  {r6(f"avg({dot('x.v', 'y.v')} / nullif({norm('x.v')} * {norm('y.v')}, 0))")} AS semantic_sim, count(*) AS n_history
  FROM drawn t JOIN drawn h ON t.user_id = h.user_id AND t.rn = 1 AND h.rn BETWEEN 2 AND 5
  JOIN iv x ON x.item_id = t.item_id JOIN iv y ON y.item_id = h.item_id WHERE t.n_rows >= 5 GROUP BY 1, 2)"""


@query(f"WITH {LOO}, {ITEM_VECS}, {HISTORY_SIM} SELECT user_id, target, semantic_sim, n_history FROM hs")
def semantic_history_sim(spark, d):
    drawn = stage(X.drawn_rows(titled(spark, d)), "drawn")
    test, past = drawn.filter(F.col("rn") == 1), drawn.filter(F.col("rn") > 1)
    return X.semantic_history(test, past, item_vectors(spark, d))


# --- neighbours' ratings --------------------------------------------------------------------

@query(f"""WITH {RATINGS}, {pair_cte('p', 'ratings', 'user', 2)},
e AS (SELECT a, b, n_common, {WEIGHTED} AS sim FROM p WHERE {VARIES}), {top_cte('nb', 'e', 4)},
lists AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS rank FROM ratings)
SELECT a AS user_id, b AS neighbor, sim, CAST(rn AS INTEGER) AS rn, item_id, rating, CAST(rank AS INTEGER) AS rank
FROM nb JOIN lists ON lists.user_id = b AND rank <= 3""")
def neighbor_top_rated(spark, d):
    r = ratings(spark, d)
    return N.neighbor_ratings(user_neighbors(r, 4), r, 3, "top").select(
        "user_id", "neighbor", "sim", "rn", "item_id", "rating", "rank")


@query(f"""WITH {RATINGS}, {pair_cte('p', 'ratings', 'user', 2)},
e AS (SELECT a, b, n_common, {WEIGHTED} AS sim FROM p WHERE {VARIES}), {top_cte('nb', 'e', 4)},
lists AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {UI}) AS rank FROM ratings)
SELECT a AS user_id, b AS neighbor, sim, CAST(rn AS INTEGER) AS rn, item_id, rating, CAST(rank AS INTEGER) AS rank
FROM nb JOIN lists ON lists.user_id = b AND rank <= 2""")
def neighbor_random(spark, d):
    r = ratings(spark, d)
    return N.neighbor_ratings(user_neighbors(r, 4), r, 2, "random").select(
        "user_id", "neighbor", "sim", "rn", "item_id", "rating", "rank")


@query(f"""WITH {RATINGS}, {pair_cte('p', 'ratings', 'user', 2)},
e AS (SELECT a, b, n_common, {WEIGHTED} AS sim FROM p WHERE {VARIES}), {top_cte('nb', 'e', 4)},
lists AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS rank FROM ratings)
SELECT a AS user_id, b AS neighbor, sim, CAST(rn AS INTEGER) AS rn, item_id, rating, CAST(rank AS INTEGER) AS rank
FROM nb JOIN lists ON lists.user_id = b AND rank <= 3""")
def neighbor_first(spark, d):
    """Each neighbour's first ratings in time."""
    r = ratings(spark, d)
    return N.neighbor_ratings(user_neighbors(r, 4), r, 3, "first").select(
        "user_id", "neighbor", "sim", "rn", "item_id", "rating", "rank")


@query(f"""WITH {RATINGS}, {pair_cte('p', 'ratings', 'user', 2)},
e AS (SELECT a, b, n_common, {WEIGHTED} AS sim FROM p WHERE {VARIES}), {top_cte('nb', 'e', 4)}
SELECT a AS user_id, b AS neighbor, sim, CAST(rn AS INTEGER) AS rn, item_id, rating FROM nb JOIN ratings ON user_id = b""")
def neighbor_all(spark, d):
    """Every rating of each neighbour."""
    r = ratings(spark, d)
    return N.neighbor_ratings(user_neighbors(r, 4), r, how="all").select(
        "user_id", "neighbor", "sim", "rn", "item_id", "rating")


BY_ITEM = f"""base AS (SELECT t.user_id, t.item_id AS target, b AS neighbor, sim, rn FROM test t JOIN user_nb ON a = t.user_id),
cand AS (SELECT base.*, h.item_id, h.rating, i.sim AS item_sim FROM base
  JOIN train h ON h.user_id = neighbor LEFT JOIN item_sims i ON i.a = least(target, h.item_id) AND i.b = greatest(target, h.item_id)),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, target, neighbor
  ORDER BY item_sim DESC NULLS LAST, rating DESC, item_id) AS rank FROM cand) WHERE rank <= 2)"""


@query(f"""WITH {SEQ}, {weighted_neighbors('user', 4)}, {item_edges()}, {BY_ITEM}
SELECT user_id, target, neighbor, sim, CAST(rn AS INTEGER) AS rn, item_id, item_sim, rating, CAST(rank AS INTEGER) AS rank FROM chosen""")
def neighbor_by_item_sim(spark, d):
    """Neighbours' ratings closest to each test item; the last fifth of each user's rows is test."""
    split = sequential(spark, d)
    train, test = side(split, "train"), side(split, "test")
    return N.neighbor_ratings_by_item(
        test, user_neighbors(train, 4), S.weighted_pearson(train, axis="item"), train, n=2)
