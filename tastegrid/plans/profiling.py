"""Registered queries: profiles, aggregates, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid.functions import vectors as V
from tastegrid.operators import profile as D, similarity as S, splits as P
from tastegrid.plans.base import (
    DRAWN, RAW, RATINGS, SEQ, TITLED, UI, VECTORS, digest, digest_int, dot, norm, r6, ratings, titled,
)
from tastegrid.plans.cleaning import POPULAR
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


# --- counts and distributions ---------------------------------------------------------

@query(f"WITH {RAW} SELECT user_id, count(*) AS n FROM raw GROUP BY 1")
def value_counts(spark, d):
    return D.value_counts(T.rating_lines(spark, d), "user_id").orderBy(F.col("n").desc(), "user_id")


@query(f"""WITH {RAW} SELECT rating, count(*) AS n,
  {r6('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS share FROM raw GROUP BY 1""")
def value_counts_norm(spark, d):
    return D.value_shares(T.rating_lines(spark, d), "rating")


@query(f"""WITH {RAW} SELECT 'user_id' AS column_name, count(DISTINCT user_id) AS n_distinct FROM raw
UNION ALL SELECT 'item_id', count(DISTINCT item_id) FROM raw UNION ALL SELECT 'ts', count(DISTINCT ts) FROM raw""")
def distinct_profile(spark, d):
    return D.distinct_profile(T.rating_lines(spark, d), ["user_id", "item_id", "ts"])


@query("SELECT DISTINCT p_type AS category FROM part")
def distinct_values(spark, d):
    return D.distinct_values(T.items(spark, d), "category")


@query(f"""WITH {RATINGS}, s AS (SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
  count(*) AS n_ratings FROM ratings)
SELECT n_users, n_items, n_ratings, {r6('n_ratings / CAST(n_users AS DOUBLE)')} AS ratings_per_user,
  {r6('1 - n_ratings / (CAST(n_users AS DOUBLE) * n_items)')} AS sparsity FROM s""")
def dataset_stats(spark, d):
    return D.dataset_stats(ratings(spark, d))


@query(f"WITH {RAW} SELECT rating, count(*) AS n FROM raw GROUP BY 1")
def rating_distribution(spark, d):
    return D.value_counts(T.rating_lines(spark, d), "rating")


@query(f"""WITH {RAW}, c AS (SELECT user_id, count(*) AS n FROM raw GROUP BY 1),
  m AS (SELECT min(n) AS lo, max(n) AS hi FROM c)
SELECT CAST(least(coalesce(floor((n - lo) / nullif((hi - lo) / CAST(50 AS DOUBLE), 0)), 0), 49) AS INTEGER) AS bin,
  count(*) AS n_keys FROM c, m GROUP BY 1""")
def activity_histogram(spark, d):
    return D.activity_histogram(T.rating_lines(spark, d), "user_id", 50)


@query(f"""WITH {TITLED} SELECT user_id, item_id, {r6('avg(rating) OVER (PARTITION BY title)')} AS prediction FROM titled""")
def pred_item_mean(spark, d):
    rows = D.group_mean(titled(spark, d), ["title"], "rating", "prediction")
    return rows.select("user_id", "item_id", "prediction")


@query(f"""WITH {TITLED} SELECT user_id, item_id, {r6('avg(rating) OVER (PARTITION BY user_id, title)')} AS prediction FROM titled""")
def pred_user_item_mean(spark, d):
    rows = D.group_mean(titled(spark, d), ["user_id", "title"], "rating", "prediction")
    return rows.select("user_id", "item_id", "prediction")


@query(f"WITH {RATINGS} SELECT user_id, item_id, {r6('rating')} AS rating FROM ratings")
def interactions(spark, d):
    return S.interactions(T.rating_lines(spark, d)).withColumn("rating", F.round("rating", 6))


@query(f"""SELECT user_id,
  {', '.join(f"coalesce({r6(f'''avg(value) FILTER (WHERE event_type = '{t}')''')}, 0) AS {t}" for t in ('click', 'error', 'purchase', 'signup', 'view'))}
FROM events GROUP BY 1""")
def pivot_wide(spark, d):
    """User x item matrix with a column for each item that occurs; unrated cells are 0."""
    events = T.table(spark, d, "events")
    return S.wide_interactions(events, S.Roles("user_id", "event_type", "value"))


@query(f"""SELECT user_id, event_type, {r6('sum(value)')} AS total FROM events GROUP BY 1, 2 HAVING sum(value) >= 500""")
def interactions_binary(spark, d):
    rows = S.interactions_binary(T.table(spark, d, "events"), "user_id", "event_type", "value", 500.0)
    return rows.withColumn("total", F.round("total", 6))


@query(f"""WITH {RAW}, c AS (SELECT user_id, item_id, count(*) AS n FROM raw GROUP BY 1, 2 HAVING count(*) > 1)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_duplicate_rows, count(*) AS n_keys FROM c""")
def dup_count(spark, d):
    return D.duplicate_rows(T.rating_lines(spark, d), ["user_id", "item_id"])


@query(f"""WITH {RAW} SELECT user_id, item_id, ts, rating FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, item_id ORDER BY ts, rating) AS rn FROM raw) WHERE rn = 1""")
def dedup_first(spark, d):
    return P.drop_duplicates_first(
        T.rating_lines(spark, d), ["user_id", "item_id"], [F.col("ts"), F.col("rating")]
    ).select("user_id", "item_id", "ts", "rating")


# --- vectors and statistics -------------------------------------------------------------

EVENT_VECS = f"""{VECTORS}, n AS (SELECT count(*) AS n_vec FROM embeddings),
ev AS (SELECT event_id, user_id, event_type, value, v FROM events, n JOIN vecs ON vec_id = event_id % n_vec)"""


def event_vectors(spark, d):
    """Each event with the vector of its text (assigned by event number)."""
    vecs = T.vectors(spark, d).select("vec_id", "vector")
    n = vecs.agg(F.count(F.lit(1)).alias("n")).scalar()
    events = T.table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return events.withColumn("vec_id", F.pmod("event_id", n)).join(vecs, "vec_id")


MEAN_VECS = EVENT_VECS + """,
pos AS (SELECT user_id, event_type, i, v[i] AS x FROM ev, range(1, 65) r(i)),
um AS (SELECT user_id, list(m ORDER BY i) AS uv FROM (SELECT user_id, i, avg(x) AS m FROM pos GROUP BY 1, 2) GROUP BY 1),
im AS (SELECT event_type, list(m ORDER BY i) AS iv FROM (SELECT event_type, i, avg(x) AS m FROM pos GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {MEAN_VECS} SELECT user_id, CAST(len(uv) AS INTEGER) AS width, {r6('list_sum(uv)')} AS total,
  {r6('uv[1]')} AS first, {r6('uv[64]')} AS last FROM um""")
def mean_vectors(spark, d):
    m = D.mean_vectors(event_vectors(spark, d), "user_id", "vector")
    v = F.col("mean_vector")
    return m.select("user_id", F.size(v).alias("width"), F.round(V.total(v), 6).alias("total"),
                    F.round(v[0], 6).alias("first"), F.round(v[63], 6).alias("last"))


AFFINITY = MEAN_VECS + f""",
aff AS (SELECT ev.event_id, ev.user_id, ev.event_type, ev.value,
  {r6(f"{dot('uv', 'iv')} / nullif({norm('uv')} * {norm('iv')}, 0)")} AS affinity
  FROM ev LEFT JOIN um ON ev.user_id = um.user_id LEFT JOIN im ON ev.event_type = im.event_type)"""


def affinity(spark, d):
    """Cosine between the mean vectors of the event's user and of its type."""
    ev = event_vectors(spark, d)
    users = D.mean_vectors(ev, "user_id", "vector").withColumnRenamed("mean_vector", "uv")
    kinds = D.mean_vectors(ev, "event_type", "vector").withColumnRenamed("mean_vector", "iv")
    cos = F.round(V.cosine(F.col("uv"), F.col("iv")), 6)
    return T.table(spark, d, "events").join(users, "user_id", "left").join(
        kinds, "event_type", "left").select(
        "event_id", "user_id", "event_type", "value", cos.alias("affinity"))


@query(f"WITH {AFFINITY} SELECT event_id, user_id, event_type, affinity FROM aff")
def user_item_affinity(spark, d):
    return affinity(spark, d).drop("value")


@query(f"""WITH {AFFINITY}, c AS (SELECT event_type, affinity AS v FROM aff)
SELECT event_type, count(*) AS n, {r6('min(v)')} AS low, {r6('quantile_cont(v, 0.25)')} AS q1,
  {r6('quantile_cont(v, 0.5)')} AS median, {r6('quantile_cont(v, 0.75)')} AS q3, {r6('max(v)')} AS high
FROM c GROUP BY 1""")
def box_stats(spark, d):
    return D.box_stats(affinity(spark, d), "event_type", "affinity")


@query(f"WITH {AFFINITY} SELECT {r6('corr(affinity, value)')} AS corr, count(*) AS n FROM aff")
def col_corr(spark, d):
    return D.column_correlation(affinity(spark, d), "affinity", "value")


@query(f"""WITH {AFFINITY}, a AS (SELECT event_id, round(affinity, 4) AS affinity FROM aff)
SELECT event_id, affinity + 0.0 AS affinity, {r6('''(rank() OVER (ORDER BY affinity)
  + (count(*) OVER (PARTITION BY affinity) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER ()''')} AS pct_rank FROM a""")
def pct_rank(spark, d):
    rows = stage(
        affinity(spark, d).select("event_id", F.round("affinity", 4).alias("affinity")), "affinity")
    return D.percentile_rank(rows, "affinity").select("event_id", "affinity", "pct_rank")


# --- popularity ---------------------------------------------------------------------------

@query(f"WITH {RATINGS}, {POPULAR} SELECT item_id, n_ratings FROM pop")
def popular_items(spark, d):
    return P.popular_items(ratings(spark, d))


BLENDED = f"""st AS (SELECT item_id, count(*) AS n_ratings, avg(rating) AS avg_rating FROM ratings GROUP BY 1),
bl AS (SELECT item_id, n_ratings, {r6('''0.5 * n_ratings + 0.5 * avg_rating
  * (max(n_ratings) OVER () / max(avg_rating) OVER ())''')} AS score FROM st)"""


@query(f"""WITH {RATINGS}, {BLENDED} SELECT item_id, n_ratings, score FROM (SELECT *,
  row_number() OVER (ORDER BY score DESC, {digest('item_id')}) AS rn, count(*) OVER () AS n_items FROM bl)
WHERE rn <= floor(n_items * 0.2)""")
def popular_blended(spark, d):
    _, top = P.popular_items_blended(ratings(spark, d))
    return top.select("item_id", "n_ratings", "score")


# --- splits and samples -----------------------------------------------------------------------

@query(f"WITH {SEQ} SELECT user_id, item_id, split FROM seq")
def split_sequential(spark, d):
    return P.split_sequential(ratings(spark, d)).select("user_id", "item_id", "split")


@query(f"WITH {DRAWN} SELECT user_id, item_id, CASE WHEN rn <= 4 THEN 'test' ELSE 'train' END AS split FROM drawn")
def split_random_k(spark, d):
    return P.split_random_k(ratings(spark, d), k=4).select("user_id", "item_id", "split")


@query(f"WITH {DRAWN} SELECT user_id, item_id, CASE WHEN rn = 1 THEN 'test' ELSE 'train' END AS split FROM drawn")
def split_leave_one_out(spark, d):
    return P.split_leave_one_out(ratings(spark, d)).select("user_id", "item_id", "split")


@query(f"""WITH {DRAWN} SELECT user_id, item_id, CASE WHEN rn <= 4 THEN 'train' ELSE 'test' END AS split
FROM drawn WHERE n_rows >= 5""")
def split_four_rest(spark, d):
    return P.split_first_k_train(ratings(spark, d)).select("user_id", "item_id", "split")


@query(f"""WITH {RATINGS} SELECT user_id, item_id, CASE WHEN {digest_int(UI)} / CAST(268435456 AS DOUBLE) < 0.2
  THEN 'test' ELSE 'train' END AS split FROM ratings""")
def split_global(spark, d):
    return P.split_global(T.ratings(spark, d)).select("user_id", "item_id", "split")


EXACT = f"""ex AS (SELECT user_id, item_id, CASE WHEN row_number() OVER (ORDER BY {UI})
  <= ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM ratings)"""


@query(f"""WITH {RATINGS}, {POPULAR}, {EXACT} SELECT user_id, item_id, split FROM ex
WHERE split = 'train' OR item_id IN (SELECT item_id FROM pop)""")
def split_pop_random(spark, d):
    r = ratings(spark, d)
    split = P.split_global_exact(r)
    return P.restrict_by_popularity(split, P.popular_items(r), which="popular").select(
        "user_id", "item_id", "split")


GLOBAL_SEQ = f"""gs AS (SELECT user_id, item_id, CASE WHEN row_number() OVER (ORDER BY ts, {UI})
  <= floor(count(*) OVER () * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM ratings)"""


@query(f"""WITH {RATINGS}, {POPULAR}, {GLOBAL_SEQ} SELECT user_id, item_id, split FROM gs
WHERE split = 'train' OR item_id NOT IN (SELECT item_id FROM pop)""")
def split_pop_sequential(spark, d):
    r = ratings(spark, d)
    split = P.split_global_sequential(r)
    return P.restrict_by_popularity(split, P.popular_items(r), which="unpopular").select(
        "user_id", "item_id", "split")


BLENDED_TOP = f"""{BLENDED},
pop AS (SELECT item_id FROM (SELECT *, row_number() OVER (ORDER BY score DESC, {digest('item_id')}) AS rn,
  count(*) OVER () AS n_items FROM bl) WHERE rn <= floor(n_items * 0.2))"""


def _pop_split(spark, d, how, which, measure="count"):
    return P.split_by_popularity(ratings(spark, d), how, which, measure).select("user_id", "item_id", "split")


@query(f"""WITH {RATINGS}, {POPULAR}, {EXACT} SELECT user_id, item_id, split FROM ex
WHERE split = 'train' OR item_id NOT IN (SELECT item_id FROM pop)""")
def split_pop_random_unpopular(spark, d):
    return _pop_split(spark, d, "random", "unpopular")


@query(f"WITH {RATINGS}, {EXACT} SELECT user_id, item_id, split FROM ex")
def split_pop_random_both(spark, d):
    return _pop_split(spark, d, "random", "both")


@query(f"""WITH {RATINGS}, {POPULAR}, {GLOBAL_SEQ} SELECT user_id, item_id, split FROM gs
WHERE split = 'train' OR item_id IN (SELECT item_id FROM pop)""")
def split_pop_sequential_popular(spark, d):
    return _pop_split(spark, d, "sequential", "popular")


@query(f"WITH {RATINGS}, {GLOBAL_SEQ} SELECT user_id, item_id, split FROM gs")
def split_pop_sequential_both(spark, d):
    return _pop_split(spark, d, "sequential", "both")


@query(f"""WITH {RATINGS}, {BLENDED_TOP}, {EXACT} SELECT user_id, item_id, split FROM ex
WHERE split = 'train' OR item_id IN (SELECT item_id FROM pop)""")
def split_pop_blended(spark, d):
    return _pop_split(spark, d, "random", "popular", "blended")


@query(f"""WITH {DRAWN} SELECT user_id, item_id, title, rating, CAST(rn AS INTEGER) AS rn FROM drawn WHERE rn <= 4 AND n_rows >= 4""")
def fewshot_history(spark, d):
    return P.history(T.titled_ratings(spark, d)).select("user_id", "item_id", "title", "rating", "rn")


@query(f"""WITH {TITLED}, num AS (SELECT *, row_number() OVER (ORDER BY {UI}) - 1 AS row_idx FROM titled),
n AS (SELECT count(*) AS n_rows FROM titled),
draws AS (SELECT p_partkey AS target_id, k AS draw, {digest_int(digest('p_partkey', 'k'))} % n_rows AS row_idx
  FROM part, range(1, 5) r(k), n)
SELECT target_id, CAST(draw AS INTEGER) AS draw, user_id, item_id, title, rating FROM draws JOIN num USING (row_idx)""")
def global_history(spark, d):
    targets = T.table(spark, d, "part").select(F.col("p_partkey").alias("target_id"))
    pool = titled(spark, d)
    return P.global_history(targets, pool, "target_id", ["user_id", "item_id"]).select(
        "target_id", "draw", "user_id", "item_id", "title", "rating")


@query(f"""WITH {RATINGS} SELECT user_id FROM (SELECT DISTINCT user_id FROM ratings)
ORDER BY {digest('user_id')} LIMIT 100""")
def sample_users(spark, d):
    return P.sample_keys(T.ratings(spark, d), "user_id", 100)


@query(f"""WITH {RATINGS}, its AS (SELECT item_id, row_number() OVER (ORDER BY {digest('item_id')}) - 1 AS row_idx
  FROM (SELECT DISTINCT item_id FROM ratings)), n AS (SELECT count(*) AS n_items FROM its),
dr AS (SELECT user_id, item_id AS pos_item, k AS draw, {digest_int(digest('user_id', 'item_id', 'k'))} % n_items AS row_idx
  FROM ratings, range(1, 5) r(k), n)
SELECT user_id, pos_item, CAST(draw AS INTEGER) AS draw, item_id, 0 AS label FROM dr JOIN its USING (row_idx)
UNION ALL SELECT user_id, item_id, 0, item_id, 1 FROM ratings""")
def neg_sampling(spark, d):
    r = ratings(spark, d)
    return P.negative_samples(r, r.select("item_id").distinct())


@query(f"""WITH {RATINGS}, {POPULAR}, {EXACT} SELECT user_id, item_id,
  CASE WHEN item_id IN (SELECT item_id FROM pop) THEN 'popular' ELSE 'unpopular' END AS part FROM ex WHERE split = 'test'""")
def union_results(spark, d):
    """Popular and unpopular test rows, united."""
    r = ratings(spark, d)
    test = P.split_global_exact(r).filter(F.col("split") == "test").select("user_id", "item_id")
    popular = P.popular_items(r).select("item_id")
    return test.join(popular, "item_id", "left_semi").withColumn("part", F.lit("popular")).unionByName(
        test.join(popular, "item_id", "left_anti").withColumn("part", F.lit("unpopular")))
