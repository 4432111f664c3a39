"""Registered queries: predictions, recommendations, context text, scoring and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid import constants as C
from tastegrid.functions import vectors as V
from tastegrid.operators import (
    blocktrain as BT, context as X, evaluate as E, models as M, neighbors as N, scoring as B, similarity as S,
    splits as P, vectorsim as VS,
)
from tastegrid.plans.base import (
    DRAWN, LOO, SEQ, TITLED, UI, USER_NEIGHBORS, item_edges, item_neighbors, neighbors_by, neighbors_cte, r6, ratings, sequential, side,
    titled, user_neighbors, weighted_neighbors,
)
from tastegrid.plans.cleaning import POPULAR
from tastegrid.plans.profiling import event_vectors
from tastegrid.plans.similarities import BY_ITEM, HISTORY_SIM, ITEM_VECS, item_vectors
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


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, target: str) -> str:
    before, after = template.split("{target}")
    return f"{quoted(before)} || {target} || {quoted(after)}"


def leave_one_out(spark, d, columns=None):
    """Train and test side; with ``columns`` no others are carried."""
    rows = stage(T.titled_ratings(spark, d).select(*columns), "titled") if columns else titled(spark, d)
    split = stage(P.split_leave_one_out(rows), "held-out")
    return side(split, "train"), side(split, "test")


# --- numeric predictions --------------------------------------------------------------

USER_KNN = """um AS (SELECT user_id, avg(rating) AS m FROM train GROUP BY 1),
im AS (SELECT item_id, avg(rating) AS m FROM train GROUP BY 1), gm AS (SELECT avg(rating) AS m FROM train),
w AS (SELECT t.user_id, t.item_id, sum(nb.sim * (h.rating - um.m)) / nullif(sum(abs(nb.sim)), 0) AS shift, count(*) AS n
  FROM test t JOIN user_nb nb ON nb.a = t.user_id JOIN train h ON h.user_id = nb.b AND h.item_id = t.item_id
  JOIN um ON um.user_id = nb.b GROUP BY 1, 2),
uk AS (SELECT t.user_id, t.item_id, t.rating, coalesce(n, 0) AS n_neighbors,
  """ + r6("coalesce(um.m + shift, um.m, im.m, gm.m)") + """ AS prediction
  FROM test t LEFT JOIN w ON w.user_id = t.user_id AND w.item_id = t.item_id
  LEFT JOIN um ON um.user_id = t.user_id LEFT JOIN im ON im.item_id = t.item_id, gm)"""


def user_knn(spark, d):
    split = sequential(spark, d)
    train, test = side(split, "train"), side(split, "test")
    return N.predict_user_knn(train, test, user_neighbors(train, USER_NEIGHBORS))


@query(f"""WITH {SEQ}, {weighted_neighbors('user', USER_NEIGHBORS)}, {USER_KNN}
SELECT user_id, item_id, rating, n_neighbors, prediction FROM uk""")
def pred_user_knn(spark, d):
    return user_knn(spark, d).select("user_id", "item_id", "rating", "n_neighbors", "prediction")


CF_SCORES = f"""SELECT count(*) AS n, count(*) FILTER (WHERE n_neighbors > 0) AS n_covered,
  {r6('sqrt(avg((rating - prediction) * (rating - prediction)))')} AS rmse,
  {r6('avg(abs(rating - prediction))')} AS mae FROM uk"""


def cf_scores(spark, d, similarity="weighted"):
    """Split by time, learn neighbours on train only, predict the test rows, score them."""
    split = sequential(spark, d)
    train, test = side(split, "train"), side(split, "test")
    scored = N.predict_user_knn(train, test, neighbors_by(train, USER_NEIGHBORS, similarity))
    e = F.col("rating") - F.col("prediction")
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_neighbors") > 0).alias("n_covered"),
        F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"),
    )


@query(f"WITH {SEQ}, {weighted_neighbors('user', USER_NEIGHBORS)}, {USER_KNN} {CF_SCORES}")
def cf_pipeline(spark, d):
    return cf_scores(spark, d)


@query(f"WITH {SEQ}, {neighbors_cte('pearson', USER_NEIGHBORS)}, {USER_KNN} {CF_SCORES}")
def cf_pearson(spark, d):
    return cf_scores(spark, d, "pearson")


@query(f"WITH {SEQ}, {neighbors_cte('cosine', USER_NEIGHBORS)}, {USER_KNN} {CF_SCORES}")
def cf_cosine(spark, d):
    return cf_scores(spark, d, "cosine")


@query(f"WITH {SEQ}, {neighbors_cte('jaccard', USER_NEIGHBORS)}, {USER_KNN} {CF_SCORES}")
def cf_jaccard(spark, d):
    return cf_scores(spark, d, "jaccard")


ITEM_KNN = """ik AS (SELECT c.user_id, c.item_id, {p} AS prediction FROM {pairs} c
  JOIN item_nb nb ON nb.a = c.item_id JOIN train h ON h.user_id = c.user_id AND h.item_id = nb.b GROUP BY 1, 2)"""
_IK = r6("sum(nb.sim * h.rating) / nullif(sum(abs(nb.sim)), 0)")


@query(f"""WITH {SEQ}, {weighted_neighbors('item', 20)}, {ITEM_KNN.format(p=_IK, pairs='test')}
SELECT t.user_id, t.item_id, t.rating, prediction FROM test t
LEFT JOIN ik ON ik.user_id = t.user_id AND ik.item_id = t.item_id""")
def pred_item_knn(spark, d):
    split = sequential(spark, d)
    train, test = side(split, "train"), side(split, "test")
    return N.predict_item_knn(train, test, item_neighbors(train)).select(
        "user_id", "item_id", "rating", "prediction")


RECOMMEND = """offered AS (SELECT nb.a AS user_id, r.item_id, """ + r6("sum(nb.sim)") + """ AS score
  FROM user_nb nb JOIN train r ON r.user_id = nb.b GROUP BY 1, 2),
rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn
  FROM offered o WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = o.user_id AND t.item_id = o.item_id))
  WHERE rn <= 10)"""


@query(f"""WITH {LOO}, {weighted_neighbors('user', 4)}, {RECOMMEND}
SELECT user_id, item_id, score, CAST(rn AS INTEGER) AS rn FROM rec""")
def recommend_knn(spark, d):
    train, _ = leave_one_out(spark, d)
    return N.recommend_from_neighbors(train, user_neighbors(train, 4), 10)


BIAS = f"""mu AS MATERIALIZED (SELECT avg(rating) AS mu FROM train),
bu AS MATERIALIZED (SELECT user_id, avg(rating) - any_value(mu) AS b FROM train, mu GROUP BY 1),
bi AS (SELECT item_id, avg(rating - mu - b) AS b FROM train JOIN bu USING (user_id), mu GROUP BY 1),
bias AS (SELECT t.user_id, t.item_id, t.rating, {r6('mu + coalesce(bu.b, 0) + coalesce(bi.b, 0)')} AS baseline
  FROM test t LEFT JOIN bu ON bu.user_id = t.user_id LEFT JOIN bi ON bi.item_id = t.item_id, mu)"""


@query(f"WITH {SEQ.replace('seq AS (', 'seq AS MATERIALIZED (').replace('train AS (', 'train AS MATERIALIZED (')}, {BIAS} SELECT user_id, item_id, rating, baseline FROM bias")
def mf_bias_baseline(spark, d):
    split = sequential(spark, d)
    return M.predict_bias(side(split, "train"), side(split, "test")).select(
        "user_id", "item_id", "rating", "baseline")


_GRID = ", ".join(f"({k}, {n})" for k in (1, 3, 5) for n in (1, 3, 5))


def _sweep_sql(order: str) -> str:
    return f"""WITH {SEQ}, {weighted_neighbors('user', 5)}, grid(k, n) AS (VALUES {_GRID}),
lists AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rank FROM train),
pr AS (SELECT a AS user_id, k, n, sum(sim * rating) / sum(sim) AS p FROM user_nb JOIN lists ON lists.user_id = b
  JOIN grid ON rn <= k AND rank <= n GROUP BY 1, 2, 3)
SELECT CAST(k AS INTEGER) AS n_neighbors, CAST(pr.n AS INTEGER) AS n_ratings, count(*) AS n,
  {r6('sqrt(avg((rating - p) * (rating - p)))')} AS rmse, {r6('avg(abs(rating - p))')} AS mae
FROM test JOIN pr USING (user_id) GROUP BY 1, 2"""


def _sweep(spark, d, how):
    split = sequential(spark, d)
    train, test = side(split, "train"), side(split, "test")
    return N.sweep(test, user_neighbors(train, 5), train, [1, 3, 5], [1, 3, 5], how=how)


@query(_sweep_sql("rating DESC, item_id"))
def sweep_neighbors(spark, d):
    return _sweep(spark, d, "top")


@query(_sweep_sql(UI))
def sweep_random(spark, d):
    """The sweep over random ratings of the neighbours."""
    return _sweep(spark, d, "random")


# --- context text -----------------------------------------------------------------------

@query(f"""WITH {DRAWN} SELECT user_id, item_id, title, rating AS actual_rating,
  {filled(C.ZERO_SHOT_TEMPLATE, "'title: ' || title")} AS prompt FROM drawn WHERE rn = 1 AND n_rows >= 5""")
def ctx_zero_shot(spark, d):
    return X.zero_shot(T.titled_ratings(spark, d), ["title"])


OWN = """own AS (SELECT user_id, string_agg('* Title: ' || title || ', Rating: ' || rating || ' stars', chr(10) ORDER BY rn) AS history
  FROM drawn WHERE rn BETWEEN 2 AND 5 GROUP BY 1)"""


@query(f"""WITH {DRAWN}, h AS (SELECT user_id, string_agg('* title: ' || title || ' - Rating: ' || rating || ' stars', chr(10) ORDER BY rn) AS history
  FROM drawn WHERE rn BETWEEN 2 AND 5 GROUP BY 1)
SELECT d.user_id, item_id, title, rating AS actual_rating,
  {quoted(C.HISTORY_HEADER)} || history || {filled(C.FEW_SHOT_TEMPLATE, "'title: ' || title")} AS prompt
FROM drawn d JOIN h USING (user_id) WHERE rn = 1 AND n_rows >= 5""")
def ctx_few_shot(spark, d):
    return X.few_shot(titled(spark, d), ["title"])


def _cf_sql(history: str, similar: str) -> str:
    return (f"{quoted(C.HISTORY_HEADER)} || {history} || {quoted(C.SIMILAR_HEADER)} || {similar} || "
            + filled(C.CF_TEMPLATE, "'Title: ' || t.title"))


CF_RANDOM = f"""{weighted_neighbors('user', 4)}, {OWN},
lists AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {UI}) AS rank FROM train),
others AS (SELECT a AS user_id, string_agg('* Title: ' || title || ', Rating: ' || rating || ' stars', chr(10) ORDER BY user_nb.rn, rank) AS peers
  FROM user_nb JOIN lists ON lists.user_id = b AND rank <= 1 GROUP BY 1),
cf AS (SELECT t.user_id, t.item_id, t.title, t.rating AS actual_rating, {_cf_sql("history", "coalesce(peers, '')")} AS prompt
  FROM drawn t JOIN own ON own.user_id = t.user_id LEFT JOIN others ON others.user_id = t.user_id WHERE t.rn = 1 AND n_rows >= 5)"""


def cf_random(spark, d):
    """Held-out row, four own ratings, one random rating of each of four neighbours."""
    train, test = leave_one_out(spark, d)
    drawn = stage(X.drawn_rows(train.unionByName(test)), "drawn")
    similar = N.neighbor_ratings(user_neighbors(train, C.SIMILAR_USERS), train, C.RATINGS_PER_NEIGHBOR, "random")
    return X.collaborative(
        drawn.filter(F.col("rn") == 1), drawn.filter(F.col("rn") > 1), similar, ["user_id"])


@query(f"WITH {LOO}, {CF_RANDOM} SELECT * FROM cf")
def ctx_cf_random(spark, d):
    return cf_random(spark, d)


@query(f"""WITH {LOO}, {CF_RANDOM}, {ITEM_VECS}, {HISTORY_SIM}
SELECT cf.*, semantic_sim FROM cf LEFT JOIN hs ON hs.user_id = cf.user_id AND hs.target = cf.item_id""")
def ctx_cf_semantic(spark, d):
    drawn = stage(X.drawn_rows(titled(spark, d)), "drawn")
    close = X.semantic_history(
        drawn.filter(F.col("rn") == 1), drawn.filter(F.col("rn") > 1), item_vectors(spark, d)
    ).select("user_id", F.col("target").alias("item_id"), "semantic_sim")
    return cf_random(spark, d).join(close, ["user_id", "item_id"], "left")


CF_ITEM = f"""{weighted_neighbors('user', 4)}, {item_edges()}, {BY_ITEM.replace('rank <= 2', 'rank <= 1')},
mine AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {UI}) AS k FROM train),
own AS (SELECT user_id, string_agg('* Title: ' || title || ', Rating: ' || rating || ' stars', chr(10) ORDER BY k) AS history
  FROM mine WHERE k <= 4 GROUP BY 1),
others AS (SELECT user_id, target, string_agg('* Title: ' || p_name || ', Rating: ' || rating || ' stars', chr(10) ORDER BY rn, rank) AS peers
  FROM chosen JOIN part ON p_partkey = item_id GROUP BY 1, 2)
SELECT t.user_id, t.item_id, t.title, t.rating AS actual_rating, {_cf_sql("coalesce(history, '')", "coalesce(peers, '')")} AS prompt
FROM test t LEFT JOIN own ON own.user_id = t.user_id LEFT JOIN others ON others.user_id = t.user_id AND others.target = t.item_id"""


def cf_item(spark, d, train, test):
    """Every test row with its neighbours' ratings closest to the target, learned on train."""
    history = P.history(train, k=C.MAIN_USER_RATINGS, complete=False)
    similar = N.neighbor_ratings_by_item(
        test, user_neighbors(train, C.SIMILAR_USERS), S.weighted_pearson(train, axis="item"), train,
        n=C.RATINGS_PER_NEIGHBOR)
    titles = T.items(spark, d).select("item_id", "title")
    return X.collaborative(test, history, similar.join(titles, "item_id"), ["user_id", "target"])


@query(f"WITH {SEQ}, {CF_ITEM}")
def ctx_cf_item(spark, d):
    """Item-aware context for a time split."""
    split = sequential(spark, d)
    return cf_item(spark, d, side(split, "train"), side(split, "test"))


@query(f"WITH {LOO}, {CF_ITEM}")
def ctx_cf_item_random(spark, d):
    """Item-aware context for one random row of each user."""
    return cf_item(spark, d, *leave_one_out(spark, d))


@query(f"""WITH {TITLED}, {POPULAR}, marked AS (SELECT *, row_number() OVER (ORDER BY {UI})
  <= ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) AS is_test FROM titled),
train AS (SELECT user_id, item_id, rating, ts, title FROM marked WHERE NOT is_test),
test AS (SELECT user_id, item_id, rating, ts, title FROM marked WHERE is_test AND item_id IN (SELECT item_id FROM pop)), {CF_ITEM}""")
def ctx_cf_item_popular(spark, d):
    """Item-aware context for random rows of popular items."""
    split = stage(P.split_by_popularity(titled(spark, d), "random", "popular", required=("title",)), "pop-split")
    return cf_item(spark, d, side(split, "train"), side(split, "test"))


GROUPED = f"""{weighted_neighbors('user', 4)},
lists AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS rank FROM train)"""


@query(f"""WITH {LOO}, {GROUPED},
blocks AS (SELECT a AS user_id, b, user_nb.rn, sim, string_agg(rank || '. ' || title || ', ' || rating, chr(10) ORDER BY rank) AS block
  FROM user_nb JOIN lists ON lists.user_id = b AND rank <= 3 GROUP BY 1, 2, 3, 4)
SELECT user_id, string_agg('+ User ' || b || ' (similarity ' || printf('%.6f', sim) || '):' || chr(10) || block, chr(10) ORDER BY rn) AS context
FROM blocks GROUP BY 1""")
def ctx_grouped(spark, d):
    """Each neighbour's best ratings listed under the neighbour."""
    train, _ = leave_one_out(spark, d)
    return X.grouped_by_neighbor(N.neighbor_ratings(user_neighbors(train, 4), train, 3, "top"))


@query(f"""WITH {LOO}, {GROUPED},
seen AS (SELECT a AS user_id, b, user_nb.rn, sim, item_id, rating FROM user_nb JOIN train ON train.user_id = b)
SELECT user_id, item_id, min(rating) AS lowest, max(rating) AS highest, count(*) AS n_neighbors,
  string_agg(b || '=' || rating || '=' || printf('%.6f', sim), '; ' ORDER BY rn) AS said
FROM seen GROUP BY 1, 2 HAVING min(rating) < max(rating)""")
def neighbor_conflicts(spark, d):
    """Items that a user's neighbours rated differently, over all their ratings."""
    train, _ = leave_one_out(spark, d)
    return N.conflicts(N.neighbor_ratings(user_neighbors(train, 4), train, how="all"))


# --- scoring and repair -------------------------------------------------------------------

@query(f"WITH {TITLED} SELECT user_id, item_id, CAST(length(title) AS BIGINT) AS score FROM titled")
def score_batches(spark, d):
    """A pure function in the place of a model: each distinct title is scored once."""
    rows = titled(spark, d).select("user_id", "item_id", "title")
    return B.score_batches(rows, lambda titles: [len(t) for t in titles], "title", "score", "bigint").drop("title")


@query(f"""WITH {LOO}, {USER_KNN.split('w AS')[0]}
scored AS (SELECT user_id, item_id, title, rating, CASE user_id % 7 WHEN 0 THEN '(None, ''Error'')' WHEN 1 THEN ''
    ELSE CAST(CAST(1 + (user_id + item_id) % 5 AS DOUBLE) AS VARCHAR) END AS predicted_rating FROM test),
tm AS (SELECT title, {r6('avg(rating)')} AS m FROM train GROUP BY 1)
SELECT user_id, item_id, CASE WHEN TRY_CAST(predicted_rating AS DOUBLE) IS NULL THEN coalesce(CAST(m AS VARCHAR), predicted_rating)
    ELSE predicted_rating END AS predicted_rating,
  TRY_CAST(predicted_rating AS DOUBLE) IS NULL AND m IS NOT NULL AS repaired
FROM scored LEFT JOIN tm USING (title)""")
def repair_failed(spark, d):
    """Failed predictions are scored again from the title's mean rating on train."""
    train, test = leave_one_out(spark, d)
    first = T.scored_text(test)
    again = N.predict_item_mean(
        train, B.failed_rows(first).select("user_id", "item_id", "title"), "title"
    ).withColumnRenamed("prediction", "predicted_rating")
    return B.repair(first, again, ["user_id", "item_id"]).select(
        "user_id", "item_id", "predicted_rating", "repaired")


def answers(prompts):
    """A pure function in the place of a model: some prompts fail again."""
    return ["" if len(p) % 11 == 0 else str(1.0 + len(p) % 5) for p in prompts]


def _repair_sql(prompts: str) -> str:
    """Results of a repair from the CTEs ``scored`` and ``bad``, and a query of (user_id, item_id, prompt)."""
    return f"""prompts AS ({prompts}),
again AS (SELECT *, CASE WHEN length(prompt) % 11 <> 0 THEN CAST(CAST(1 + length(prompt) % 5 AS DOUBLE) AS VARCHAR) END AS fresh FROM prompts)
SELECT user_id, item_id, coalesce(fresh, predicted_rating) AS predicted_rating, fresh IS NOT NULL AS repaired, prompt
FROM scored LEFT JOIN again USING (user_id, item_id)"""


def _repaired(test, rebuild):
    return B.repair_in_context(T.scored_text(test), rebuild, answers, ["user_id", "item_id"]).select(
        "user_id", "item_id", "predicted_rating", "repaired", "prompt")


SCORED_TEST = """scored AS (SELECT user_id, item_id, title, rating, CASE user_id % 7 WHEN 0 THEN '(None, ''Error'')' WHEN 1 THEN ''
    ELSE CAST(CAST(1 + (user_id + item_id) % 5 AS DOUBLE) AS VARCHAR) END AS predicted_rating FROM test),
bad AS (SELECT * FROM scored WHERE user_id % 7 < 2)"""
# four other ratings of each failed row's user, from all of the user's ratings
OTHER_FOUR = f"""four AS (SELECT * FROM (SELECT bad.item_id AS target, t.*, row_number() OVER (
    PARTITION BY t.user_id, bad.item_id ORDER BY {UI.replace('user_id', 't.user_id').replace('item_id', 't.item_id')}) AS k
  FROM bad JOIN titled t ON t.user_id = bad.user_id AND t.item_id <> bad.item_id) WHERE k <= 4)"""


@query(f"""WITH {SEQ}, {SCORED_TEST}, {_repair_sql(f"SELECT user_id, item_id, {filled(C.ZERO_SHOT_TEMPLATE, quoted('title: ') + ' || title')} AS prompt FROM bad")}""")
def repair_zero_shot(spark, d):
    """Failed rows of a time split are described and scored again."""
    return _repaired(side(sequential(spark, d), "test"), lambda bad: X.zero_shot_for(bad, ["title"]))


@query(f"""WITH {SEQ}, {SCORED_TEST}, {OTHER_FOUR},
past AS (SELECT user_id, target, string_agg('* title: ' || title || ' - Rating: ' || rating || ' stars', chr(10) ORDER BY k) AS history
  FROM four GROUP BY 1, 2), {_repair_sql(f"""SELECT bad.user_id, item_id, {quoted(C.HISTORY_HEADER)} || coalesce(history, '') ||
  {filled(C.FEW_SHOT_TEMPLATE, "'title: ' || title")} AS prompt FROM bad LEFT JOIN past ON past.user_id = bad.user_id AND target = item_id""")}""")
def repair_few_shot(spark, d):
    """Failed rows get a history of the user's other ratings, without the row itself."""
    split = sequential(spark, d)
    return _repaired(side(split, "test"), lambda bad: X.few_shot_for(bad, split.drop("split"), ["title"]))


_OTHERS_PAST = """past AS (SELECT user_id, target, string_agg('* Title: ' || title || ', Rating: ' || rating || ' stars', chr(10) ORDER BY k) AS history
  FROM four GROUP BY 1, 2)"""
_CF_PROMPT = _cf_sql("coalesce(history, '')", "coalesce(peers, '')")


@query(f"""WITH {SEQ}, {weighted_neighbors('user', 4)}, {SCORED_TEST}, {OTHER_FOUR}, {_OTHERS_PAST},
lists AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {UI}) AS rank FROM train),
others AS (SELECT a AS user_id, string_agg('* Title: ' || title || ', Rating: ' || rating || ' stars', chr(10) ORDER BY user_nb.rn, rank) AS peers
  FROM user_nb JOIN lists ON lists.user_id = b AND rank <= 1 GROUP BY 1), {_repair_sql(f"""SELECT t.user_id, t.item_id, {_CF_PROMPT} AS prompt
  FROM bad t LEFT JOIN past ON past.user_id = t.user_id AND target = t.item_id LEFT JOIN others ON others.user_id = t.user_id""")}""")
def repair_cf(spark, d):
    """Failed rows get their user's other ratings and one random rating of each neighbour."""
    split = sequential(spark, d)
    train, everything = side(split, "train"), split.drop("split")

    def rebuild(bad):
        near = user_neighbors(train, C.SIMILAR_USERS).join(bad.select(F.col("user_id").alias("a")).distinct(), "a", "left_semi")
        similar = N.neighbor_ratings(near, train, C.RATINGS_PER_NEIGHBOR, "random")
        return X.collaborative(bad, X.history_without_target(bad, everything), similar, ["user_id"])

    return _repaired(side(split, "test"), rebuild)


@query(f"""WITH {SEQ}, {weighted_neighbors('user', 4)}, {item_edges()}, {SCORED_TEST}, {OTHER_FOUR}, {_OTHERS_PAST},
{BY_ITEM.replace('rank <= 2', 'rank <= 1').replace('FROM test t', 'FROM bad t')},
others AS (SELECT user_id, target, string_agg('* Title: ' || p_name || ', Rating: ' || rating || ' stars', chr(10) ORDER BY rn, rank) AS peers
  FROM chosen JOIN part ON p_partkey = item_id GROUP BY 1, 2), {_repair_sql(f"""SELECT t.user_id, t.item_id, {_CF_PROMPT} AS prompt
  FROM bad t LEFT JOIN past ON past.user_id = t.user_id AND past.target = t.item_id
  LEFT JOIN others ON others.user_id = t.user_id AND others.target = t.item_id""")}""")
def repair_cf_item(spark, d):
    """Failed rows get their user's other ratings and each neighbour's rating closest to the item."""
    split = sequential(spark, d)
    train, everything = side(split, "train"), split.drop("split")

    def rebuild(bad):
        near = user_neighbors(train, C.SIMILAR_USERS).join(bad.select(F.col("user_id").alias("a")).distinct(), "a", "left_semi")
        similar = N.neighbor_ratings_by_item(
            bad, near, S.weighted_pearson(train, axis="item"), train, n=C.RATINGS_PER_NEIGHBOR)
        titles = T.items(spark, d).select("item_id", "title")
        return X.collaborative(
            bad, X.history_without_target(bad, everything), similar.join(titles, "item_id"), ["user_id", "target"])

    return _repaired(side(split, "test"), rebuild)


@query(f"""SELECT event_id, {r6('1 / (1 + exp(-x))')} AS probability,
  {r6('ln(1 + exp(-abs(x))) + greatest(x, 0) - y * x')} AS loss
FROM (SELECT event_id, (value - 50) / 10 AS x, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events)""")
def log_loss(spark, d):
    x = (F.col("value") - 50) / 10
    y = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    return T.table(spark, d, "events").select(
        "event_id", F.round(V.sigmoid(x), 6).alias("probability"),
        F.round(V.log_loss(x, y), 6).alias("loss"))


# --- models (no SQL form) -------------------------------------------------------------------

def with_negatives(positives, num_negatives):
    """(user_id, item_id, label): the positives, and items drawn for each of them as negatives."""
    drawn = P.negative_samples(positives, positives.select("item_id").distinct(), num_negatives=num_negatives)
    return drawn.select("user_id", "item_id", "label")


@query()
def mf_implicit(spark, d):
    """User and item factors learned from implicit feedback and drawn negatives under logistic loss."""
    model = BT.fit_logistic(with_negatives(ratings(spark, d), C.NUM_NEGATIVES), epochs=4)
    sides = [f.select(F.lit(name).alias("side"), "id", F.col("w").alias("features"))
             for name, f in (("user", model.users), ("item", model.items))]
    return sides[0].unionByName(sides[1])


@query()
def mf_explicit(spark, d):
    split = sequential(spark, d)
    return M.predict_explicit(side(split, "train"), side(split, "test")).select(
        "user_id", "item_id", "rating", "baseline", "prediction")


@query()
def mf_score_pairs(spark, d):
    split = sequential(spark, d)
    model = BT.fit_logistic(with_negatives(side(split, "train"), 1), epochs=4)
    return BT.score_logistic(model, side(split, "test").select("user_id", "item_id", "rating"))


@query()
def ncf_mlp(spark, d):
    """Product branch beside a perceptron tower, labels from negative sampling; test rows are not trained on."""
    halves = stage(P.split_global(with_negatives(ratings(spark, d), 1)), "labelled")
    model = BT.fit_network(side(halves, "train"), epochs=4)
    return BT.score_network(model, side(halves, "test"))


@query()
def cf_latent(spark, d):
    """User kNN with the neighbours that factors of the train rows give."""
    split = sequential(spark, d)
    train, test = side(split, "train"), side(split, "test")
    return N.predict_user_knn(train, test, latent_neighbors(train, 20)).select(
        "user_id", "item_id", "rating", "prediction", "n_neighbors")


def latent_neighbors(train, k):
    """(a, b, sim, rn): users with the nearest factors, by cosine; those of a positive similarity count."""
    users, _ = M.explicit_factors(train)
    near = VS.knn_all(users, "user_id", "vector", k).withColumn("sim", 1 - F.col("distance"))
    return near.filter(F.col("sim") > 0).select("a", "b", "sim", "rn")


@query()
def rf_embeddings(spark, d):
    """Forest regression of event values on the concatenated event and user vectors."""
    from tastegrid.operators.profile import mean_vectors

    ev = event_vectors(spark, d)
    users = mean_vectors(ev, "user_id", "vector")
    rows = P.split_global(ev.join(users, "user_id"), S.Roles("user_id", "event_id"))
    return M.forest_on_vectors(
        side(rows, "train"), side(rows, "test"), ["vector", "mean_vector"], "value"
    ).select("event_id", "value", "prediction")


@query()
def rf_classifier(spark, d):
    rows = P.split_global(T.vectors(spark, d), S.Roles("vec_id", "label"))
    scored = M.forest_on_vectors(side(rows, "train"), side(rows, "test"), ["vector"], "label", classify=True)
    return E.class_report(scored.withColumn("predicted", F.col("prediction").cast("int")), "label", "predicted")


@query(f"""WITH words AS (SELECT p_partkey AS item_id, unnest(regexp_split_to_array(lower(p_name), '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM part),
tf AS (SELECT item_id, term, count(*) AS tf FROM words WHERE length(term) >= 2 GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM part), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT item_id, term, tf, tf * (ln((n + 1) / CAST(df + 1 AS DOUBLE)) + 1) AS w FROM tf JOIN df USING (term), n)
SELECT item_id, term, tf, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY item_id))')} AS weight FROM w""")
def tfidf(spark, d):
    return M.tfidf(T.items(spark, d), "item_id", "title")


@query()
def rf_tfidf(spark, d):
    """Forest on TF-IDF of titles, predicting the item's mean rating."""
    means = T.rating_lines(spark, d).groupBy("item_id").agg(F.avg("rating").alias("rating"))
    rows = P.split_global(T.items(spark, d).join(means, "item_id"), S.Roles("item_id", "title"))
    return M.forest_on_titles(side(rows, "train"), side(rows, "test"), "item_id", "title", "rating").select(
        "item_id", "rating", "prediction")


@query()
def kmeans(spark, d):
    rows, _ = M.kmeans(T.vectors(spark, d), "vector", 3)
    return rows.select("vec_id", "label", "cluster")


@query()
def pca2d(spark, d):
    return M.project_2d(T.vectors(spark, d), "vector").select("vec_id", "label", "x", "y")
