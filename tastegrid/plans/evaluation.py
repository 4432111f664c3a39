"""Registered queries: evaluation of predictions, rankings and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid.operators import (
    evaluate as E, models as M, neighbors as N, report as R, splits as P, textmetrics as X,
)
from tastegrid.plans.base import (
    LOO, RATINGS, SEQ, digest, digest_int, item_neighbors, r6, sequential, side, user_neighbors,
    weighted_neighbors,
)
from tastegrid.plans.cleaning import SCORED
from tastegrid.plans.predictions import BIAS, ITEM_KNN, RECOMMEND, _IK, leave_one_out
from tastegrid.session import fresh_path, stage
from tastegrid.sources import tables as T, writers as O

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


# --- prediction tables ------------------------------------------------------------------

USABLE = f"""{RATINGS}, {SCORED},
ok AS (SELECT *, TRY_CAST(predicted_rating AS DOUBLE) AS p FROM scored WHERE TRY_CAST(predicted_rating AS DOUBLE) IS NOT NULL)"""


def predictions(spark, d):
    return T.scored_text(T.ratings(spark, d)).withColumnRenamed("rating", "actual_rating")


@query(f"""WITH {RATINGS}, {SCORED}, v AS (SELECT 'method ' || item_id % 3 AS method, actual_rating AS a,
  TRY_CAST(predicted_rating AS DOUBLE) AS p FROM scored)
SELECT method, count(p) AS n, count(*) - count(p) AS n_failed, {r6('sqrt(avg((a - p) * (a - p)))')} AS rmse,
  {r6('avg(abs(a - p))')} AS mae FROM v GROUP BY 1""")
def eval_rmse_mae(spark, d):
    rows = predictions(spark, d).select(
        F.concat(F.lit("method "), (F.col("item_id") % 3).cast("string")).alias("method"),
        "actual_rating", F.col("predicted_rating").try_cast("double").alias("p"))
    return E.rmse_mae(rows, "actual_rating", "p", ["method"])


@query(f"""WITH {USABLE}, m AS (SELECT count(*) AS n, avg((actual_rating - p) ** 2) AS mse,
  stddev_samp((actual_rating - p) ** 2) / sqrt(count(*)) AS sse, avg(abs(actual_rating - p)) AS mae,
  stddev_samp(abs(actual_rating - p)) / sqrt(count(*)) AS sae FROM ok WHERE p > 0)
SELECT n, {r6('sqrt(mse)')} AS rmse, {r6('sqrt(greatest(mse - 1.96 * sse, 0))')} AS rmse_low,
  {r6('sqrt(mse + 1.96 * sse)')} AS rmse_high, {r6('sse')} AS stderr_se, {r6('mae')} AS mae,
  {r6('mae - 1.96 * sae')} AS mae_low, {r6('mae + 1.96 * sae')} AS mae_high, {r6('sae')} AS stderr_ae FROM m""")
def eval_ci(spark, d):
    rows = E.positive_predictions(E.numeric_predictions(predictions(spark, d)))
    return E.confidence_interval(rows, "actual_rating", "predicted_value")


@query(f"""WITH {USABLE}, c AS MATERIALIZED (
  SELECT CAST(round(actual_rating * 1000000) AS BIGINT) AS a, CAST(round(p * 1000000) AS BIGINT) AS b, count(*) AS f,
    avg((actual_rating - p) ** 2) AS se, avg(abs(actual_rating - p)) AS ae FROM ok GROUP BY 1, 2),
t AS (SELECT mean, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY mean ORDER BY k) AS cdf
  FROM (SELECT m.f AS mean, unnest(range(200)) AS k FROM (SELECT DISTINCT f FROM c WHERE f <= 64) m)),
cdfs AS MATERIALIZED (SELECT mean, list(cdf) AS cdf FROM t GROUP BY 1),
u AS (SELECT rep, f, se, ae, {digest('rep', 'a', 'b')} AS h FROM c, range(10000) r(rep)),
v AS (SELECT rep, f, se, ae, ({digest_int('h')} + 0.5) / CAST(268435456 AS DOUBLE) AS u1,
  ({digest_int('substr(h, 8, 7)')} + 0.5) / CAST(268435456 AS DOUBLE) AS u2 FROM u),
z AS (SELECT v.*, cdf, sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) AS z FROM v LEFT JOIN cdfs ON mean = f),
d AS (SELECT rep, se, ae, CASE WHEN f <= 64 THEN len(list_filter(cdf, lambda x: x <= u1))
  ELSE greatest(floor(f + sqrt(f) * z + (z * z - 1) / 6 + 0.5), 0) END AS m FROM z),
r AS (SELECT rep, sqrt(sum(m * se) / nullif(sum(m), 0)) AS rmse, sum(m * ae) / nullif(sum(m), 0) AS mae FROM d GROUP BY 1)
SELECT count(*) AS n_resamples, {r6('quantile_cont(rmse, 0.025)')} AS rmse_low, {r6('quantile_cont(rmse, 0.975)')} AS rmse_high,
  {r6('quantile_cont(mae, 0.025)')} AS mae_low, {r6('quantile_cont(mae, 0.975)')} AS mae_high FROM r""")
def eval_bootstrap(spark, d):
    rows = E.numeric_predictions(predictions(spark, d))
    return E.bootstrap_interval(rows, "actual_rating", "predicted_value")


@query(f"""WITH {USABLE}, m AS (SELECT item_id % 10 AS run_id, {r6('sqrt(avg((actual_rating - p) ** 2))')} AS rmse,
  {r6('avg(abs(actual_rating - p))')} AS mae FROM ok GROUP BY 1)
SELECT count(*) AS n_runs, {r6('avg(rmse)')} AS avg_rmse, {r6('avg(mae)')} AS avg_mae FROM m""")
def eval_runs(spark, d):
    rows = E.numeric_predictions(predictions(spark, d)).withColumn("run_id", F.col("item_id") % 10)
    return E.average_over_runs(rows, "actual_rating", "predicted_value")


@query(f"""WITH {RATINGS}, {SCORED} SELECT 'method ' || item_id % 3 AS method,
  count(*) FILTER (WHERE TRY_CAST(predicted_rating AS DOUBLE) IS NULL) AS n_failed, count(*) AS n FROM scored GROUP BY 1""")
def failures_by_method(spark, d):
    rows = predictions(spark, d).withColumn(
        "method", F.concat(F.lit("method "), (F.col("item_id") % 3).cast("string")))
    return E.failures_by_method(rows, "method", "predicted_rating")


# --- methods report ------------------------------------------------------------------------

METHODS = f"""{SEQ}, {BIAS},
tm AS (SELECT title, {r6('avg(rating)')} AS m FROM train GROUP BY 1),
um AS (SELECT user_id, {r6('avg(rating)')} AS m FROM train GROUP BY 1),
preds AS (SELECT 'bias baseline' AS method, user_id, rating, baseline AS p FROM bias
  UNION ALL SELECT 'title mean', t.user_id, t.rating, m FROM test t LEFT JOIN tm ON tm.title = t.title
  UNION ALL SELECT 'user mean', t.user_id, t.rating, m FROM test t LEFT JOIN um ON um.user_id = t.user_id),
report AS (SELECT method, CASE WHEN user_id % 2 = 0 THEN 'even users' ELSE 'odd users' END AS dataset, count(p) AS n,
  count(*) - count(p) AS n_failed, {r6('sqrt(avg((rating - p) ** 2))')} AS rmse, {r6('avg(abs(rating - p))')} AS mae
  FROM preds GROUP BY 1, 2)"""


def method_tables(spark, d):
    """One result table per numeric predictor."""
    split = sequential(spark, d)
    train, test = side(split, "train"), side(split, "test")
    scored = {
        "bias baseline": M.predict_bias(train, test).withColumnRenamed("baseline", "prediction"),
        "title mean": N.predict_item_mean(train, test, "title"),
        "user mean": N.predict_item_mean(train, test, "user_id"),
    }
    group = F.when(F.col("user_id") % 2 == 0, "even users").otherwise("odd users")
    return [
        E.rmse_mae(rows.withColumns({"method": F.lit(name), "dataset": group}), "rating", "prediction",
                   ["method", "dataset"])
        for name, rows in scored.items()
    ]


@query(f"""WITH {METHODS} SELECT method, dataset, n, rmse, mae FROM report
WHERE contains(method, 'mean') AND NOT contains(method, 'Title') AND dataset IN ('even users', 'odd users')""")
def report_methods(spark, d):
    return R.method_report(
        method_tables(spark, d), include=["mean"], exclude=["Title"],
        datasets=["even users", "odd users"], drop=["n_failed"])


@query(f"""WITH {METHODS}, e AS (SELECT * FROM report WHERE dataset = 'even users')
SELECT min(rmse) AS best_rmse, (SELECT method FROM e ORDER BY rmse, method LIMIT 1) AS best_rmse_method,
  max(rmse) AS worst_rmse, (SELECT method FROM e ORDER BY rmse DESC, method DESC LIMIT 1) AS worst_rmse_method,
  min(mae) AS best_mae, max(mae) AS worst_mae FROM e""")
def best_worst(spark, d):
    rows = R.union_results(method_tables(spark, d)).filter(F.col("dataset") == "even users")
    return E.best_and_worst(rows)


@query(f"WITH {METHODS} SELECT method, dataset, n, n_failed, rmse, mae FROM report")
def src_tsv(spark, d):
    """The report as a tab-separated file and back."""
    path = fresh_path(spark, "report-tsv")
    O.write_tsv(R.union_results(method_tables(spark, d)), path)
    return spark.read.schema(
        "method STRING, dataset STRING, n BIGINT, n_failed BIGINT, rmse DOUBLE, mae DOUBLE"
    ).option("sep", "\t").option("header", True).csv(path)


# --- rankings --------------------------------------------------------------------------------

_HR = ", ".join(
    f"{r6(f'avg(CASE WHEN position <= {k} THEN 1 ELSE 0 END)')} AS hr_{k}, "
    f"{r6(f'avg(CASE WHEN position <= {k} THEN 1 / log2(position + 1) ELSE 0 END)')} AS ndcg_{k}" for k in (5, 10)
)


@query(f"""WITH {LOO}, {weighted_neighbors('user', 4)}, {RECOMMEND},
pos AS (SELECT t.user_id, rec.rn AS position FROM test t LEFT JOIN rec ON rec.user_id = t.user_id AND rec.item_id = t.item_id)
SELECT count(*) AS n_users, {_HR} FROM pos""")
def eval_hr_ndcg(spark, d):
    """Recommendation lists against each user's held-out item."""
    train, test = leave_one_out(spark, d)
    lists = N.recommend_from_neighbors(train, user_neighbors(train, 4), 10)
    positions = test.select("user_id", "item_id").join(
        lists.select("user_id", "item_id", F.col("rn").alias("position")), ["user_id", "item_id"], "left")
    return E.hr_ndcg(positions)


@query(f"""WITH {LOO}, {weighted_neighbors('item', 20)},
its AS (SELECT item_id, row_number() OVER (ORDER BY {digest('item_id')}) - 1 AS row_idx
  FROM (SELECT DISTINCT item_id FROM ratings)), n AS (SELECT count(*) AS n_items FROM its),
cand AS (SELECT user_id, item_id, 1 AS label FROM test UNION ALL
  SELECT DISTINCT user_id, its.item_id, 0 FROM (SELECT user_id, {digest_int(digest('user_id', 'item_id', 'k'))} % n_items AS row_idx
    FROM test, range(1, 20) r(k), n) JOIN its USING (row_idx)),
cd AS (SELECT DISTINCT user_id, item_id FROM cand),
{ITEM_KNN.format(p=_IK, pairs='cd')},
sc AS (SELECT cand.*, coalesce(prediction, CAST('-infinity' AS DOUBLE)) AS s FROM cand LEFT JOIN ik USING (user_id, item_id)),
pos AS (SELECT p.user_id, p.item_id, count(*) FILTER (WHERE q.s > p.s OR (q.s = p.s AND q.item_id < p.item_id)) + 1 AS position
  FROM sc p LEFT JOIN sc q ON q.user_id = p.user_id AND q.label = 0 WHERE p.label = 1 GROUP BY 1, 2)
SELECT count(*) AS n_users, {_HR} FROM pos""")
def eval_loo_rank(spark, d):
    """Held-out item against 19 drawn items, scored from the user's own ratings."""
    train, test = leave_one_out(spark, d, ["user_id", "item_id", "rating"])
    pool = train.select("item_id").unionByName(test.select("item_id")).distinct()
    candidates = stage(P.negative_samples(test, pool, num_negatives=19), "candidates")
    pairs = candidates.select("user_id", "item_id").distinct()
    scored = N.predict_item_knn(train, pairs, item_neighbors(train))
    rows = candidates.select("user_id", "item_id", "label").join(scored, ["user_id", "item_id"])
    return E.hr_ndcg(E.candidate_positions(rows, "user_id", "item_id", "prediction", "label"))


@query(f"""WITH c AS (SELECT quality AS t, 1 - toxic AS p FROM labels),
s AS (SELECT t AS class, 1 AS support, 0 AS called, CASE WHEN t = p THEN 1 ELSE 0 END AS hit FROM c
  UNION ALL SELECT p, 0, 1, 0 FROM c),
g AS (SELECT class, sum(support) AS support, sum(called) AS called, sum(hit) AS hit FROM s GROUP BY 1)
SELECT class, {r6('coalesce(hit / CAST(nullif(called, 0) AS DOUBLE), 0)')} AS precision,
  {r6('coalesce(hit / CAST(nullif(support, 0) AS DOUBLE), 0)')} AS recall,
  {r6('coalesce(2 * hit / CAST(nullif(called + support, 0) AS DOUBLE), 0)')} AS f1, CAST(support AS BIGINT) AS support FROM g""")
def class_report(spark, d):
    rows = T.table(spark, d, "labels").withColumn("predicted", 1 - F.col("toxic"))
    return E.class_report(rows, "quality", "predicted")


# --- texts -------------------------------------------------------------------------------------

PAIRS = """pairs AS (SELECT u.conv_id || '-' || u.turn AS pair_id, u.text AS reference, a.text AS output
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
tok AS (SELECT pair_id, 1 AS ref, list_filter(regexp_split_to_array(reference, '\\s+'), lambda t: t <> '') AS w FROM pairs
  UNION ALL SELECT pair_id, 0, list_filter(regexp_split_to_array(output, '\\s+'), lambda t: t <> '') FROM pairs),
grams AS (SELECT pair_id, ref, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
  FROM tok, range(1, 5) r(n)),
cnt AS (SELECT pair_id, n, g, sum(ref) AS r, sum(1 - ref) AS o FROM grams GROUP BY 1, 2, 3),
ov AS (SELECT pair_id, n, sum(least(r, o)) AS m, sum(o) AS ot, count(*) FILTER (WHERE r > 0 AND o > 0) AS ms,
  count(*) FILTER (WHERE o > 0) AS os, count(*) FILTER (WHERE r > 0) AS rs FROM cnt GROUP BY 1, 2)"""


def text_pairs(spark, d):
    """Each user turn as the reference of the assistant turn that follows."""
    turns = T.table(spark, d, "conversations")
    user = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("reference"))
    reply = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return user.join(reply, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"),
        "reference", "output")


def _bleu_sql() -> str:
    weights = {1: (1.0,), 2: (0.5, 0.5), 3: (0.33,) * 3, 4: (0.25,) * 4}
    cols = []
    for n, ws in weights.items():
        logs = " + ".join(f"{w} * l{i + 1}" for i, w in enumerate(ws))
        cols.append(f"CASE WHEN coalesce(m1, 0) = 0 THEN 0 ELSE {r6(f'coalesce(bp * exp({logs}), 0)')} END AS bleu_{n}")
    wide = ", ".join(
        f"max(m) FILTER (WHERE n = {n}) AS m{n}, max(ot) FILTER (WHERE n = {n}) AS c{n}" for n in weights)
    logs = ", ".join(
        f"ln(CASE WHEN coalesce(m{n}, 0) > 0 THEN m{n} / CAST(c{n} AS DOUBLE) WHEN rl < 5 THEN 0.1 / greatest(coalesce(c{n}, 0), 1) END) AS l{n}"
        for n in weights)
    return f"""WITH {PAIRS},
len AS (SELECT pair_id, max(len(w)) FILTER (WHERE ref = 1) AS rl, max(len(w)) FILTER (WHERE ref = 0) AS ol FROM tok GROUP BY 1),
wide AS (SELECT pair_id, {wide} FROM ov GROUP BY 1),
lg AS (SELECT pair_id, m1, {logs}, CASE WHEN ol = 0 THEN 0 WHEN ol > rl THEN 1 ELSE exp(1 - rl / CAST(ol AS DOUBLE)) END AS bp
  FROM len LEFT JOIN wide USING (pair_id))
SELECT pair_id, {', '.join(cols)} FROM lg"""


@query(_bleu_sql())
def bleu(spark, d):
    return X.bleu(text_pairs(spark, d), "pair_id", "reference", "output")


@query(f"""WITH {PAIRS}, x AS (SELECT pair_id, n, coalesce(ms / CAST(nullif(rs, 0) AS DOUBLE), 0) AS r,
  coalesce(ms / CAST(nullif(os, 0) AS DOUBLE), 0) AS p FROM ov WHERE n <= 2)
SELECT pair_id, CAST(n AS INTEGER) AS n, {r6('r')} AS recall, {r6('p')} AS precision,
  {r6('coalesce(2 * p * r / nullif(p + r, 0), 0)')} AS f1 FROM x""")
def rouge_n(spark, d):
    return X.rouge_n(text_pairs(spark, d), "pair_id", "reference", "output")


@query()
def rouge_l(spark, d):
    return X.rouge_l(text_pairs(spark, d), "pair_id", "reference", "output")
