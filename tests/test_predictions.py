"""Predictors against plain Python, and models on data with planted structure."""

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from tastegrid.operators import (
    blocktrain as BT, context as X, evaluate as E, models as M, neighbors as N, similarity as S, splits as P,
    vectorsim as VS,
)


@pytest.fixture(scope="module")
def rated(spark):
    """Two taste groups: group members like one half of the items."""
    rng = random.Random(5)
    rows = []
    for u in range(60):
        for i in rng.sample(range(40), 18):
            liked = (i < 20) == (u < 30)
            rows.append((u, i, float(min(5, max(1, (4 if liked else 2) + rng.choice([-1, 0, 0, 1])))),
                         dt.datetime(2021, 1, 1) + dt.timedelta(days=rng.randrange(300)), f"title {i}"))
    split = P.split_leave_one_out(spark.createDataFrame(rows, ["user_id", "item_id", "rating", "ts", "title"]))
    split = split.cache()
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_user_knn_formula(rated):
    train, test = rated
    neighbors = S.top_neighbors(S.weighted_pearson(train), 10, min_sim=0.0)
    got = {(r["user_id"], r["item_id"]): r for r in rows_of(N.predict_user_knn(train, test, neighbors))}
    ratings = {(r["user_id"], r["item_id"]): r["rating"] for r in rows_of(train)}
    per_user = defaultdict(list)
    for (u, _), r in ratings.items():
        per_user[u].append(r)
    mean = {u: sum(r) / len(r) for u, r in per_user.items()}
    near = defaultdict(list)
    for r in rows_of(neighbors):
        near[r["a"]].append((r["b"], r["sim"]))
    for (u, i), row in got.items():
        used = [(s, ratings[(v, i)] - mean[v]) for v, s in near[u] if (v, i) in ratings]
        want = mean[u] + (sum(s * x for s, x in used) / sum(s for s, _ in used) if used else 0)
        assert row["prediction"] == pytest.approx(want, abs=1e-5) and row["n_neighbors"] == len(used)
    assert len(got) == 60


def test_neighbors_carry_the_planted_taste(rated):
    train, test = rated
    mean_rmse = E.rmse_mae(N.predict_item_mean(train, test, "user_id"), "rating", "prediction").first()["rmse"]
    users = S.top_neighbors(S.weighted_pearson(train), 15, min_sim=0.0)
    items = S.top_neighbors(S.weighted_pearson(train, axis="item"), 15, min_sim=0.0)
    for scored in (N.predict_user_knn(train, test, users), N.predict_item_knn(train, test, items)):
        row = E.rmse_mae(scored, "rating", "prediction").first()
        assert row["rmse"] < mean_rmse and row["rmse"] >= row["mae"]


def test_ratings_nearest_to_the_target(rated):
    train, test = rated
    users = S.top_neighbors(S.weighted_pearson(train), 3, min_sim=0.0)
    items = S.weighted_pearson(train, axis="item")
    got = defaultdict(list)
    for r in sorted(rows_of(N.neighbor_ratings_by_item(test, users, items, train, n=2)), key=lambda r: r["rank"]):
        got[(r["user_id"], r["target"], r["neighbor"])].append(r["item_id"])
    sims = {p: r["sim"] for r in rows_of(items) if r["sim"] > 0 for p in ((r["a"], r["b"]), (r["b"], r["a"]))}
    history = defaultdict(list)
    for r in rows_of(train):
        history[r["user_id"]].append((r["item_id"], r["rating"]))
    near = defaultdict(list)
    for r in rows_of(users):
        near[r["a"]].append(r["b"])
    for t in rows_of(test):
        for v in near[t["user_id"]]:
            order = sorted(history[v], key=lambda x: (-sims.get((t["item_id"], x[0]), -9), -x[1], x[0]))
            assert got[(t["user_id"], t["item_id"], v)] == [i for i, _ in order[:2]]


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_item_knn_sends_only_near_items_that_may_be_rated(spark, kind):
    """User 0 has rated more items than a signature has bits, user 9 none, the others three of 900."""
    rng = random.Random(4)
    rows = [(0, i, float(i % 5 + 1)) for i in range(0, 900, 2)]
    rows += [(u, i, float(rng.randint(1, 5))) for u in range(1, 9) for i in rng.sample(range(900), 3)]
    near = {i: rng.sample([j for j in range(900) if j != i], 15) for i in range(900)}
    train = spark.createDataFrame(rows, "user_id long, item_id long, rating double").withColumn("item_id", F.col("item_id").cast(kind))
    edges = spark.createDataFrame([(a, b, (r + 1) / 16) for a, bs in near.items() for r, b in enumerate(bs)],
                                  "a long, b long, sim double").select(F.col("a").cast(kind), F.col("b").cast(kind), "sim")
    pairs = spark.createDataFrame([(u, i) for u in range(10) for i in range(0, 900, 7)], "user_id long, item_id long").withColumn(
        "item_id", F.col("item_id").cast(kind))
    got = N.predict_item_knn(train, pairs, edges)
    rating = {(u, i): r for u, i, r in rows}
    want = {}
    for u in range(10):
        for i in range(0, 900, 7):
            own = [((r + 1) / 16, rating[u, b]) for r, b in enumerate(near[i]) if (u, b) in rating]
            want[u, i] = sum(s * r for s, r in own) / sum(s for s, _ in own) if own else None
    seen = {(r["user_id"], int(float(r["item_id"]))): r["prediction"] for r in got.collect()}
    assert seen == {k: v if v is None else pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert ("getbit" in got._jdf.queryExecution().optimizedPlan().toString()) == (kind != "double")


def test_similar_items_as_lists_and_by_pair(rated):
    """Few similar items are joined as a list, many looked up by pair, with the same rows."""
    train, test = rated
    users = S.top_neighbors(S.weighted_pearson(train), 3, min_sim=0.0)
    items = S.weighted_pearson(train, axis="item").localCheckpoint()
    users = users.localCheckpoint()
    by_pair, mixed, by_list = (
        sorted(map(str, N.neighbor_ratings_by_item(test, users, items, train, n=2, listed=limit).collect()))
        for limit in (0, 14, 10**6))
    assert by_pair == mixed == by_list and by_pair


def test_recommendations_are_new_items(rated):
    train, _ = rated
    neighbors = S.top_neighbors(S.weighted_pearson(train), 5, min_sim=0.0)
    rec = N.recommend_from_neighbors(train, neighbors, 4)
    assert rec.join(train, ["user_id", "item_id"]).count() == 0
    rated_by = defaultdict(set)
    for r in rows_of(train):
        rated_by[r["user_id"]].add(r["item_id"])
    score = defaultdict(lambda: defaultdict(float))
    for r in rows_of(neighbors):
        for item in rated_by[r["b"]] - rated_by[r["a"]]:
            score[r["a"]][item] += r["sim"]
    want = {
        (u, i) for u, items in score.items()
        for i, _ in sorted(items.items(), key=lambda x: (-round(x[1], 6), x[0]))[:4]
    }
    assert {(r["user_id"], r["item_id"]) for r in rows_of(rec)} == want


def test_sweep_counts_every_setting(rated):
    train, test = rated
    neighbors = S.top_neighbors(S.weighted_pearson(train), 3, min_sim=0.0)
    got = {(r["n_neighbors"], r["n_ratings"]): r for r in rows_of(N.sweep(test, neighbors, train, [1, 3], [1, 2]))}
    assert set(got) == {(1, 1), (1, 2), (3, 1), (3, 2)}
    one = N.sweep(test, neighbors, train, [3], [2]).first()
    assert one["rmse"] == got[(3, 2)]["rmse"]


def test_hit_ratio_grows_with_k(rated):
    train, test = rated
    items = S.top_neighbors(S.weighted_pearson(train, axis="item"), 15, min_sim=0.0)
    cands = P.negative_samples(test, train.select("item_id").distinct(), num_negatives=9)
    scored = N.predict_item_knn(train, cands.select("user_id", "item_id").distinct(), items)
    pos = E.candidate_positions(
        cands.select("user_id", "item_id", "label").join(scored, ["user_id", "item_id"]),
        "user_id", "item_id", "prediction", "label")
    row = E.hr_ndcg(pos, ks=(1, 3, 10)).first()
    assert row["n_users"] == 60 and row["hr_1"] <= row["hr_3"] <= row["hr_10"] == 1.0
    assert row["ndcg_10"] <= row["hr_10"]


def test_negative_samples_shape(rated):
    _, test = rated
    rows = rows_of(P.negative_samples(test, test.select("item_id").distinct(), num_negatives=4))
    assert len(rows) == 60 * 5 and sum(r["label"] for r in rows) == 60


def test_context_texts(rated):
    train, test = rated
    rows = rows_of(X.few_shot(train, ["title"]))
    assert len(rows) == 60
    for r in rows:
        assert r["prompt"].count("\n* title: ") == 4
        assert f"rating for the product title: {r['title']}, (1 being" in r["prompt"]
        assert f"* title: {r['title']} - " not in r["prompt"]
    neighbors = S.top_neighbors(S.weighted_pearson(train), 4, min_sim=0.0)
    similar = N.neighbor_ratings(neighbors, train, 2, "random")
    cf = rows_of(X.collaborative(test, P.history(train), similar, ["user_id"]))
    assert all(r["prompt"].count("* Title: ") <= 4 + 8 for r in cf) and len(cf) == 60
    text = rows_of(X.grouped_by_neighbor(similar))[0]["context"]
    assert text.startswith("+ User ") and "\n1. title " in text


def test_conflicts(rated):
    train, _ = rated
    neighbors = S.top_neighbors(S.weighted_pearson(train), 4, min_sim=0.0)
    for r in rows_of(N.conflicts(N.neighbor_ratings(neighbors, train, how="all"))):
        assert r["lowest"] < r["highest"] and len(r["said"].split("; ")) == r["n_neighbors"] >= 2


def test_explicit_factors_beat_the_mean(rated):
    train, test = rated
    scored = M.predict_explicit(train, test, rank=4, iterations=8)
    spread = test.join(train.groupBy("user_id").agg(F.avg("rating").alias("p")), "user_id")
    assert (E.rmse_mae(scored, "rating", "prediction").first()["rmse"]
            < E.rmse_mae(spread, "rating", "p").first()["rmse"])


@pytest.fixture(scope="module")
def liked(spark):
    """(train, test) labels: user and item are of one of three kinds; positives are of the same kind, and a
    third of them go to one item that everybody likes."""
    rng = random.Random(17)
    rows = []
    for u in range(90):
        for _ in range(24):
            i = rng.randrange(1, 60)
            rows.append((u, i, int(u % 3 == i % 3)))
        rows += [(u, 0, 1)] * 4
    rng.shuffle(rows)
    df = spark.createDataFrame([(u, i, y, n % 5 == 0) for n, (u, i, y) in enumerate(rows)], "user_id int, item_id int, label int, held boolean")
    return df.filter("NOT held").drop("held").cache(), df.filter("held").drop("held").cache()


def log_loss_of(scored):
    p = F.greatest(F.least("prediction", F.lit(1 - 1e-6)), F.lit(1e-6))
    return scored.agg(F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]


def test_logistic_factors(liked):
    train, test = liked
    model = BT.fit_logistic(train, rank=4, epochs=12, blocks=3, rate=0.2)
    assert model.losses[-1] < 0.5 * model.losses[0]
    scored = BT.score_logistic(model, test)
    als = ALS(userCol="user_id", itemCol="item_id", ratingCol="label", rank=4, maxIter=12, implicitPrefs=True, seed=1).fit(train)
    assert log_loss_of(scored) < min(0.33, log_loss_of(als.transform(test)))
    unknown = test.sparkSession.createDataFrame([(0, 999), (None, 1)], "user_id int, item_id int")
    assert [r["prediction"] for r in BT.score_logistic(model, unknown).collect()] == [None, None]
    # the rows' order and partitions decide nothing
    again = BT.fit_logistic(train.repartition(9, "label"), rank=4, epochs=2, blocks=3)
    once = BT.fit_logistic(train, rank=4, epochs=2, blocks=3)
    assert again.losses == once.losses
    a, b = ({r["id"]: r["w"] for r in m.users.collect()} for m in (again, once))
    assert a == b and len(a) == 90


def test_two_branch_network(liked):
    train, test = liked
    model = BT.fit_network(train, rank=4, epochs=10, blocks=3, rate=0.2)
    scored = BT.score_network(model, test).filter("item_id > 0")
    popular = train.groupBy("item_id").agg(F.avg("label").alias("prediction"))

    def right(rows):  # share of (positive, negative) pairs in the right order
        p = [(r["prediction"], r["label"]) for r in rows.collect()]
        pos, neg = [x for x, y in p if y], [x for x, y in p if not y]
        return np.mean([(x > y) + 0.5 * (x == y) for x in pos for y in neg])

    assert right(scored) > 0.8 > right(test.filter("item_id > 0").join(popular, "item_id")) + 0.1
    assert model.losses[-1] < model.losses[0]


def test_ratings_travel_in_chunks(spark):
    """A pair of blocks is many packed rows of bounded size, in the order that one row had, and blocks grow with the rows."""
    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.randrange(40), rng.randrange(30), rng.randrange(2)) for _ in range(3000)],
                                 "user_id int, item_id int, label int")
    sides = [BT._numbered(rows, k, 2, 1) for k in ("user_id", "item_id")]
    packed = BT._packed_ratings(rows, *sides, BT.DEFAULT, "label", 2, chunk=256).collect()
    assert max(len(r.y) for r in packed) == 256 * 8 and len(packed) > 8
    cells = defaultdict(list)
    for r in sorted(packed, key=lambda r: (r.ub, r.ib, r.seq)):
        assert r.shift == (r.ib - r.ub) % 2
        u, i = (np.frombuffer(x, np.int32).tolist() for x in (r.u, r.i))
        cells[r.ub, r.ib] += list(zip(u, i, np.frombuffer(r.y, float).tolist()))
    assert sum(map(len, cells.values())) == 3000
    for cell in cells.values():
        assert cell == sorted(cell, key=lambda x: ((x[0] * 2654435761 + x[1] * 40503) % 1000003, *x))
    assert BT.block_count(3_000_000, 15_000, 20_000) == 4
    for n in (10**8, 10**9):
        assert n / BT.block_count(n, 10**6, 10**6) ** 2 <= BT.CELL_RATINGS
    assert 10**7 / BT.block_count(10**7, 10**7, 10) <= BT.BLOCK_KEYS


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    rank, tower = 3, (5, 4)
    size = sum(int(np.prod(s)) for s in BT._layers(rank, tower))
    w, u, v = rng.standard_normal(size) * 0.5, rng.standard_normal((6, 6)), rng.standard_normal((6, 6))
    y = np.array([0, 1, 1, 0, 1, 0.0])
    loss = lambda w, u, v: BT._network(w, rank, tower)(u, v, y)[2]
    gu, gv, _, gw = BT._network(w, rank, tower)(u, v, y)
    for x, g, at in ((u, gu, (2, 1)), (u, gu, (0, 4)), (v, gv, (5, 5)), (v, gv, (1, 0)), (w, gw, (7,)), (w, gw, (size - 2,))):
        up, down = x.copy(), x.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        args = lambda z: [z if a is x else a for a in (w, u, v)]
        assert abs((loss(*args(up)) - loss(*args(down))) / 2e-5 - g[at]) < 1e-4


def test_latent_neighbors(rated):
    """Neighbours by factors, against brute force on the same factors."""
    train, _ = rated
    users, items = M.explicit_factors(train, rank=4, iterations=8)
    assert users.count() == 60 and items.count() == 40
    rows = sorted((r["user_id"], r["vector"]) for r in users.collect())
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(m @ m.T, 6)
    got = {(r["a"], r["rn"]): r["b"] for r in VS.knn_all(users, "user_id", "vector", 3).collect()}
    for i, (a, _) in enumerate(rows):
        best = sorted((j for j in range(60) if j != i), key=lambda j: (-sims[i, j], rows[j][0]))[:3]
        assert [got[a, n + 1] for n in range(3)] == [rows[j][0] for j in best]


def test_forests_and_clusters(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        c = i % 3
        v = (np.eye(3)[c] * 4 + 0.3 * rng.standard_normal(3)).tolist()
        rows.append((i, c, float(c), v, f"word{c} common"))
    df = spark.createDataFrame(rows, "id int, label int, y double, vector array<double>, title string").cache()
    train, test = df.filter("id % 5 <> 0"), df.filter("id % 5 = 0")
    right = M.forest_on_vectors(train, test, ["vector"], "label", classify=True).filter("label = prediction").count()
    assert right >= 28
    assert E.rmse_mae(M.forest_on_vectors(train, test, ["vector"], "y"), "y", "prediction").first()["rmse"] < 0.3
    assert E.rmse_mae(M.forest_on_titles(train, test, "id", "title", "y", trees=10), "y", "prediction").first()["rmse"] < 0.8
    clusters, _ = M.kmeans(df, "vector", 3)
    assert clusters.select("label", "cluster").distinct().count() == 3
    xy = M.project_2d(df, "vector").select("x", "y").first()
    assert xy["x"] is not None
    ids = M.integer_ids(df, "title", "title_id").collect()
    assert sorted(r["title_id"] for r in ids) == [0, 1, 2]


def test_rare_telling_term(spark):
    """A term behind thousands of others decides, and rows without a known term are scored too."""
    noise = [(i, f"filler{i} shared", 1.0) for i in range(4500)]
    telling = [(10_000 + i, f"zzrare other{i}", 5.0) for i in range(200)]
    train = spark.createDataFrame(noise + telling, "id int, title string, y double")
    test = spark.createDataFrame([(1, "shared", 1.0), (2, "zzrare", 5.0), (3, "unknown", 1.0), (4, None, 1.0)], train.schema)
    weights = M.tfidf(train, "id", "title")
    assert weights.select("term").distinct().count() == 4500 + 200 + 2
    got = {r["id"]: r["prediction"] for r in M.forest_on_titles(train, test, "id", "title", "y", trees=5).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] > got[1] + 0.3 and got[2] > got[3]


def test_bootstrap_covers_the_estimate(spark):
    rng = random.Random(9)
    rows = [(3.0, 3.0 + round(rng.gauss(0, 1), 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, ["a", "p"])
    row = E.bootstrap_interval(df, "a", "p", resamples=2000).first()
    point = E.rmse_mae(df, "a", "p").first()
    assert row["n_resamples"] == 2000
    assert row["rmse_low"] < point["rmse"] < row["rmse_high"] and row["rmse_high"] - row["rmse_low"] < 0.15
    assert row["mae_low"] < point["mae"] < row["mae_high"]
    # as wide as the plain bootstrap
    x = np.array([(a - p) ** 2 for a, p in rows])
    draws = np.sqrt(np.random.default_rng(4).choice(x, (2000, len(x))).mean(1))
    width = np.quantile(draws, 0.975) - np.quantile(draws, 0.025)
    assert abs((row["rmse_high"] - row["rmse_low"]) / width - 1) < 0.12


@pytest.mark.parametrize("mean", [1, 7, 64, 65, 5000])
def test_poisson_draws(spark, mean):
    rows = spark.range(20_000).withColumn("f", F.lit(mean).cast("bigint"))
    cdf = F.lit(E.poisson_cdf(mean)) if mean <= 64 else F.lit(None).cast("array<double>")
    m = [r[0] for r in rows.select(E.poisson_draw(F.col("f"), cdf, F.md5(F.col("id").cast("string")))).collect()]
    assert abs(np.mean(m) - mean) < 4 * math.sqrt(mean / len(m)) and abs(np.var(m) / mean - 1) < 0.05
    if mean == 1:
        for k in range(4):
            assert abs(np.mean(np.array(m) == k) - math.exp(-1) / math.factorial(k)) < 0.015


def test_histories_leave_the_target_out(spark):
    """A user with many ratings and targets keeps k others for each; one without others has an empty history."""
    from tastegrid.functions.hashing import md5_key

    ratings = spark.createDataFrame(
        [(1, i, float(i % 5 + 1), f"t{i}") for i in range(40)] + [(2, 7, 3.0, "t7")],
        "user_id int, item_id int, rating double, title string")
    targets = ratings.filter("item_id < 20")
    rows = X.history_without_target(targets, ratings, k=4).collect()
    of = {}
    for r in rows:
        assert r.item_id != r.target
        of.setdefault((r.user_id, r.target), []).append((r.rn, r.item_id))
    assert set(of) == {(1, i) for i in range(20)} and all(sorted(n for n, _ in v) == [1, 2, 3, 4] for v in of.values())
    order = [r.item_id for r in ratings.filter("user_id = 1").orderBy(md5_key("user_id", "item_id")).collect()]
    assert all([i for _, i in sorted(v)] == [i for i in order if i != t][:4] for (_, t), v in of.items())
    prompts = {(r.user_id, r.item_id): r.prompt for r in X.few_shot_for(targets, ratings, ["title"], k=4).collect()}
    assert len(prompts) == 21 and "* title" not in prompts[2, 7] and prompts[1, 0].count("* title") == 4


def test_repair_in_context(spark):
    """Only failed rows are scored and get a prompt; a new failure keeps the old text."""
    from tastegrid.operators import scoring as B

    rows = spark.createDataFrame([(1, "4.0"), (2, ""), (3, None), (4, "(None, 'Error')"), (4, "(None, 'Error')"), (5, "x")],
                                 "id int, predicted_rating string")
    def fn(prompts):
        return [{"p2": "5.0", "p3": "", "p4": "1.0"}.get(p) for p in prompts]

    out = B.repair_in_context(rows, lambda bad: bad.selectExpr("id", "'p' || id AS prompt"), fn, ["id"])
    got = sorted((r.id, r.predicted_rating, r.repaired, r.prompt) for r in out.collect() if r.id != 3)
    assert got[0] == (1, "4.0", False, None) and got[1] == (2, "5.0", True, "p2")
    assert got[2:4] == [(4, "1.0", True, "p4")] * 2 and got[4][1:3] == ("x", False)
    assert [(r.predicted_rating, r.repaired) for r in out.collect() if r.id == 3] == [(None, False)]
