"""Hot keys: the split and pruned paths give the same results as the plain ones."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window as W, functions as F

from tastegrid.functions.hashing import md5_key
from tastegrid.operators import pairs, profile as D, ranking as R, similarity as S, splits as P, topk as K, vectorsim as VS


@pytest.fixture(scope="module")
def skewed(spark):
    """One item rated by everybody (a third of the rows), one user who rated everything."""
    rng = random.Random(7)
    rows = {(u, 0) for u in range(90)} | {(0, i) for i in range(60)}
    rows |= {(u, 1) for u in range(0, 90, 2)}
    while len(rows) < 330:
        rows.add((rng.randrange(90), rng.randrange(60)))
    start = dt.datetime(2020, 1, 1)
    data = [(u, i, float(rng.randint(1, 5)), start + dt.timedelta(hours=rng.randrange(200))) for u, i in sorted(rows)]
    return spark.createDataFrame(data, ["user_id", "item_id", "rating", "ts"]).repartition(5).cache()


def edges(df):
    return sorted(map(tuple, df.collect()))


WHOLE = 10**9
CASES = [
    ("pearson", lambda df, axis, block: S.pearson(df, axis=axis, block=block)),
    ("pearson3", lambda df, axis, block: S.pearson(df, axis=axis, min_common=3, block=block)),
    ("weighted", lambda df, axis, block: S.weighted_pearson(df, axis=axis, block=block)),
    ("global", lambda df, axis, block: S.global_mean_pearson(df, axis=axis, min_sim=0.08, block=block)),
    ("cosine", lambda df, axis, block: S.cosine(df, axis=axis, min_sim=0.3, block=block)),
    ("jaccard", lambda df, axis, block: S.jaccard(df, axis=axis, min_sim=0.25, block=block)),
    ("corated", lambda df, axis, block: S.corated_items(df, axis=axis, min_common=2, block=block)),
]


@pytest.mark.parametrize("axis", ["user", "item"])
@pytest.mark.parametrize("name, run", CASES, ids=[c[0] for c in CASES])
def test_blocks_change_nothing(skewed, name, run, axis):
    plain, cut = edges(run(skewed, axis, WHOLE)), edges(run(skewed, axis, 8))
    assert plain == cut and plain


def rows_of(df):
    return df.select(F.col("user_id").alias("key"), F.col("item_id").alias("feature"), F.col("rating").alias("x"))


def test_hot_feature_becomes_bounded_blocks(spark):
    """A feature that all 2,000 keys share: no piece of work forms more than block^2 pairs."""
    rows = spark.range(2000).select(F.col("id").alias("key"), F.lit(0).alias("feature"), F.lit(1.0).alias("x"))
    blocks = pairs.packed(rows, ["x"], 128)
    sizes = [len(r["members"]) for r in blocks.collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 128
    got = pairs.block_pairs(rows, ["x"], 128).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l.key", "r.key").alias("d"),
        F.count_if(F.col("l.key") < F.col("r.key")).alias("ordered")).first()
    assert got["n"] == got["d"] == got["ordered"] == 2000 * 1999 // 2


def test_lists_of_a_pair_meet_in_one_cell(skewed):
    """Pairs are counted from lists of partners: no row per pair is shuffled, a heavy key is dealt into parts."""
    rows = rows_of(skewed)
    lists = pairs.partner_lists(rows, ["x"], 16)
    assert lists.count() <= 10 * rows.count() < lists.select(F.sum(F.size("others"))).first()[0]
    cut = pairs.cells(rows, ["x"], 16, task_pairs=50)
    assert cut.select("cell").distinct().count() > 5 and cut.filter("part > 0").count() > 0
    met = cut.select("cell", "part", "a", F.explode("b").alias("b"))
    assert met.groupBy("a", "b").agg(F.count_distinct("cell", "part").alias("n")).filter("n > 1").count() == 0
    want = pairs.block_pairs(rows, ["x"], 10**9).groupBy("l.key", "r.key").count()
    assert met.groupBy("a", "b").count().exceptAll(want).count() == 0 and met.count() == want.agg(F.sum("count")).first()[0]


def test_lists_of_a_plain_table_are_one_grouping(spark):
    """No feature has several blocks and no key several cells: rows are grouped by feature once, joined with nothing."""
    rows = spark.range(300).select(
        (F.col("id") % 30).alias("key"), F.floor(F.col("id") / 10).alias("feature"), F.lit(1.0).alias("x"))
    lists = pairs.cells(rows, ["x"])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert lists.select(F.sum(F.size("b"))).first()[0] == 30 * 10 * 9 // 2
    keys = {(r["a"], b) for r in lists.collect() for b in r["b"]}
    assert all(a < b for a, b in keys) and lists.filter("size(b) <> size(b_x)").count() == 0


def test_pairs_met_once_are_left_out_before_keys_are_numbered():
    rng = np.random.default_rng(3)
    b = [rng.choice(10**6, 50, replace=False) - 10**5 for _ in range(400)]
    b[7][:5] = b[3][:5]  # rows 3 and 7 are of one key
    own = np.arange(400)
    own[7] = 3
    cell = pa.table({"a": pa.array(own), "a_x": pa.array(own * 1.0), "b": pa.array(b), "b_x": pa.array([x * 2.0 for x in b])})
    keys, left, right, sides = pairs._pairs_of(cell, ["x"], 2)
    assert 10 <= len(left) < 0.5 * 400 * 50
    order, first, n = pairs._by_pair(left, right, 2)
    values = keys.to_numpy()
    assert set(values[left[order]]) == {3} and sorted(values[right[order][first]]) == sorted(b[3][:5]) and set(n) == {2}
    assert np.array_equal(sides["a_x"].to_numpy(), values[left]) and np.array_equal(sides["b_x"].to_numpy(), 2 * values[right])


@pytest.fixture(scope="module")
def zipf(spark):
    """300 keys over 200 features of very different popularity."""
    rng = random.Random(13)
    weights = [1 / (i + 1) for i in range(200)]
    rows = {(k, f) for k in range(300) for f in rng.choices(range(200), weights, k=rng.randrange(1, 25))}
    rows |= {(k, 500 + f) for k in range(20) for f in range(k, k + 9)}
    data = [(k, f, float(rng.randint(1, 5))) for k, f in sorted(rows)]
    return data, spark.createDataFrame(data, ["user_id", "item_id", "rating"])


@pytest.mark.parametrize("kind", ["jaccard", "cosine"])
@pytest.mark.parametrize("bound", [0.05, 0.5])
def test_bounded_similarity_against_brute_force(zipf, kind, bound):
    data, df = zipf
    vectors = {}
    for k, f, x in data:
        vectors.setdefault(k, {})[f] = x
    want = {}
    for a in vectors:
        for b in vectors:
            shared = vectors[a].keys() & vectors[b].keys()
            if a < b and shared:
                if kind == "jaccard":
                    sim = len(shared) / len(vectors[a].keys() | vectors[b].keys())
                else:
                    dot = sum(vectors[a][f] * vectors[b][f] for f in shared)
                    sim = dot / math.sqrt(sum(x * x for x in vectors[a].values()) * sum(x * x for x in vectors[b].values()))
                if round(sim, 6) >= bound:
                    want[a, b] = (len(shared), sim)
    got = getattr(S, kind)(df, min_sim=bound, block=16).collect()
    assert {(r["a"], r["b"]) for r in got} == set(want) and len(got) == len(want)
    assert all(r["n_common"] == want[r["a"], r["b"]][0] and abs(r["sim"] - want[r["a"], r["b"]][1]) < 1e-6 for r in got)


def test_bounds_keep_pairs_from_being_formed(zipf):
    _, df = zipf
    sizes = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    rows = rows_of(df).join(sizes.withColumnRenamed("user_id", "key"), "key")
    every = pairs.block_pairs(rows, ["x"]).count()
    for bound, share in ((0.5, 0.3), (0.8, 0.1)):
        tails = pairs.popularity_tails(rows, F.ceil(F.col("size") * bound).cast("double"), F.lit(1.0))
        assert all(r["tail"] < bound * r["size"] for r in tails.select("tail", "size").collect())
        assert pairs.block_pairs(tails.filter("cls <= last"), ["x"]).count() < share * every


@pytest.mark.parametrize("axis", ["user", "item"])
@pytest.mark.parametrize("least", [None, 0.0, 0.05])
def test_top_weighted_equals_the_edge_list(skewed, axis, least):
    want = S.top_neighbors(S.weighted_pearson(skewed, axis=axis), 3, least)
    for options in ({}, {"block_keys": 7, "task_rows": 20, "pairs_at_once": 30}):
        got = K.top_weighted_pearson(skewed, 3, axis=axis, min_sim=least, **options)
        assert got.columns == want.columns and edges(got) == edges(want)


def test_top_weighted_by_lists_and_blocks(skewed):
    for way in (True, False):
        got = K.top_weighted_pearson(skewed, 2, min_sim=0.0, block_keys=7, list_pairs=way)
        assert edges(got) == edges(S.top_neighbors(S.weighted_pearson(skewed), 2, 0.0))
    # every key alone in its block: blocks would get each feature's rows once per key
    assert "FlatMapCoGroups" not in K.top_weighted_pearson(skewed, 2, block_keys=1)._jdf.queryExecution().toString()


def test_top_weighted_visits_few_pairs():
    """Pairs whose overlap cannot beat the k-th best found are not worked out."""
    rng = np.random.default_rng(2)
    x = {n: rng.integers(1, 6, (400, n)) for n in (3, 25)}
    a, feature, value = [], [], []
    for n, lo in ((25, 0), (3, 200)):  # key 0 shares 25 features with keys 1..199 and 3 with 200..399
        for b in range(1, 200):
            a += [lo + b] * n
            feature += list(range(n))
            value += list(x[n][b])
    own = (np.zeros(25, int), np.arange(25), x[25][0].astype(float))
    other = (np.array(a), np.array(feature), np.array(value, float))
    tried = []
    got = K.best_partners(*own, *other, k=5, delta=25, min_common=2, least=0.0, pairs_at_once=10**6, tried=tried)
    full = K.best_partners(*own, *other, k=1000, delta=25, min_common=2, least=0.0, pairs_at_once=10**6)
    assert sum(tried) < 250
    best = sorted(zip(-np.round(full[3], 6), full[1]))[:5]
    assert sorted(zip(-np.round(got[3], 6), got[1]))[:5] == best


@pytest.mark.parametrize("tied", [False, True])
def test_sequential_split_of_a_user_with_half_of_all_rows(skewed, tied):
    """Ranks from 9 ranges of the table are those of one sort per user, also when all times are equal."""
    more = skewed.sparkSession.range(300).select(
        F.lit(0).cast("bigint").alias("user_id"), (F.col("id") + 1000).alias("item_id"), F.lit(3.0).alias("rating"),
        F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, 0, cast(id % 90 as int))").alias("ts"))
    df = skewed.unionByName(more)
    if tied:
        df = df.withColumn("ts", F.lit(dt.datetime(2020, 1, 1)))
    w = W.partitionBy("user_id")
    plain = df.withColumn("rn", F.row_number().over(w.orderBy("ts", md5_key("user_id", "item_id")))).withColumn(
        "n", F.count(F.lit(1)).over(w))
    want = edges(plain.select("user_id", "item_id", F.when(F.expr("rn <= floor(n * 0.8D)"), "train").otherwise("test")))
    cut = P.split_sequential(df, parts=9)
    assert cut.columns == [*df.columns, "split"]
    assert edges(cut.select("user_id", "item_id", "split")) == want


@pytest.mark.parametrize("n", [0, 1, 66, 329, 330, 400])
def test_first_rows_equals_sort(skewed, n):
    digest = md5_key("user_id", "item_id")
    leveled, chosen = R.first_rows(skewed, R.time_levels("ts", digest), n, cell_rows=1)
    got = edges(leveled.filter(chosen).select("user_id", "item_id"))
    want = edges(skewed.orderBy("ts", digest).limit(n).select("user_id", "item_id"))
    assert got == want


def test_exact_and_popular_splits_without_small_cells(skewed):
    a = edges(P.split_global_exact(skewed).select("user_id", "item_id", "split"))
    b = edges(P.split_global_exact(skewed, cell_rows=1).select("user_id", "item_id", "split"))
    assert a == b and sum(x[2] == "test" for x in a) == math.ceil(330 * 0.2)
    assert edges(P.popular_items(skewed)) == edges(P.popular_items(skewed, cell_rows=1))


def test_row_index_is_a_permutation(skewed):
    got = R.row_index(skewed, md5_key("user_id", "item_id")).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in got] == list(range(330))
    ordered = [r["k"] for r in skewed.select(md5_key("user_id", "item_id").alias("k")).orderBy("k").collect()]
    again = R.row_index(skewed, md5_key("user_id", "item_id")).orderBy("row_idx").select(
        md5_key("user_id", "item_id").alias("k")).collect()
    assert [r["k"] for r in again] == ordered


def test_percentile_rank_with_heavy_ties(spark):
    values = [1.0] * 40 + [float(v) for v in range(50)] + [1e9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], ["id", "v"])
    got = {r["id"]: r["pct_rank"] for r in D.percentile_rank(df, "v").collect()}
    for i, v in enumerate(values):
        below, same = sum(x < v for x in values), sum(x == v for x in values)
        assert got[i] == pytest.approx((below + (same + 1) / 2) / len(values), abs=1e-6)


def test_percentile_rank_is_of_the_affinity(spark, tmp_path):
    """The query ranks each event by the affinity of its user and type, not by a column of the table."""
    vectors = [(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 1.0])]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], ["vec_id", "embedding", "label"]).write.parquet(
        f"{tmp_path}/embeddings.parquet")
    events = [(0, 1, "a", 9.0), (3, 2, "a", 1.0), (1, 3, "a", 5.0), (2, 4, "a", 7.0)]
    spark.createDataFrame(events, ["event_id", "user_id", "event_type", "value"]).write.parquet(f"{tmp_path}/events.parquet")
    from tastegrid.plans import QUERIES
    mean = np.mean([vectors[e % 3][1] for e, *_ in events], axis=0)
    want = {e: round(float(mean @ vectors[e % 3][1] / np.linalg.norm(mean)), 4) for e, *_ in events}
    got = {r["event_id"]: (r["affinity"], r["pct_rank"]) for r in QUERIES["pct_rank"](spark, str(tmp_path)).collect()}
    assert {e: a for e, (a, _) in got.items()} == want
    assert {e: p for e, (_, p) in got.items()} == {
        e: (sum(o < a for o in want.values()) + (list(want.values()).count(a) + 1) / 2) / 4 for e, a in want.items()}


def test_repartitioning_changes_nothing(skewed):
    for run in (
        lambda df: S.top_neighbors(S.pearson(df), 3),
        lambda df: P.split_random_k(df, k=2).select("user_id", "item_id", "split"),
        lambda df: P.split_leave_one_out(df).select("user_id", "item_id", "split"),
        lambda df: P.history(df).select("user_id", "item_id", "rn"),
    ):
        assert edges(run(skewed)) == edges(run(skewed.repartition(11, "rating")))


def test_splits_cover_and_are_disjoint(skewed):
    for run in (P.split_sequential, P.split_random_k, P.split_leave_one_out, P.split_global, P.split_global_exact):
        rows = run(skewed).select("user_id", "item_id", "split").collect()
        assert len(rows) == 330 and len({(r[0], r[1]) for r in rows}) == 330
    last = W.partitionBy("user_id", "split")
    ends = P.split_sequential(skewed).select(
        "user_id", "split", F.max("ts").over(last).alias("hi"), F.min("ts").over(last).alias("lo")).distinct()
    by = {(r["user_id"], r["split"]): r for r in ends.collect()}
    assert all(by[(u, "train")]["hi"] <= r["lo"] for (u, s), r in by.items() if s == "test" and (u, "train") in by)


@pytest.fixture(scope="module")
def points(spark):
    """Clusters of vectors, and a third of all rows are copies of one vector."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    rows = [centres[i % 6] + 0.3 * rng.standard_normal(8) for i in range(120)]
    rows += [rows[0]] * 60
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    return spark.createDataFrame(data, "vec_id bigint, vector array<double>"), data


def brute_pairs(data, bound):
    reps = {}
    for i, v in data:
        reps.setdefault(tuple(v), i)
    ids = sorted(reps.values())
    m = np.array([dict(data)[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = m @ m.T
    out = {(ids[x], ids[y]) for x in range(len(ids)) for y in range(x + 1, len(ids)) if sims[x, y] >= bound}
    return out | {(reps[tuple(v)], i) for i, v in data if reps[tuple(v)] != i}


@pytest.mark.parametrize("bound", [0.99, 0.9, 0.3])
def test_vector_pairs_against_brute_force(points, bound):
    df, data = points
    got = [(r["a"], r["b"]) for r in VS.unit_pairs(df, "vec_id", F.col("vector"), bound, pivots=9, block=16).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(data, bound)


def brute_knn(data, k, bound=-2.0):
    m = np.array([v for _, v in data])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(m @ m.T, 6)
    return {a: [b for b in sorted((b for b in range(len(m)) if b != a and sims[a, b] >= bound),
                                  key=lambda b: (-sims[a, b], b))[:k]] for a in range(len(m))}


@pytest.mark.parametrize("bound, k", [(None, 4), (None, 70), (0.8, 5)])
def test_nearest_of_every_vector_and_copy(points, bound, k):
    """A third of all rows are copies: each of them has its own k nearest, copies first."""
    df, data = points
    near = VS.unit_pairs(df, "vec_id", F.col("vector"), bound or -1.0, pivots=9, block=16, k=k)
    rows = VS.with_copies(VS._units(df, "vec_id", "vector"), near, k).collect()
    got = {}
    for r in rows:
        got.setdefault(r["a"], {})[r["rn"]] = r["b"]
    want = brute_knn(data, k, bound if bound else -2.0)
    assert {a: [x[i + 1] for i in range(len(x))] for a, x in got.items()} == {a: b for a, b in want.items() if b}


def test_few_vectors_and_none(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "vec_id bigint, vector array<double>")
    assert edges(VS.knn_all(few, "vec_id", "vector", 5)) == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
    assert VS.knn_all(few.filter("vec_id > 9"), "vec_id", "vector", 5).count() == 0


def test_lsh_recall(points):
    df, data = points
    exact = {(r["a"], r["b"]) for r in VS.knn_within(df, "vec_id", "vector", 3, 0.8).collect()}
    found = {(r["a"], r["b"]) for r in VS.knn_lsh(df, "vec_id", "vector", 3, 0.8, bits=4).collect()}
    assert len(exact & found) / len(exact) > 0.8
    copies = {a for a, _ in found if a >= 120}
    assert copies == set(range(120, 180))


@pytest.mark.parametrize("marks", [[0.0, 0.25, 0.5, 0.75, 1.0], [0.1]])
def test_exact_quantiles(spark, marks):
    rng = np.random.default_rng(8)
    values = {"a": rng.normal(size=301) * 10.0 ** rng.integers(-300, 300, 301), "b": np.repeat(1 / 3, 50),
              None: np.array([-0.0, 0.0, -1.0, 5e-324, -5e-324]), "one": np.array([2.5])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("nulls", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: r for r in R.exact_quantiles(df, "k", "v", marks).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert got[k]["n"] == len(v)
        assert np.allclose(got[k]["quantiles"], np.quantile(v, marks), rtol=1e-12, atol=0)


def test_profiles_of_several_attributes(spark):
    items = spark.createDataFrame([(i, f"b{i % 2000}", None if i % 7 else "x", ["t", f"t{i % 3}"]) for i in range(3000)],
                                  "item_id int, brand string, kind string, words array<string>")
    rng = random.Random(3)
    data = [(u, i, float(rng.randint(1, 5))) for u in range(12) for i in rng.sample(range(3000), 40)]
    ratings = spark.createDataFrame(data, "user_id int, item_id int, rating double")
    rows = S.feature_profiles(ratings, S.item_traits(items, "item_id")).collect()
    traits = {i: [("brand", f"b{i % 2000}"), ("words", "t"), ("words", f"t{i % 3}")] + ([] if i % 7 else [("kind", "x")])
              for i in range(3000)}
    want = {}
    for u, i, x in data:
        for t in traits[i]:
            want.setdefault(u, {}).setdefault(t, 0.0)
            want[u][t] += x
    for u, w in want.items():
        for name in {a for a, _ in w}:
            length = math.sqrt(sum(x * x for (a, _), x in w.items() if a == name))
            w.update({t: x / length / math.sqrt(3) for t, x in w.items() if t[0] == name})
    got = {(r["user_id"], r["attribute"], r["value"]): r["w"] for r in rows}
    assert got.keys() == {(u, *t) for u, w in want.items() for t in w}
    assert all(abs(got[u, a, v] - want[u][a, v]) < 1e-9 for u, a, v in got)
    edges_ = spark.createDataFrame([(0, 1, 3, 0.5), (2, 5, 4, -0.25)], "a int, b int, n_common int, sim double")
    for r in S.feature_augmented(edges_, S.feature_profiles(ratings, S.item_traits(items, "item_id"))).collect():
        dot = sum(x * want[r["b"]].get(t, 0) for t, x in want[r["a"]].items())
        assert abs(r["profile_sim"] - dot) < 2e-6


def test_unsupported_metric(points):
    with pytest.raises(ValueError):
        VS.latent_similarity(points[0], "vec_id", "vector", "euclid", 0.5)


def test_popularity_split_types(spark):
    """Popular and unpopular test rows add up to both; rows with nulls count nowhere."""
    rows = [(u, i, float(1 + (u + i) % 5), dt.datetime(2020, 1, 1) + dt.timedelta(hours=u * 7 + i), f"t{i}")
            for u in range(40) for i in range(20) if i < 4 or (u + i) % 3 == 0]
    bad = [(100 + u, 19, None, dt.datetime(2020, 1, 1), "t19") for u in range(200)]
    bad += [(400 + u, 18, 3.0, dt.datetime(2020, 1, 1), None) for u in range(200)]
    df = spark.createDataFrame(rows + bad, "user_id int, item_id int, rating double, ts timestamp, title string")
    for how in ("random", "sequential"):
        for measure in ("count", "blended"):
            def split(which):
                out = P.split_by_popularity(df, how, which, measure, required=("title",))
                got = [(r.user_id, r.item_id, r.split) for r in out.collect()]
                assert all(u < 100 for u, _, _ in got) and len(got) == len(set(got))
                return {x for x in got if x[2] == "test"}, {x for x in got if x[2] == "train"}
            (both, train), (pop, t1), (rare, t2) = split("both"), split("popular"), split("unpopular")
            assert train == t1 == t2 and len(train) + len(both) == len(rows)
            assert pop | rare == both and not pop & rare and pop
            assert not {i for _, i, _ in pop} & {i for _, i, _ in rare} and {i for _, i, _ in pop} <= set(range(4))


def test_nearest_of_a_block_by_tiles(monkeypatch):
    """Tiles and bounds leave the k best by rounded cosine, ties by id, as a full sort does."""
    monkeypatch.setattr(VS, "TILE", (7, 11))
    rng = np.random.default_rng(4)
    m = np.round(rng.standard_normal((60, 3)), 1) + 0.01
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = rng.permutation(60)
    sims = np.floor(m @ m.T * 1e6 + 0.5) / 1e6
    want = {(int(ids[i]), int(ids[j])) for i in range(60)
            for j in sorted((j for j in range(60) if j != i and sims[i, j] >= 0.2), key=lambda j: (-sims[i, j], ids[j]))[:4]}
    got = VS._nearest(ids, m, ids, m, 4, 0.2)
    assert set(zip(got[0].tolist(), got[1].tolist())) == want and len(got[0]) == len(want)
    kth = np.sort(np.where(np.eye(60, dtype=bool), -2, sims), axis=1)[:, -4]
    assert set(zip(*(x.tolist() for x in VS._nearest(ids, m, ids, m, 4, 0.2, kth)[:2]))) <= want


def test_lsh_blocks_change_nothing(points):
    df, _ = points
    whole = edges(VS.knn_lsh(df, "vec_id", "vector", 3, 0.5, bits=2))
    assert edges(VS.knn_lsh(df, "vec_id", "vector", 3, 0.5, bits=2, block=7)) == whole


def test_masks_leave_the_join_by_jaccard(spark):
    """Pairs whose cosine reaches the bound but whose Jaccard does not are not handed on."""
    rng = random.Random(8)
    masks = {i: [float(rng.random() < 0.5) for _ in range(12)] for i in range(40)}
    df = spark.createDataFrame([(i, v) for i, v in masks.items() if any(v)], "vec_id bigint, vector array<double>")
    got = {(r["a"], r["b"]): r["sim"] for r in VS.unit_pairs(df, "vec_id", F.col("vector"), 0.4, pivots=4, block=8, jaccard=0.4).collect()}
    assert got and min(got.values()) >= 0.4
    for (a, b), sim in got.items():
        both = sum(x * y for x, y in zip(masks[a], masks[b]))
        assert sim == pytest.approx(both / (sum(masks[a]) + sum(masks[b]) - both), abs=1e-6)
