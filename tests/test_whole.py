"""Similarity queries give every pair that their measure has, however the work is cut."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import blocktrain as BT, pairs, similarity as S, vectorsim as VS
from tastegrid.plans import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Order lines of 12 users: neighbours in a ring share one item, users 0 and 6 share 30; user 11 shares none."""
    top = str(tmp_path_factory.mktemp("tables"))
    lines = [(u, i) for u in range(11) for i in (u, (u + 1) % 11)] + [(u, 100 + i) for u in (0, 6) for i in range(30)] + [(11, 200)]
    items = sorted({i for _, i in lines})
    day = dt.datetime(2020, 1, 1)
    spark.createDataFrame([(n, i, float(10 * (1 + (u * 7 + i) % 5))) for n, (u, i) in enumerate(lines)],
                          "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{top}/lineitem.parquet")
    spark.createDataFrame([(n, u, day) for n, (u, _) in enumerate(lines)],
                          "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{top}/orders.parquet")
    spark.createDataFrame([(i, f"thing n{i}", f"b{i}", f"t{i}", 1, 100.0 * i) for i in items],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
                          ).write.parquet(f"{top}/part.parquet")
    rated = {}
    for u, i in lines:
        rated.setdefault(u, {})[i] = 1.0 + (u * 7 + i) % 5
    return top, rated


def both(rated):
    """(a, b): their shared features."""
    return {(a, b): rated[a].keys() & rated[b].keys() for a in rated for b in rated if a < b and rated[a].keys() & rated[b].keys()}


def test_user_cosine_has_pairs_below_any_bound(spark, folder):
    top, rated = folder
    got = {(r["a"], r["b"]): (r["n_common"], r["sim"]) for r in QUERIES["sim_user_cosine"](spark, top).collect()}
    length = {u: math.sqrt(sum(x * x for x in v.values())) for u, v in rated.items()}
    want = {(a, b): (len(s), sum(rated[a][i] * rated[b][i] for i in s) / length[a] / length[b]) for (a, b), s in both(rated).items()}
    assert got.keys() == want.keys() and min(x for _, x in want.values()) < 0.05
    assert all(got[p][0] == n and abs(got[p][1] - x) < 1e-6 for p, (n, x) in want.items())


def test_item_pearson_has_pairs_with_one_common_user(spark, folder):
    top, rated = folder
    items = {}
    for u, v in rated.items():
        for i, x in v.items():
            items.setdefault(i, {})[u] = x
    got = {(r["a"], r["b"]): (r["n_common"], r["sim"]) for r in QUERIES["sim_item_pcc_global"](spark, top).collect()}
    want = both(items)
    assert got.keys() == want.keys() and any(len(s) == 1 for s in want.values())
    for (a, b), s in want.items():
        x, y = ([items[k][u] - sum(items[k].values()) / (len(items[k]) + 1e-9) for u in s] for k in (a, b))
        den = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
        sim = sum(v * w for v, w in zip(x, y)) / (den + 1e-9) * min(len(s), 25) / 25
        assert got[a, b][0] == len(s) and abs(got[a, b][1] - sim) < 2e-6


def test_user_features_have_pairs_without_common_items(spark, folder):
    """All users rated things, so all pairs share the word; few share items."""
    top, rated = folder
    got = {(r["a"], r["b"]): r for r in QUERIES["sim_user_features"](spark, top).collect()}
    shared = both(rated)
    assert got.keys() == {(a, b) for a in rated for b in rated if a < b}
    assert all(r["n_common"] == len(shared.get(p, ())) for p, r in got.items())
    assert all(got[a, 11]["profile_sim"] > 0 and got[a, 11]["n_common"] == 0 for a in range(11))


@pytest.mark.parametrize("block", [10**6, 7])
def test_outer_pairs_against_brute_force(spark, block):
    """Edges without profiles and pairs without edges are there, whatever the blocks; text keys too."""
    rng = random.Random(5)
    rows = {(f"u{u}", f"a{t % 2}", f"v{t}"): rng.choice([0.0, -0.5, 0.25, 0.75])
            for u in range(30) for t in ([0, 1] if u % 3 else []) + rng.sample(range(2, 400), 6)}
    profiles = spark.createDataFrame([(*k, w) for k, w in rows.items()], "user_id string, attribute string, value string, w double")
    listed = {("u1", "u2"): (3, 0.5), ("u0", "x"): (4, -0.25), ("u10", "u3"): (2, 1.0)}
    edges = spark.createDataFrame([(*p, *x) for p, x in listed.items()] + [(None, "u5", 6, 0.125)],
                                  "a string, b string, n_common int, sim double")
    held = {}
    for (u, *t), w in rows.items():
        held.setdefault(u, {})[tuple(t)] = w
    want = {}
    for a in held:
        for b in held:
            s = held[a].keys() & held[b].keys()
            if a < b and (s or (a, b) in listed):
                n, sim = listed.get((a, b), (0, 0.0))
                want[a, b] = (n, sum(held[a][t] * held[b][t] for t in s), sim)
    want["u0", "x"], want[None, "u5"] = (4, 0.0, -0.25), (6, 0.0, 0.125)
    df = S.feature_augmented(edges, profiles, block=block)
    assert df.schema["n_common"].dataType.simpleString() == "int"
    got = {(r["a"], r["b"]): r for r in df.collect()}
    assert got.keys() == want.keys() and df.count() == len(want)
    for p, (n, dot, sim) in want.items():
        assert got[p]["n_common"] == n and abs(got[p]["profile_sim"] - dot) < 1e-6 and abs(got[p]["sim"] - (dot + sim) / 2) < 1e-6


def test_products_by_matrix_and_by_pair_are_the_same():
    rng = np.random.default_rng(1)
    sides = []
    for n in (40, 50):
        has = rng.random((n, 300)) < np.where(np.arange(300) < 20, 0.6, 0.02)
        u, t = np.nonzero(has)
        sides.append((has, np.where(has, rng.normal(size=has.shape), 0), (n, u, 7 * t)))
    (hx, x, left), (hy, y, right) = sides
    left, right = (*left, x[hx]), (*right, y[hy])
    for options in ({}, {"tile": 3, "at_once": 10}):
        out, met = S._products(left, right, **options)
        assert np.allclose(out, x @ y.T) and (met == ((hx.astype(int) @ hy.T) > 0)).all()


def test_rounds_and_narrow_lists_change_nothing(spark, monkeypatch):
    """Lists of a share of the keys at a time, keys and values in few bytes or as they are: the same pairs."""
    rng = random.Random(8)
    data = [(u, i, rng.choice([1.0, 2.5, 5.0])) for u in range(60) for i in rng.sample(range(40), 9)]
    df = spark.createDataFrame(data, "user_id long, item_id long, rating double")
    far = df.select((F.col("user_id") - 2**40).alias("user_id"), "item_id", "rating")

    def found(rows, plus=0):
        return [sorted((r["a"] + plus, *r[1:]) for r in run(rows).collect()) for run in (
            S.pearson, lambda x: S.global_mean_pearson(x, axis="user"), lambda x: S.cosine(x, min_sim=0.3), lambda x: S.jaccard(x, min_sim=0.2))]

    plain = found(df)
    assert all(plain)
    assert [[(a, b + 2**40, *x) for a, b, *x in rows] for rows in found(far, 2**40)] == plain  # keys of more than 32 bits
    monkeypatch.setattr(pairs, "ROUND_PAIRS", 500)
    monkeypatch.setattr(pairs, "TASK_PAIRS", 200)
    monkeypatch.setattr(pairs, "CODES", 2)
    assert found(df) == plain


def test_slim_rows(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (2**31 - 1, 1, None), (-5, 2, 0.25)], "key long, feature long, x double")
    narrow, values = pairs.slim(rows)
    assert dict(narrow.dtypes)["key"] == "int" and dict(narrow.dtypes)["x"] == "smallint" and list(values) == [0.25, 0.5]
    assert {(r["key"], r["x"]) for r in narrow.collect()} == {(1, 1), (2**31 - 1, None), (-5, 0)}
    wide = spark.createDataFrame([(2**31, 1, None)], "key long, feature long, x double")
    kept, values = pairs.slim(wide)
    assert kept.dtypes == wide.dtypes and values is None
    cell = pa.table({"a": pa.array([3], pa.int32()), "a_x": [1.0], "b": pa.array([[4, 9]], pa.list_(pa.int32())), "b_x": [[2.0, 3.0]]})
    keys, a, b, _ = pairs._pairs_of(cell, ["x"])
    assert keys is None and list(a) == [3, 3] and list(b) == [4, 9] and pairs._named(keys, b, "bigint").type == pa.int64()


@pytest.mark.parametrize("block", [4096, 16])
def test_masks_as_bits_against_brute_force(spark, block):
    """All pairs of masks within the bound, copies with their least id, whatever the blocks."""
    rng = np.random.default_rng(6)
    masks = rng.random((90, 21)) < 0.4
    masks[70:75], masks[80] = masks[3], False
    df = spark.createDataFrame([(i * 5 % 97, [float(x) for x in m]) for i, m in enumerate(masks)], "vec_id long, mask array<double>")
    least = {}
    for i, m in enumerate(masks):
        if m.any():
            key = m.tobytes()
            least[key] = min(least.get(key, 97), i * 5 % 97)
    ids = sorted((v, np.frombuffer(k, bool)) for k, v in least.items())
    want = {}
    for n, (a, x) in enumerate(ids):
        for b, y in ids[n + 1:]:
            sim = round((x & y).sum() / (x | y).sum(), 6)
            if sim >= 0.3:
                want[a, b] = sim
    want.update({(least[m.tobytes()], i * 5 % 97): 1.0 for i, m in enumerate(masks) if m.any() and least[m.tobytes()] != i * 5 % 97})
    rows = VS.mask_pairs(df, "vec_id", "mask", 0.3, block=block).collect()
    got = {(r["a"], r["b"]): r["sim"] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[p] - want[p]) < 2e-6 for p in want)


def test_a_row_of_gradients_is_added_in_the_order_of_the_batch():
    rng = np.random.default_rng(4)
    for at in (rng.permutation(50)[:20], rng.integers(0, 6, 40)):
        w, s, g = rng.normal(size=(50, 3)), rng.random((50, 3)), rng.normal(size=(len(at), 3))
        total = np.zeros_like(w)
        np.add.at(total, at, g)
        hit = np.unique(at)
        squares = s[hit] + total[hit] ** 2
        want = w.copy()
        want[hit] -= 0.1 * total[hit] / np.sqrt(squares)
        kept = s.copy()
        kept[hit] = squares
        BT._descend(w, s, at, g, 0.1)
        assert np.array_equal(w, want) and np.array_equal(s, kept)


def test_packed_ratings_of_text_keys_in_one_shuffle(spark):
    """Ratings meet lists of their blocks' keys: no join, each rating dealt once; labels other than 0 and 1 too."""
    rows = spark.createDataFrame([(f"u{n % 37}", f"i{n % 11}", float(n % 3)) for n in range(800)], "user_id string, item_id string, label double")
    sides = [BT._numbered(rows, k, 3, 1) for k in ("user_id", "item_id")]
    packed = BT._packed_ratings(rows, *sides, BT.DEFAULT, "label", 3)
    assert "Join" not in packed._jdf.queryExecution().executedPlan().toString()
    names = [{(r["blk"], r["pos"]): r["id"] for r in side.collect()} for side in sides]
    got = [(names[0][r["ub"], u], names[1][r["ib"], i], y) for r in packed.collect() for u, i, y in zip(
        np.frombuffer(r["u"], np.int32).tolist(), np.frombuffer(r["i"], np.int32).tolist(), np.frombuffer(r["y"]).tolist())]
    assert sorted(got) == sorted(map(tuple, rows.collect()))


def test_missing_features_are_common_to_nobody(spark):
    rows = spark.createDataFrame([(1, None, 2.0), (2, None, 3.0), (1, 5, 4.0), (2, 5, 1.0), (3, None, 1.0)],
                                 "user_id long, item_id long, rating double")
    assert [(r["a"], r["b"], r["n_common"]) for r in S.cosine(rows).collect()] == [(1, 2, 1)]
