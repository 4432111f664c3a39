"""Worked examples with known values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tastegrid.functions import parsing as G, text as X
from tastegrid.functions.hashing import md5_int, md5_key
from tastegrid.operators import cleaning as L, evaluate as E, neighbors as N, similarity as S, splits as P, textmetrics as M
from tastegrid.roles import Roles

TOY_A = [(1, 1, 5.0), (1, 2, 3.0), (2, 2, 4.0), (2, 3, 5.0), (3, 1, 1.0), (3, 2, 5.0), (3, 3, 4.0)]
COLUMNS_B = {1: [5, 4, None, 4, None], 2: [3, None, 5, None, 3], 3: [None, 3, 4, None, 4], 4: [2, 4, None, 5, 3]}
TOY_B = [(u, i, float(r)) for i, col in COLUMNS_B.items() for u, r in enumerate(col) if r is not None]
NAMES = ["user_id", "item_id", "rating"]


@pytest.fixture(scope="module")
def toy_a(spark):
    return spark.createDataFrame(TOY_A, NAMES)


@pytest.fixture(scope="module")
def toy_b(spark):
    return spark.createDataFrame(TOY_B, NAMES)


def sims(edges):
    return {(r["a"], r["b"]): r["sim"] for r in edges.collect()}


def check(edges, want):
    got = sims(edges)
    for pair, value in want.items():
        assert got.get(pair, 0.0) == pytest.approx(value, abs=1e-5), pair
    assert set(got) <= set(want)


def test_user_pearson(toy_a):
    check(S.pearson(toy_a, axis="user", min_common=1), {(1, 2): 0, (1, 3): -1, (2, 3): -1})


def test_item_pearson(toy_a, toy_b):
    check(S.pearson(toy_a, axis="item", min_common=1), {(1, 2): -1, (1, 3): 0, (2, 3): -1})
    got = sims(S.pearson(toy_b, axis="item", min_common=1))
    assert got[(1, 4)] == pytest.approx(-0.9449, abs=1e-4) and got[(3, 4)] == pytest.approx(-1, abs=1e-5)
    assert all(v == 0 for k, v in got.items() if k not in {(1, 4), (3, 4)})


def test_default_pearson_drops_only_zeros(toy_b):
    full = sims(S.pearson(toy_b, axis="item", min_common=1))
    kept = sims(S.pearson(toy_b, axis="item"))
    assert all(full[k] == v for k, v in kept.items())
    assert all(v == 0 for k, v in full.items() if k not in kept)


def test_weighted_pearson(toy_a, toy_b):
    check(S.weighted_pearson(toy_a), {(1, 3): -0.08, (2, 3): -0.08})
    check(S.weighted_pearson(toy_b, axis="item"), {(1, 4): -0.113389, (3, 4): -0.08})


def test_global_mean_pearson(toy_a, toy_b):
    check(S.global_mean_pearson(toy_a), {(1, 2): -0.08, (1, 3): 0.04, (2, 3): -0.056569})
    check(S.global_mean_pearson(toy_b), {
        (1, 2): -0.04, (1, 3): 0.04, (1, 4): -0.11239, (2, 3): 0.025298, (2, 4): 0.071554, (3, 4): -0.075895})


def test_cosine(toy_a, toy_b):
    check(S.cosine(toy_a), {(1, 2): 0.321403, (1, 3): 0.529256, (2, 3): 0.963925})
    check(S.cosine(toy_a, axis="item"), {(1, 2): 0.5547, (1, 3): 0.122513, (2, 3): 0.883452})
    check(S.cosine(toy_b, axis="item"), {
        (1, 2): 0.302984, (1, 3): 0.248229, (1, 4): 0.829132, (2, 3): 0.762121, (2, 4): 0.311286, (3, 4): 0.510061})


def test_jaccard(toy_a, toy_b):
    check(S.jaccard(toy_a), {(1, 2): 1 / 3, (1, 3): 2 / 3, (2, 3): 2 / 3})
    check(S.jaccard(toy_b, axis="item"), {
        (1, 2): .2, (1, 3): .2, (1, 4): .75, (2, 3): .5, (2, 4): .4, (3, 4): .4})


def test_axis_swap_is_transpose(toy_a):
    swapped = toy_a.select(F.col("item_id").alias("user_id"), F.col("user_id").alias("item_id"), "rating")
    assert sims(S.pearson(toy_a, axis="item")) == sims(S.pearson(swapped, axis="user"))
    with pytest.raises(ValueError):
        S.pearson(toy_a, axis="cell")


def test_rmse_mae(spark):
    df = spark.createDataFrame([(4.0, 3.0), (4.0, 5.0), (4.0, None)], ["a", "p"])
    assert E.rmse_mae(df, "a", "p").first().asDict() == {"n": 2, "n_failed": 1, "rmse": 1.0, "mae": 1.0}


def test_hit_and_gain(spark):
    df = spark.createDataFrame([(list("abcdefghij"), "d"), (list("abc"), "a"), (list("abc"), "z")], ["rec", "truth"])
    pos = E.list_position(F.col("rec"), F.col("truth"))
    rows = df.select(*E.hit_and_gain(pos, 5), *E.hit_and_gain(pos, 3)).collect()
    assert [r[0] for r in rows] == [1, 1, 0] and [r[2] for r in rows] == [0, 1, 0]
    assert rows[0][1] == pytest.approx(0.430677, abs=1e-6) and rows[1][1] == 1 and rows[2][1] == 0


def test_bleu_and_rouge(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat on the mat"), (2, "a b", "c"), (3, "a b", "")],
                               ["id", "ref", "out"])
    b = {r["id"]: r for r in M.bleu(df, "id", "ref", "out").collect()}
    assert b[1]["bleu_1"] == pytest.approx(0.818731, abs=1e-6)
    assert b[1]["bleu_2"] == pytest.approx(0.709042, abs=1e-6)
    assert b[2]["bleu_1"] == 0 and b[3]["bleu_4"] == 0
    r = M.rouge_n(df, "id", "ref", "out", (1,), unique=False).filter("id = 1").first()
    assert (r["recall"], r["precision"], r["f1"]) == (0.833333, 1.0, 0.909091)
    r = M.rouge_n(df, "id", "ref", "out", (1,)).filter("id = 1").first()
    assert (r["recall"], r["precision"], r["f1"]) == (0.8, 1.0, 0.888889)
    r = {x["id"]: x for x in M.rouge_l(df, "id", "ref", "out").collect()}
    assert (r[1]["lcs"], r[1]["recall"], r[1]["precision"]) == (5, 0.833333, 1.0) and r[3]["f1"] == 0


def test_common_subsequence_against_table():
    import random

    rng = random.Random(1)
    for _ in range(50):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert M._common_length(a, b) == table[-1][-1]


@pytest.mark.parametrize("text, dialect, want", [
    ("(4.5 stars, 80%)", "stars", 4.5), ("5", "stars", None), ("7 stars", "stars", None), ("4 Star", "stars", 4.0),
    ("5", "integer", 5.0), ("would be 4", "phrase", 4.0), ("rating 3.5", "phrase", 3.5), ("4 stars", "phrase", 4.0),
    ("2.82 Fluid Ounce, 4 stars", "stars", 4.0), ("2.82 Fluid Ounce, 4 stars", "number", 2.82),
    (" 4.5 ", "whole", 4.5), ("4.5 stars", "whole", None), ("9", "whole", None), ("x", "digit", None), ("45", "digit", 4.0),
])
def test_parse_rating(spark, text, dialect, want):
    df = spark.createDataFrame([(text,)], ["t"])
    assert df.select(G.parse_rating(F.col("t"), dialect)).first()[0] == want
    assert df.select(G.parse_rating(F.col("t"), dialect, invalid=0)).first()[0] == (want or 0.0)


def test_cell_cleaning(spark):
    df = spark.createDataFrame([("1,234 in Beauty", "$12.5", "09 4, 2013", "{'Size:': ' L'}", "<b>x</b>y", 978300760),
                                ("none", "$1 - $2", "soon", "not json", "z", 0)],
                               ["rank", "price", "day", "style", "html", "t"])
    rows = df.select(
        X.first_number(F.col("rank")), X.price_number(F.col("price")), X.review_date(F.col("day")),
        X.nested_cell(F.col("style"), "map<string,string>"), X.strip_tags(F.col("html")),
        F.timestamp_seconds("t").cast("string"),
    ).collect()
    assert rows[0][:3] == (1.0, 12.5, dt.date(2013, 9, 4))
    assert rows[0][3] == {"Size:": " L"} and rows[0][4] == "xy" and rows[0][5] == "2000-12-31 22:12:40"
    assert rows[1][:3] == (None, None, None) and not rows[1][3]


def test_failed_predictions(spark):
    df = spark.createDataFrame([("4.5",), ("(None, 'Error')",), ("",), (None,), ("NaN",), (" 3 ",)], "p string")
    assert [r[0] for r in df.select(G.failed(F.col("p"))).collect()] == [False, True, True, True, True, False]


def test_digest(spark):
    row = spark.createDataFrame([(1, 5)], ["u", "i"]).select(
        md5_key("u", "i"), md5_int(F.md5(F.lit("a")))).first()
    assert row[0] == "5fc816a6460c2895b5fca137b4d5043c" and row[1] == 13375323


def test_blended_popularity(spark):
    rows = [("A", 5), ("A", 4), ("A", 5), ("B", 3), ("B", 4), ("C", 2), ("D", 1)]
    df = spark.createDataFrame(rows, ["item_id", "rating"]).withColumn("user_id", F.monotonically_increasing_id())
    scored, top = P.popular_items_blended(df)
    want = {}
    for item in "ABCD":
        r = [x for i, x in rows if i == item]
        want[item] = 0.5 * len(r) + 0.5 * (sum(r) / len(r)) * 3 / (14 / 3)
    got = {r["item_id"]: r["score"] for r in scored.collect()}
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    assert top.count() == 0  # int(4 * 0.2) items


def test_sequential_counts(spark):
    df = spark.createDataFrame([(1, i, 3.0, dt.datetime(2020, 1, 1 + i)) for i in range(7)],
                               ["user_id", "item_id", "rating", "ts"])
    got = {r["item_id"]: r["split"] for r in P.split_sequential(df).collect()}
    assert [got[i] for i in range(7)] == ["train"] * 5 + ["test"] * 2


def test_title_mean_predictor(spark):
    """Known, unknown, differently cased, missing and odd titles; an empty table."""
    train = spark.createDataFrame([(1, "Soap", 4.0), (2, "Soap", 2.0), (3, "#1 cream", 5.0)], ["user_id", "title", "rating"])
    asked = spark.createDataFrame([("Soap",), ("soap",), ("Gone",), (None,), ("#1 cream",)], "title string")
    got = {r["title"]: r["prediction"] for r in N.predict_item_mean(train, asked, "title").collect()}
    assert got == {"Soap": 3.0, "soap": None, "Gone": None, None: None, "#1 cream": 5.0}
    none = N.predict_item_mean(train.filter("false"), asked, "title")
    assert {r["prediction"] for r in none.collect()} == {None}


def test_row_text_keeps_missing_cells(spark):
    df = spark.createDataFrame([("Soap", None)], "title string, brand string")
    assert df.select(X.labelled_text(["title", "brand"])).first()[0] == "title: Soap. brand: nan"
    assert df.select(X.within_budget(F.lit("a b  c d"), 3)).first()[0] == "a b c"
    assert df.select(X.within_budget(F.lit("a b  c"), 3)).first()[0] == "a b  c"


def test_keyword_filter_and_mapping(spark):
    df = spark.createDataFrame([("CF PCC",), ("FS CF PCC",), ("cf",)], ["m"])
    assert [r[0] for r in L.keyword_filter(df, "m", ["CF"], ["FS"]).collect()] == ["CF PCC"]
    got = df.select(L.map_with_default(F.col("m"), {"cf": "x"}, "grey")).collect()
    assert [r[0] for r in got] == ["grey", "grey", "x"]


def test_confidence_interval(spark):
    errors = [0.0, 1.0, 2.0, 1.0]
    df = spark.createDataFrame([(e, 0.0) for e in errors], ["a", "p"])
    row = E.confidence_interval(df, "a", "p").first()
    sd = math.sqrt(sum((e - 1) ** 2 for e in errors) / 3)
    assert row["mae"] == 1.0 and row["mae_high"] == pytest.approx(1 + 1.96 * sd / 2, abs=1e-6)


def test_roles_are_names_only(spark):
    roles = Roles("u", "i", "r")
    df = spark.createDataFrame(TOY_A, ["u", "i", "r"])
    assert sims(S.pearson(df, roles))[(1, 3)] == pytest.approx(-1, abs=1e-5)
