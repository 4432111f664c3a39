"""Readers, writers, the vector cache and staged tables."""

import gzip
import json

from pyspark.sql import functions as F

from tastegrid.operators import cleaning as L, scoring as B
from tastegrid.session import fresh_path, shared_folder, stage
from tastegrid.sources import readers as I, writers as O


def test_json_lines_gz(spark, tmp_path):
    rows = [{"reviewerID": "U1", "asin": "P1", "overall": 5.0, "style": {"Size:": " L"}, "verified": True,
             "image": ["x.png"], "unixReviewTime": 1}, {"reviewerID": "U2", "asin": "P2", "extra": 1}]
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    got = I.read_json_lines(spark, str(tmp_path), I.REVIEWS, partitions=3).orderBy("asin").collect()
    assert got[0]["style"] == {"Size:": " L"} and got[0]["overall"] == 5.0 and got[1]["overall"] is None


def test_csv_keeps_quotes_and_lines(spark):
    df = spark.createDataFrame([("a", 'say "hi",\nthere'), ("b", None)], "k string, t string")
    path = fresh_path(spark, "csv-test")
    O.write_csv(df, path)
    assert {tuple(r) for r in I.read_csv(spark, path, "k string, t string").collect()} == {
        ("a", 'say "hi",\nthere'), ("b", None)}


def test_latin1_delimited(spark, tmp_path):
    (tmp_path / "movies.dat").write_bytes("1::Léon (1994)::Crime|Drama\n2::B: C::X\n".encode("latin-1"))
    got = {tuple(r) for r in I.read_delimited(spark, str(tmp_path / "movies.dat"), I.MOVIES).collect()}
    assert got == {(1, "Léon (1994)", "Crime|Drama"), (2, "B: C", "X")}


def test_prompt_completion_folders(spark):
    df = spark.createDataFrame([("train", "p1", " 4"), ("validation", "p2", " 5")], ["split", "p", "c"])
    path = fresh_path(spark, "jsonl-test")
    O.write_prompt_completion(df.select("split", O.prompt_completion(F.col("p"), F.col("c")).alias("line")), path)
    line = spark.read.text(f"{path}/split=train").first()[0]
    assert json.loads(line) == {"prompt": "p1", "completion": " 4"}


def test_vector_text(spark):
    df = spark.createDataFrame([([0.25, -1.5],)], "v array<double>")
    assert df.select(O.vector_from_text(O.vector_text(F.col("v")))).first()[0] == [0.25, -1.5]


def test_cache_is_filled_once(spark):
    path = fresh_path(spark, "cache-test")
    spark.createDataFrame([("a", "m", [1.0])], "text string, model string, vector array<double>").write.parquet(path)
    needed = spark.createDataFrame([("a", "m"), ("b", "m"), ("b", "m")], ["text", "model"])
    asked = []

    def score(misses):
        asked.append(misses.count())
        return misses.withColumn("vector", F.array(F.length("text").cast("double")))

    for _ in range(2):
        cache = O.fill_cache(spark, needed, path, ["text", "model"], score)
    assert asked == [1, 0] and cache.count() == 2


def test_staged_table_keeps_schema(spark):
    df = spark.range(5).withColumn("x", F.col("id") / 2)
    got = stage(df, "stage-test")
    assert got.dtypes == df.dtypes and got.agg(F.sum("x")).first()[0] == 5.0
    assert got.inputFiles()[0].replace("file://", "").startswith(shared_folder(spark).replace("file://", ""))


def test_flatten_keeps_rows_without_choices(spark):
    df = spark.createDataFrame([(1, [("a", 1), ("b", 2)]), (2, [])], "id int, choices array<struct<t:string,n:int>>")
    assert sorted(map(tuple, L.flatten_choices(df, "choices", ["id"]).collect()), key=str) == [
        (1, "a", 1), (1, "b", 2), (2, None, None)]


def test_star4_composite_key(spark):
    ratings = spark.createDataFrame([(1, 10, 4.0), (2, 10, 3.0)], ["userId", "movieId", "rating"])
    tags = spark.createDataFrame([(1, 10, "fun", 7), (2, 11, "dull", 8)], ["userId", "movieId", "tag", "timestamp"])
    movies = spark.createDataFrame([(10, "A")], ["movieId", "title"])
    links = spark.createDataFrame([(10, 99)], ["movieId", "imdbId"])
    got = L.join_star4(links, movies, ratings, tags, "movieId", "userId", "timestamp")
    assert [(r["userId"], r["tag"], r["title"], r["imdbId"]) for r in got.collect()] == [(1, "fun", "A", 99)]


def test_each_input_is_scored_once(spark):
    counter = spark.sparkContext.accumulator(0)

    def fn(values):
        counter.add(len(values))
        assert len(values) <= 3
        return [v.upper() for v in values]

    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], ["id", "t"])
    got = B.score_batches(df, fn, "t", "u", "string", batch=3).collect()
    assert counter.value == 7 and all(r["u"] == r["t"].upper() for r in got) and len(got) == 50


def test_repair_touches_failures_only(spark):
    old = spark.createDataFrame([(1, "4.0"), (2, "(None, 'Error')"), (3, ""), (4, None)], "id int, predicted_rating string")
    new = spark.createDataFrame([(1, 1.0), (2, 3.5), (3, None)], "id int, predicted_rating double")
    got = {r["id"]: (r["predicted_rating"], r["repaired"]) for r in B.repair(old, new, ["id"]).collect()}
    assert got == {1: ("4.0", False), 2: ("3.5", True), 3: ("", False), 4: (None, False)}
