"""Registered queries: sources, cleaning, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid import constants as C
from tastegrid.functions import parsing as G, text as X
from tastegrid.functions.hashing import md5_key, md5_unit
from tastegrid.operators import cleaning as L, splits as P
from tastegrid.plans.base import RAW, RATINGS, TITLED, UI, digest, digest_int, r6
from tastegrid.session import fresh_path, stage
from tastegrid.sources import readers as I, tables as T, writers as O

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


DIRTY = """dirty AS (
  SELECT p_partkey AS asin,
    CASE WHEN p_partkey % 17 = 0 AND p_partkey % 2 = 0 THEN 'var aPageStart = (new Date()).getTime();' || p_name
         WHEN p_partkey % 17 = 0 THEN NULL ELSE '<b>' || p_name || '</b>' END AS title,
    CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS brand,
    CASE WHEN p_partkey % 17 = 0 AND p_partkey % 2 = 0 THEN '$1 - $' || p_retailprice
         WHEN p_partkey % 17 = 0 THEN '' ELSE '$' || p_retailprice END AS price,
    CASE WHEN p_partkey % 17 = 0 THEN NULL
         WHEN p_partkey % 2 = 0 THEN '1,' || p_size || ' in ' || p_type
         ELSE p_size || ' in ' || p_type END AS rank
  FROM part)"""
REVIEWS = """reviews AS (
  SELECT 'U' || user_id AS "reviewerID", 'P' || item_id AS asin, CAST(rating AS VARCHAR) AS overall,
    CASE WHEN user_id % 5 = 0 THEN 'maybe' WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS verified,
    CASE WHEN item_id % 11 = 0 THEN NULL ELSE 'review of ' || item_id END AS "reviewText"
  FROM ratings)"""


def reviews(spark, d):
    """Ratings as raw review rows: everything is text, some texts are missing."""
    u, i = F.col("user_id"), F.col("item_id")
    return T.ratings(spark, d).select(
        F.concat(F.lit("U"), u.cast("string")).alias("reviewerID"),
        F.concat(F.lit("P"), i.cast("string")).alias("asin"),
        F.col("rating").cast("string").alias("overall"),
        F.when(u % 5 == 0, "maybe").when(u % 2 == 0, "true").otherwise("false").alias("verified"),
        F.when(i % 11 != 0, F.concat(F.lit("review of "), i.cast("string"))).alias("reviewText"),
    )


# --- sources and sinks -------------------------------------------------------------

@query("""SELECT p_partkey || '' AS asin, p_name AS title, p_brand AS brand,
  '$' || p_retailprice AS price, [p_type] AS category FROM part""")
def src_json(spark, d):
    path = fresh_path(spark, "items-json")
    p = T.table(spark, d, "part")
    p.select(
        F.col("p_partkey").cast("string").alias("asin"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.concat(F.lit("$"), F.col("p_retailprice").cast("string")).alias("price"),
        F.array("p_type").alias("category"),
    ).write.option("compression", "gzip").json(path)
    return I.read_json_lines(spark, path, I.ITEMS).select("asin", "title", "brand", "price", "category")


@query("""SELECT doc_id, text, lang, source, n_chars FROM documents""")
def src_csv(spark, d):
    """Multi-line quoted text through CSV and back."""
    path = fresh_path(spark, "documents-csv")
    O.write_csv(T.table(spark, d, "documents"), path)
    return I.read_csv(spark, path, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")


@query(f"""WITH {RAW} SELECT CAST(user_id AS INTEGER) AS "UserID", CAST(item_id AS INTEGER) AS "MovieID",
  CAST(rating AS INTEGER) AS "Rating", CAST(epoch(ts) AS BIGINT) AS "Timestamp" FROM raw""")
def src_dat(spark, d):
    path = fresh_path(spark, "ratings-dat")
    O.write_delimited(T.rating_lines(spark, d).select(
        "user_id", "item_id", F.col("rating").cast("int"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"),
    ), path)
    return I.read_delimited(spark, path, I.MOVIE_RATINGS)


@query(f"""WITH {TITLED},
parts AS (SELECT user_id, item_id, title, rating,
  CASE WHEN {digest_int(UI)} / CAST(268435456 AS DOUBLE) < 0.2 THEN 'validation' ELSE 'train' END AS split FROM titled)
SELECT split, 'Title: ' || title || '\n\nRating:' AS prompt, ' ' || rating || ' stars' AS completion FROM parts""")
def finetune_jsonl(spark, d):
    """Prompt/completion lines in train and validation folders, read back."""
    path = fresh_path(spark, "finetune")
    rows = T.titled_ratings(spark, d)
    prompt = F.concat(F.lit("Title: "), F.col("title"), F.lit("\n\nRating:"))
    completion = F.concat(F.lit(" "), F.col("rating").cast("string"), F.lit(" stars"))
    valid = md5_unit(md5_key("user_id", "item_id")) < C.TEST_RATIO
    O.write_prompt_completion(rows.select(
        F.when(valid, "validation").otherwise("train").alias("split"),
        O.prompt_completion(prompt, completion).alias("line"),
    ), path)
    return spark.read.schema("prompt STRING, completion STRING, split STRING").json(path)


@query(f"""SELECT vec_id, {r6('list_sum(CAST(embedding AS DOUBLE[]))')} AS total, len(embedding) AS width
FROM embeddings""")
def vec_roundtrip(spark, d):
    """Vectors through text and back."""
    text = T.vectors(spark, d).select("vec_id", O.vector_text(F.col("vector")).alias("t"))
    back = text.select("vec_id", O.vector_from_text(F.col("t")).alias("v"))
    return back.select(
        "vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
        F.size("v").cast("bigint").alias("width"),
    )


@query("""SELECT DISTINCT p_name AS text, 'small' AS model FROM part
WHERE
  p_name NOT IN (SELECT p_name FROM part WHERE p_size > 49)""")
def embed_cache_misses(spark, d):
    """Titles whose vector is not in the cache yet."""
    p = T.table(spark, d, "part").withColumn("model", F.lit("small"))
    needed = p.select(F.col("p_name").alias("text"), "model")
    cache = p.filter(F.col("p_size") > 49).select(F.col("p_name").alias("text"), "model")
    return O.cache_misses(needed, cache, ["text", "model"])


# --- cleaning ----------------------------------------------------------------------

@query(f"""WITH {DIRTY} SELECT asin, regexp_replace(coalesce(title, ''), '<[^>]+>', '', 'g') AS title,
  coalesce(brand, '') AS brand FROM dirty WHERE NOT contains(coalesce(title, ''), 'getTime')""")
def clean_items(spark, d):
    return L.clean_items(T.dirty_items(spark, d), ["price", "rank"])


@query(f"WITH {DIRTY} SELECT count(*) AS n_junk FROM dirty WHERE contains(title, 'getTime')")
def junk_items(spark, d):
    return L.junk_titles(T.dirty_items(spark, d)).agg(F.count(F.lit(1)).alias("n_junk"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS html FROM pages")
def strip_html(spark, d):
    return X.strip_tags_everywhere(T.table(spark, d, "pages").select("page_id", "html"))


@query(f"""WITH {RATINGS}, {REVIEWS} SELECT "reviewerID", asin, TRY_CAST(overall AS DOUBLE) AS rating,
  TRY_CAST(verified AS BOOLEAN) AS verified, "reviewText" FROM reviews WHERE "reviewText" IS NOT NULL""")
def clean_reviews(spark, d):
    return L.clean_reviews(reviews(spark, d), ["reviewText", "rating"])


@query(f"""WITH {DIRTY} SELECT asin, TRY_CAST(nullif(regexp_extract(rank, '(\\d+)', 1), '') AS DOUBLE) AS rank FROM dirty""")
def clean_rank(spark, d):
    return T.dirty_items(spark, d).select("asin", X.first_number(F.col("rank")).alias("rank"))


@query(f"""WITH {DIRTY} SELECT asin, TRY_CAST(replace(price, '$', '') AS DOUBLE) AS price FROM dirty""")
def clean_price(spark, d):
    return T.dirty_items(spark, d).select("asin", X.price_number(F.col("price")).alias("price"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS review_date,
  CAST(to_timestamp(epoch(o_orderdate)) AT TIME ZONE 'UTC' AS TIMESTAMP) AS review_time FROM orders""")
def clean_dates(spark, d):
    """Review date as text and as epoch seconds; every 13th text is damaged."""
    raw = T.table(spark, d, "orders").select(
        "o_orderkey", "o_orderdate",
        F.when(F.col("o_orderkey") % 13 == 0, "not a date")
        .otherwise(F.date_format("o_orderdate", "MM d, yyyy")).alias("reviewTime"),
        F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("o_orderdate")).alias("unixReviewTime"),
    )
    epoch = F.timestamp_seconds("unixReviewTime")
    return raw.select(
        "o_orderkey", X.review_date(F.col("reviewTime")).alias("review_date"),
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), epoch.cast("timestamp_ntz")).alias("review_time"),
    )


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, props AS raw FROM events""")
def parse_nested(spark, d):
    """Pseudo-JSON cells (single quotes) as maps, the raw text beside them."""
    events = T.table(spark, d, "events").withColumn("cell", F.replace("props", F.lit('"'), F.lit("'")))
    nested = X.nested_cell(F.col("cell"), "map<string,string>")
    return events.select("event_id", nested["k"].alias("k"), F.col("props").alias("raw"))


@query("SELECT 'P' || p_partkey AS asin, p_name AS title, p_retailprice AS price, p_brand AS brand FROM part")
def project_side(spark, d):
    wide = T.table(spark, d, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("asin"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"), F.col("p_size").alias("internal"),
    )
    return L.project_side(wide, C.ITEM_SIDE_REVIEWS)


@query(f"""WITH {RAW} SELECT user_id, item_id, rating, ts FROM raw WHERE user_id IN
  (SELECT user_id FROM raw GROUP BY 1 HAVING count(*) >= 40)""")
def active_users(spark, d):
    return P.active_users(T.rating_lines(spark, d), at_least=40)


@query(f"""WITH {TITLED} SELECT user_id, item_id, title, rating FROM titled WHERE user_id = 7 AND title LIKE '%ring'
  AND title = (SELECT min(title) FROM titled WHERE user_id = 7 AND title LIKE '%ring')""")
def point_lookup(spark, d):
    rows = T.titled_ratings(spark, d).select("user_id", "item_id", "title", "rating")
    mine = L.point_lookup(rows, user_id=7).filter(F.col("title").endswith("ring"))
    first = mine.agg(F.min("title").alias("t")).scalar()
    return mine.filter(F.col("title") == first)


@query(f"""WITH {DIRTY}
SELECT 'asin' AS column_name, count(*) FILTER (WHERE asin IS NULL) AS n_null FROM dirty UNION ALL
SELECT 'title', count(*) FILTER (WHERE title IS NULL) FROM dirty UNION ALL
SELECT 'brand', count(*) FILTER (WHERE brand IS NULL) FROM dirty UNION ALL
SELECT 'price', count(*) FILTER (WHERE price IS NULL) FROM dirty UNION ALL
SELECT 'rank', count(*) FILTER (WHERE rank IS NULL) FROM dirty""")
def null_profile(spark, d):
    return L.null_profile(T.dirty_items(spark, d))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'red' WHEN '2-HIGH' THEN 'orange'
  ELSE 'grey' END AS color FROM orders""")
def map_default(spark, d):
    colors = {"1-URGENT": "red", "2-HIGH": "orange"}
    return T.table(spark, d, "orders").select(
        "o_orderkey", L.map_with_default(F.col("o_orderpriority"), colors, "grey").alias("color")
    )


@query(f"""WITH {DIRTY} SELECT asin,
  'title: ' || coalesce(title, 'nan') || '. brand: ' || coalesce(brand, 'nan') || '. price: ' || coalesce(price, 'nan') AS combined,
  'title: ' || coalesce(title, 'nan') || ' | brand: ' || coalesce(brand, 'nan') AS piped FROM dirty""")
def row_text(spark, d):
    return T.dirty_items(spark, d).select(
        "asin", X.labelled_text(["title", "brand", "price"]).alias("combined"),
        X.labelled_text(["title", "brand"], " | ").alias("piped"),
    )


@query("""WITH w AS (SELECT doc_id, text,
  list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS words FROM documents)
SELECT doc_id, CASE WHEN len(words) > 200 THEN array_to_string(words[1:200], ' ') ELSE text END AS text,
  CAST(len(words) AS BIGINT) AS n_tokens FROM w""")
def truncate_tokens(spark, d):
    text = F.col("text")
    return T.table(spark, d, "documents").select(
        "doc_id", X.within_budget(text, 200).alias("text"),
        F.size(X.tokens(text)).cast("bigint").alias("n_tokens"),
    )


@query("""SELECT conv_id, turn, 0 AS idx, role AS kind, text AS content FROM conversations
UNION ALL SELECT conv_id, turn, 1, 'length', CAST(length(text) AS VARCHAR) FROM conversations""")
def flatten_choices(spark, d):
    """A nested answer list per turn, flattened with the turn's metadata repeated."""
    nested = T.table(spark, d, "conversations").select("conv_id", "turn", F.array(
        F.struct(F.lit(0).alias("idx"), F.col("role").alias("kind"), F.col("text").alias("content")),
        F.struct(F.lit(1).alias("idx"), F.lit("length").alias("kind"),
                 F.length("text").cast("string").alias("content")),
    ).alias("choices"))
    return L.flatten_choices(nested, "choices", ["conv_id", "turn"])


SCORED = """scored AS (SELECT user_id, item_id, rating AS actual_rating,
  CASE user_id % 7 WHEN 0 THEN '(None, ''Error'')' WHEN 1 THEN ''
    ELSE CAST(CAST(1 + (user_id + item_id) % 5 AS DOUBLE) AS VARCHAR) END AS predicted_rating FROM ratings)"""


@query(f"""WITH {RATINGS}, {SCORED} SELECT user_id, item_id, predicted_rating,
  TRY_CAST(predicted_rating AS DOUBLE) IS NULL AS failed FROM scored""")
def flag_failed(spark, d):
    return T.scored_text(T.ratings(spark, d)).select(
        "user_id", "item_id", "predicted_rating", G.failed(F.col("predicted_rating")).alias("failed")
    )


# --- rating text dialects ------------------------------------------------------------

ANSWERS = """answers AS (SELECT user_id, item_id, CASE item_id % 9
  WHEN 0 THEN '(' || rating || ' stars, 80%)' WHEN 1 THEN CAST(CAST(trunc(rating) AS INTEGER) AS VARCHAR)
  WHEN 2 THEN 'I would give it a rating ' || rating WHEN 3 THEN 'it would be ' || rating || ' for me'
  WHEN 4 THEN '2.82 Fluid Ounce, ' || rating || ' stars' WHEN 5 THEN '7 stars'
  WHEN 6 THEN CAST(CAST(trunc(rating) AS INTEGER) AS VARCHAR) || ' Star' WHEN 7 THEN 'no idea'
  ELSE CAST(rating AS VARCHAR) END AS answer FROM ratings)"""


def answers(spark, d):
    r = F.col("rating").cast("string")
    whole = F.col("rating").cast("int").cast("string")
    kind = F.col("item_id") % 9
    text = (
        F.when(kind == 0, F.concat(F.lit("("), r, F.lit(" stars, 80%)")))
        .when(kind == 1, whole).when(kind == 2, F.concat(F.lit("I would give it a rating "), r))
        .when(kind == 3, F.concat(F.lit("it would be "), r, F.lit(" for me")))
        .when(kind == 4, F.concat(F.lit("2.82 Fluid Ounce, "), r, F.lit(" stars")))
        .when(kind == 5, "7 stars").when(kind == 6, F.concat(whole, F.lit(" Star")))
        .when(kind == 7, "no idea").otherwise(r)
    )
    return T.ratings(spark, d).select("user_id", "item_id", text.alias("answer"))


def _dialect(name: str, dialect: str, value: str, low: float, high: float):
    sql = f"""WITH {RATINGS}, {ANSWERS},
parsed AS (SELECT user_id, item_id, answer, TRY_CAST({value} AS DOUBLE) AS v FROM answers)
SELECT user_id, item_id, CASE WHEN v BETWEEN {low} AND {high} THEN v END AS parsed FROM parsed"""

    def run(spark, d):
        return answers(spark, d).select(
            "user_id", "item_id", G.parse_rating(F.col("answer"), dialect).alias("parsed")
        )

    run.__name__ = name
    query(sql)(run)


_dialect("parse_rating_a", "stars", "nullif(regexp_extract(answer, '(?i)(\\d+(\\.\\d+)?)\\s*(stars|star)\\b', 1), '')", 1, 5)
_dialect("parse_rating_b", "integer", "nullif(regexp_extract(answer, '(\\d+)', 1), '')", 1, 5)
# RE2 has no lookahead, so the alternatives are tried one by one; the texts hold at most one of them
_dialect("parse_rating_c", "phrase", """coalesce(nullif(regexp_extract(answer, '(\\d+(\\.\\d*)?)\\s*(stars|star)', 1), ''),
  nullif(regexp_extract(answer, 'rating\\s*(\\d+(\\.\\d*)?)', 1), ''),
  nullif(regexp_extract(answer, 'would be\\s*(\\d+(\\.\\d*)?)', 1), ''))""", 0.5, 5)
_dialect("parse_rating_d", "whole", "trim(answer)", 0.5, 5)
_dialect("parse_rating_e", "number", "nullif(regexp_extract(answer, '(\\d+(\\.\\d+)?)', 1), '')", 0.5, 5)
_dialect("parse_rating_digit", "digit", "nullif(regexp_extract(answer, '(\\d)', 1), '')", 1, 5)


# --- joins ---------------------------------------------------------------------------

@query(f"""WITH {RAW} SELECT user_id, item_id, rating, p_name AS title, p_brand AS brand
FROM raw JOIN part ON item_id = p_partkey""")
def join_reviews_items(spark, d):
    return T.ratings_raw(spark, d).select("user_id", "item_id", "rating", "title", "brand")


@query(f"""WITH {RAW} SELECT user_id, item_id, rating, c_mktsegment AS segment, p_name AS title, p_type AS genres
FROM raw JOIN customer ON user_id = c_custkey JOIN part ON item_id = p_partkey""")
def join_star3(spark, d):
    users = T.table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    movies = T.items(spark, d).select("item_id", "title", F.col("category").alias("genres"))
    rated = T.rating_lines(spark, d).select("user_id", "item_id", "rating")
    return L.join_star3(rated, users, movies, "user_id", "item_id")


@query(f"""WITH {RAW} SELECT CAST(user_id AS INTEGER) AS "UserID", CAST(item_id AS INTEGER) AS "MovieID",
  CAST(rating AS INTEGER) AS "Rating", c_mktsegment AS "Gender", p_name AS "Title", p_type AS "Genres"
FROM raw JOIN customer ON user_id = c_custkey JOIN part ON item_id = p_partkey""")
def src_movie_star(spark, d):
    """Three ``::``-separated files, read and joined."""
    path = fresh_path(spark, "movies")
    O.write_delimited(T.rating_lines(spark, d).select(
        "user_id", "item_id", F.col("rating").cast("int"), F.lit(0)), f"{path}/ratings.dat")
    O.write_delimited(T.table(spark, d, "customer").select(
        "c_custkey", "c_mktsegment", F.lit(25), F.lit(1), F.lit("00000")), f"{path}/users.dat")
    O.write_delimited(T.table(spark, d, "part").select("p_partkey", "p_name", "p_type"), f"{path}/movies.dat")
    return I.read_movie_star(spark, path).select("UserID", "MovieID", "Rating", "Gender", "Title", "Genres")


@query(f"""WITH {RAW}, tags AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id, l_returnflag AS tag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT r.user_id, r.item_id, rating, tag, p_name AS title, p_size AS "imdbId"
FROM raw r JOIN tags t ON r.user_id = t.user_id AND r.item_id = t.item_id JOIN part ON r.item_id = p_partkey""")
def join_star4(spark, d):
    lines = T.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"),
                                                 F.col("l_returnflag").alias("tag"))
    orders = T.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    tags = lines.join(orders, "l_orderkey").select("user_id", "item_id", "tag").distinct()
    movies = T.items(spark, d)
    links = movies.select("item_id", F.col("size").alias("imdbId"))
    rated = T.rating_lines(spark, d).select("user_id", "item_id", "rating")
    return L.join_star4(
        links, movies.select("item_id", "title"), rated, tags, "item_id", "user_id", "ts"
    ).select("user_id", "item_id", "rating", "tag", "title", "imdbId")


@query(f"""WITH {TITLED}, pred AS (SELECT p_name AS title, CAST(1 + p_size % 5 AS DOUBLE) AS prediction,
    row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)
SELECT user_id, item_id, t.title, rating, prediction FROM titled t JOIN pred p ON t.title = p.title AND p.rn = 1""")
def join_pred_back(spark, d):
    pred = T.items(spark, d).select("item_id", "title", (1 + F.col("size") % 5).cast("double").alias("prediction"))
    facts = T.titled_ratings(spark, d).select("user_id", "item_id", "title", "rating")
    return L.attach_by_title(facts, pred, "title", "prediction", [F.col("item_id")])


POPULAR = f"""pop AS (SELECT item_id, n_ratings FROM (
  SELECT item_id, count(*) AS n_ratings, row_number() OVER (ORDER BY count(*) DESC, {digest('item_id')}) AS rn,
         count(*) OVER () AS n_items FROM ratings GROUP BY item_id) WHERE rn <= floor(n_items * 0.2))"""


@query(f"WITH {RATINGS}, {POPULAR} SELECT user_id, item_id, rating FROM ratings WHERE item_id IN (SELECT item_id FROM pop)")
def semi_popular(spark, d):
    r = stage(T.ratings(spark, d).select("user_id", "item_id", "rating"), "ratings")
    return r.join(P.popular_items(r).select("item_id"), "item_id", "left_semi")


@query(f"WITH {RATINGS}, {POPULAR} SELECT user_id, item_id, rating FROM ratings WHERE item_id NOT IN (SELECT item_id FROM pop)")
def anti_popular(spark, d):
    r = stage(T.ratings(spark, d).select("user_id", "item_id", "rating"), "ratings")
    return r.join(P.popular_items(r).select("item_id"), "item_id", "left_anti")
