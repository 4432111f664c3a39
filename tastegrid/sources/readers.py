"""File sources with fixed schemas (no inference pass over the data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed schemas.
REVIEWS = (
    "reviewerID STRING, asin STRING, reviewerName STRING, overall DOUBLE, reviewText STRING, "
    "summary STRING, unixReviewTime BIGINT, reviewTime STRING, vote STRING, verified BOOLEAN, "
    "style MAP<STRING,STRING>, image ARRAY<STRING>"
)
ITEMS = (
    "asin STRING, title STRING, feature ARRAY<STRING>, description ARRAY<STRING>, price STRING, "
    "brand STRING, category ARRAY<STRING>, tech1 STRING, tech2 STRING, also_buy ARRAY<STRING>, "
    "also_view ARRAY<STRING>, details MAP<STRING,STRING>, main_cat STRING, similar_item STRING, "
    "date STRING, rank STRING, imageURL ARRAY<STRING>, imageURLHighRes ARRAY<STRING>"
)
MOVIE_RATINGS = "UserID INT, MovieID INT, Rating INT, Timestamp BIGINT"
MOVIE_USERS = "UserID INT, Gender STRING, Age INT, Occupation INT, `Zip-code` STRING"
MOVIES = "MovieID INT, Title STRING, Genres STRING"
PREDICTIONS = (
    "user_id STRING, item_id STRING, title STRING, actual_rating DOUBLE, predicted_rating STRING"
)
METHOD_RESULTS = (
    "Methods STRING, Dataset STRING, Features STRING, RMSE DOUBLE, CI_RMSE STRING, "
    "StdError_RMSE STRING, MAE DOUBLE, CI_MAE STRING, StdError_MAE STRING, `Wall Time` STRING"
)


def read_json_lines(
    spark: SparkSession, path: str, schema: str, partitions: int | None = None
) -> DataFrame:
    """JSON lines, gzip included. A gzip file is one split, so spread the rows when
    there are few large files: pass ``partitions``."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headered CSV whose quoted fields may span lines."""
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("escape", '"').csv(path)
    )


def read_delimited(
    spark: SparkSession, path: str, schema: str, sep: str = "::", encoding: str = "ISO-8859-1"
) -> DataFrame:
    """Headerless files with a multi-character separator."""
    return spark.read.schema(schema).option("sep", sep).option("encoding", encoding).csv(path)


def read_movie_star(spark: SparkSession, folder: str) -> DataFrame:
    """ratings x users x movies from a folder of ``::``-separated files."""
    movies = read_delimited(spark, f"{folder}/movies.dat", MOVIES)
    users = read_delimited(spark, f"{folder}/users.dat", MOVIE_USERS)
    rated = read_delimited(spark, f"{folder}/ratings.dat", MOVIE_RATINGS)
    return rated.join(users, "UserID").join(movies, "MovieID")
