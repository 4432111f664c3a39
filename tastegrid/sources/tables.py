"""Engine views over the star-schema tables in a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rating_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, item_id, rating 1..5, ts), one row per order line."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("item_id"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("ts"),
    )
    return lines.join(orders, "l_orderkey").select("user_id", "item_id", "rating", "ts")


def items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"),
    )


def ratings_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Rating lines with their item columns; a few (user, item) pairs repeat."""
    return rating_lines(spark, folder).join(items(spark, folder), "item_id")


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (user, item): mean rating, first time."""
    return rating_lines(spark, folder).groupBy("user_id", "item_id").agg(
        F.avg("rating").alias("rating"), F.min("ts").alias("ts")
    )


def titled_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """``ratings`` with the item title."""
    return ratings(spark, folder).join(
        items(spark, folder).select("item_id", "title"), "item_id"
    ).select("user_id", "item_id", "rating", "ts", "title")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label"
    )


def dirty_items(spark: SparkSession, folder: str) -> DataFrame:
    """Item metadata as scraped: price and rank as text, every 17th row damaged."""
    bad = F.col("p_partkey") % 17 == 0
    even = F.col("p_partkey") % 2 == 0
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("asin"),
        F.when(bad & even, F.concat(F.lit("var aPageStart = (new Date()).getTime();"), "p_name"))
        .when(bad, F.lit(None)).otherwise(F.concat(F.lit("<b>"), "p_name", F.lit("</b>")))
        .alias("title"),
        F.when(bad, F.lit(None)).otherwise(F.col("p_brand")).alias("brand"),
        F.when(bad & even, F.concat(F.lit("$1 - $"), F.col("p_retailprice").cast("string")))
        .when(bad, F.lit("")).otherwise(F.concat(F.lit("$"), F.col("p_retailprice").cast("string")))
        .alias("price"),
        F.when(bad, F.lit(None)).when(even, F.concat(
            F.lit("1,"), F.col("p_size").cast("string"), F.lit(" in "), "p_type"))
        .otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" in "), "p_type"))
        .alias("rank"),
    )


def scored_text(rated: DataFrame) -> DataFrame:
    """A stand-in for scored output: ``predicted_rating`` text by user number.

    Every seventh user failed with an error tuple, every next one came back blank.
    """
    kind = F.col("user_id") % 7
    return rated.withColumn(
        "predicted_rating",
        F.when(kind == 0, "(None, 'Error')").when(kind == 1, "")
        .otherwise((F.lit(1.0) + (F.col("user_id") + F.col("item_id")) % 5).cast("string")),
    )
