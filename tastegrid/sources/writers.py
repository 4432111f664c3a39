"""File sinks and the vector cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """Headered CSV; quotes are doubled so multi-line text survives."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = "::") -> None:
    """Headerless lines with a multi-character separator."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(sep, *cells).alias("value")).write.mode("overwrite").text(path)


def prompt_completion(prompt: Column, completion: Column) -> Column:
    """One fine-tuning record as a JSON line."""
    return F.to_json(F.struct(prompt.alias("prompt"), completion.alias("completion")))


def write_prompt_completion(df: DataFrame, path: str) -> None:
    """``df`` has (split, line); one subfolder of JSON lines per split."""
    df.select("split", F.col("line").alias("value")).write.mode("overwrite").partitionBy(
        "split"
    ).text(path)


def vector_text(vector: Column) -> Column:
    return F.to_json(vector)


def vector_from_text(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def cache_misses(needed: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct needed keys that the cache does not hold."""
    return needed.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")


def fill_cache(
    spark: SparkSession, needed: DataFrame, cache_path: str, keys: list[str],
    score: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Score only the missing keys, append them to the cache table, return the cache."""
    cache = spark.read.parquet(cache_path)
    score(cache_misses(needed, cache, keys)).select(*cache.columns).write.mode("append").parquet(
        cache_path
    )
    return spark.read.parquet(cache_path)
