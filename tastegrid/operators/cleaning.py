"""Cleaning, projection and the metadata joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.functions import text as X
from tastegrid.operators.ranking import top_k

JUNK_TITLE = "getTime"  # fixed marker of a script that leaked into a title


def fill_blank(df: DataFrame) -> DataFrame:
    return df.na.fill("")


def drop_junk_titles(df: DataFrame, title: str = "title", marker: str = JUNK_TITLE) -> DataFrame:
    return df.filter(~F.col(title).contains(marker))


def junk_titles(df: DataFrame, title: str = "title", marker: str = JUNK_TITLE) -> DataFrame:
    return df.filter(F.col(title).contains(marker))


def clean_items(df: DataFrame, unused: list[str] = ()) -> DataFrame:
    """Blank out nulls, drop junk titles, strip tags, drop unused columns."""
    return X.strip_tags_everywhere(drop_junk_titles(fill_blank(df))).drop(*unused)


def clean_reviews(df: DataFrame, required: list[str]) -> DataFrame:
    """Rename ``overall``, drop incomplete rows, cast rating and verified."""
    renamed = df.withColumnsRenamed({"overall": "rating"})
    return renamed.na.drop(subset=required).withColumns({
        "rating": F.col("rating").try_cast("double"),
        "verified": F.col("verified").try_cast("boolean"),
    })


def project_side(df: DataFrame, group: list[str]) -> DataFrame:
    """The columns of a named group that the table has."""
    return df.select(*[c for c in group if c in df.columns])


def point_lookup(df: DataFrame, **equals) -> DataFrame:
    for name, value in equals.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column with its number of nulls, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "n_null")


def map_with_default(col: Column, mapping: dict, default) -> Column:
    """Dictionary lookup with a default."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[col], F.lit(default))


def keyword_filter(
    df: DataFrame, column: str, include: list[str] = (), exclude: list[str] = ()
) -> DataFrame:
    """Case-sensitive: all of ``include``, none of ``exclude``."""
    for word in include:
        df = df.filter(F.col(column).contains(word))
    for word in exclude:
        df = df.filter(~F.col(column).contains(word))
    return df


def flatten_choices(df: DataFrame, choices: str, meta: list[str]) -> DataFrame:
    """One row per list element with the metadata repeated; empty lists keep a row."""
    one = df.select(*meta, F.explode_outer(choices).alias("_c"))
    return one.select(*meta, "_c.*")


def join_star3(ratings: DataFrame, users: DataFrame, movies: DataFrame, user: str, item: str) -> DataFrame:
    return ratings.join(users, user).join(movies, item)


def join_star4(links, movies, ratings, tags, item: str, user: str, ts: str) -> DataFrame:
    """links x movies x ratings x tags on the composite (item, user) key; the tag's own
    time column is dropped before the join instead of being renamed."""
    return (
        ratings.join(tags.drop(ts), [item, user]).join(movies, item).join(links, item)
    )


def attach_by_title(
    facts: DataFrame, predictions: DataFrame, title: str, value: str, order: list[Column]
) -> DataFrame:
    """Join one prediction per title back to the facts."""
    one = top_k(predictions, [title], order, 1, "_rn").select(title, value)
    return facts.join(one, title)
