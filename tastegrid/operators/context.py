"""Context text for batch scoring: one row per (user, target item) with its prompt.

Every list that goes into a text has a fixed length (history of k rows, k neighbours
with n ratings each), so the collected groups are bounded by parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tastegrid.constants import (
    CF_TEMPLATE, FEW_SHOT_TEMPLATE, HISTORY_HEADER, MAIN_USER_RATINGS, MIN_RATINGS, SEED,
    SIMILAR_HEADER, ZERO_SHOT_TEMPLATE,
)
from tastegrid.functions import text as X, vectors as V
from tastegrid.functions.hashing import md5_key
from tastegrid.operators.ranking import top_k
from tastegrid.roles import Roles

DEFAULT = Roles()
DIGITS = 6


def bullets(rows: DataFrame, keys: list[str], order: list[str], line: Column, name: str, sep: str = "\n") -> DataFrame:
    """Lines of each key joined in a total order."""
    cells = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(cells, lambda x: x["_line"]), sep).alias(name)
    )


def fill(template: str, target: Column) -> Column:
    """A prompt template with its ``{target}`` replaced."""
    before, after = template.split("{target}")
    return F.concat(F.lit(before), target, F.lit(after))


def history_line(columns: list[str], rating: str) -> Column:
    cells = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), X.shown(F.col(c))) for c in columns])
    return F.concat(F.lit("* "), cells, F.lit(" - Rating: "), F.col(rating).cast("string"), F.lit(" stars"))


def title_line(title: Column, rating: Column) -> Column:
    return F.concat(F.lit("* Title: "), X.shown(title), F.lit(", Rating: "), rating.cast("string"), F.lit(" stars"))


def _output(roles: Roles) -> list[Column]:
    return [
        F.col(roles.user).alias("user_id"), F.col(roles.item).alias("item_id"),
        F.col(roles.title).alias("title"), F.col(roles.rating).alias("actual_rating"),
    ]


def drawn_rows(df: DataFrame, roles: Roles = DEFAULT, k: int = MIN_RATINGS, seed: int = SEED) -> DataFrame:
    """The k first rows per user in digest order, numbered ``rn``: row 1 is the test row,
    the following rows are its history. Users with fewer than k rows are left out."""
    drawn = top_k(
        df.withColumn("_h", md5_key(*roles.key, seed=seed)), [roles.user], [F.col("_h")], k
    ).drop("_h")
    most = F.max("rn").over(W.partitionBy(roles.user))  # at most k rows per user here
    return drawn.withColumn("_m", most).filter(F.col("_m") == k).drop("_m")


def zero_shot(
    df: DataFrame, columns: list[str], roles: Roles = DEFAULT, seed: int = SEED,
    min_ratings: int = MIN_RATINGS,
) -> DataFrame:
    """One random row per active user, described by ``columns``."""
    drawn = drawn_rows(df, roles, min_ratings, seed)
    test = drawn.filter(F.col("rn") == 1)
    target = X.within_budget(X.labelled_text(columns, " | "))
    return test.select(*_output(roles), fill(ZERO_SHOT_TEMPLATE, target).alias("prompt"))


def few_shot(
    df: DataFrame, columns: list[str], roles: Roles = DEFAULT, k: int = MAIN_USER_RATINGS,
    seed: int = SEED,
) -> DataFrame:
    """A random row per user with k other ratings as history; users need k + 1 rows."""
    drawn = drawn_rows(df, roles, k + 1, seed)
    past = bullets(
        drawn.filter(F.col("rn") > 1), [roles.user], ["rn"],
        history_line(columns, roles.rating), "_history",
    )
    test = drawn.filter(F.col("rn") == 1)
    target = X.within_budget(X.labelled_text(columns))
    return test.join(past, roles.user).select(*_output(roles), F.concat(
        F.lit(HISTORY_HEADER), X.within_budget(F.col("_history")), fill(FEW_SHOT_TEMPLATE, target),
    ).alias("prompt"))


def zero_shot_for(targets: DataFrame, columns: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """The zero-shot prompt of given rows."""
    target = X.within_budget(X.labelled_text(columns, " | "))
    return targets.select(*_output(roles), fill(ZERO_SHOT_TEMPLATE, target).alias("prompt"))


def history_without_target(
    targets: DataFrame, ratings: DataFrame, roles: Roles = DEFAULT, k: int = MAIN_USER_RATINGS, seed: int = SEED,
) -> DataFrame:
    """(user, target, rn, the columns of ``ratings``): k rows of each target's user in digest order, never
    the target itself. ``ratings`` has one row per (user, item).

    k + 1 rows of a user leave k for each target, so a user with many ratings and many
    targets costs (k + 1) rows a target.
    """
    user, item = roles.user, roles.item
    own = ratings.join(targets.select(user).distinct(), user, "left_semi")
    first = top_k(own.withColumn("_h", md5_key(*roles.key, seed=seed)), [user], [F.col("_h")], k + 1, "_rn")
    rows = targets.select(user, F.col(item).alias("target")).distinct().join(first, user).filter(F.col(item) != F.col("target"))
    return top_k(rows, [user, "target"], [F.col("_rn")], k).drop("_h", "_rn")


def few_shot_for(
    targets: DataFrame, ratings: DataFrame, columns: list[str], roles: Roles = DEFAULT,
    k: int = MAIN_USER_RATINGS, seed: int = SEED,
) -> DataFrame:
    """The few-shot prompt of given rows. A user without other ratings has an empty history."""
    past = bullets(
        history_without_target(targets, ratings, roles, k, seed), [roles.user, "target"], ["rn"],
        history_line(columns, roles.rating), "_history",
    ).withColumnRenamed("target", roles.item)
    target = X.within_budget(X.labelled_text(columns))
    return targets.join(past, [roles.user, roles.item], "left").select(*_output(roles), F.concat(
        F.lit(HISTORY_HEADER), X.within_budget(F.coalesce("_history", F.lit(""))), fill(FEW_SHOT_TEMPLATE, target),
    ).alias("prompt"))


def cf_prompt(history: Column, similar: Column, title: Column) -> Column:
    target = X.within_budget(F.concat(F.lit("Title: "), X.shown(title)))
    return F.concat(
        F.lit(HISTORY_HEADER), X.within_budget(history),
        F.lit(SIMILAR_HEADER), X.within_budget(similar), fill(CF_TEMPLATE, target),
    )


def collaborative(
    targets: DataFrame, history: DataFrame, similar: DataFrame, similar_keys: list[str],
    roles: Roles = DEFAULT,
) -> DataFrame:
    """Targets with their own history and their neighbours' ratings as one prompt.

    ``history`` has the user's rows with ``rn``, for each ``target`` if it has such a column; ``similar`` has neighbour rows with
    ``rn`` (neighbour) and ``rank`` (rating), keyed by ``similar_keys``.
    """
    line = title_line(F.col(roles.title), F.col(roles.rating))
    own_keys = [roles.user] + [c for c in ("target",) if c in history.columns]
    own = bullets(history, own_keys, ["rn"], line, "_history").withColumnRenamed("target", roles.item)
    own_keys = [roles.item if k == "target" else k for k in own_keys]
    others = bullets(similar, similar_keys, ["rn", "rank"], line, "_similar")
    if "target" in similar_keys:
        others = others.withColumnRenamed("target", roles.item)
    keys = [roles.item if k == "target" else k for k in similar_keys]
    joined = targets.join(own, own_keys, "left").join(others, keys, "left")
    blank = F.lit("")
    return joined.select(*_output(roles), cf_prompt(
        F.coalesce("_history", blank), F.coalesce("_similar", blank), F.col(roles.title)
    ).alias("prompt"))


def grouped_by_neighbor(similar: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Neighbour ratings listed under each neighbour with its similarity."""
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), X.shown(F.col(roles.title)), F.lit(", "),
        F.col(roles.rating).cast("string"),
    )
    blocks = bullets(similar, [roles.user, "neighbor", "rn", "sim"], ["rank"], line, "_block")
    head = F.concat(
        F.lit("+ User "), F.col("neighbor").cast("string"), F.lit(" (similarity "),
        F.format_string("%.6f", "sim"), F.lit("):\n"), F.col("_block"),
    )
    return bullets(blocks, [roles.user], ["rn"], head, "context")


def semantic_history(
    targets: DataFrame, history: DataFrame, vectors: DataFrame, roles: Roles = DEFAULT
) -> DataFrame:
    """Mean cosine between each history item's vector and the target item's vector.

    ``vectors`` is (item, vector); vectors are scaled to length 1 once.
    """
    units = vectors.select(roles.item, V.unit(F.col("vector")).alias("_u"))
    goal = targets.select(roles.user, F.col(roles.item).alias("target")).join(
        units.select(F.col(roles.item).alias("target"), F.col("_u").alias("_t")), "target"
    )
    past = history.select(roles.user, roles.item).join(units, roles.item)
    return goal.join(past, roles.user).groupBy(roles.user, "target").agg(
        F.round(F.avg(V.dot(F.col("_u"), F.col("_t"))), DIGITS).alias("semantic_sim"),
        F.count(F.lit(1)).alias("n_history"),
    )
