"""Train/test splits and samples. Every draw is an md5 rank, so results do not depend
on partitioning, and every split is returned as one DataFrame with a ``split`` column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from tastegrid.constants import (
    MAIN_USER_RATINGS, MIN_RATINGS, POPULAR_SHARE, SEED, TEST_RATIO, TRAIN_RATIO,
)
from tastegrid.functions.hashing import md5_int, md5_key, md5_unit
from tastegrid.operators import ranking as R
from tastegrid.roles import Roles

DEFAULT = Roles()


def active_users(df: DataFrame, roles: Roles = DEFAULT, at_least: int = MIN_RATINGS) -> DataFrame:
    """Rows of users with at least ``at_least`` ratings."""
    keep = df.groupBy(roles.user).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
    return df.join(keep.select(roles.user), roles.user, "left_semi")


def split_sequential(
    df: DataFrame,
    roles: Roles = DEFAULT,
    train_ratio: float = TRAIN_RATIO,
    seed: int = SEED,
    parts: int | None = None,
) -> DataFrame:
    """Per user: the first ``floor(n * ratio)`` rows by time are train, the rest test.

    Rows lie in ranges of (user, time), so no task sorts more than a range, whatever a
    user's share of all rows; see ``range_ranks``. ``parts`` is the number of ranges.
    """
    ranked = R.range_ranks(df, [roles.user], [F.col(roles.ts), F.unhex(md5_key(*roles.key, seed=seed))], parts)
    split = F.when(F.col("_rank") <= F.floor(F.col("_rows") * F.lit(train_ratio)), "train")
    return ranked.withColumn("split", split.otherwise("test")).drop("_rank", "_rows")


def _flagged(df: DataFrame, roles: Roles, k: int, seed: int, chosen: str, other: str) -> DataFrame:
    """Flag the k md5-first rows per user; ``df`` must be unique on (user, item)."""
    picked = R.top_k(
        df.select(*roles.key).withColumn("_h", md5_key(*roles.key, seed=seed)),
        [roles.user], [F.col("_h")], k, "_rn",
    ).select(*roles.key, "_rn")
    return df.join(picked, roles.key, "left").withColumn(
        "split", F.when(F.col("_rn").isNotNull(), chosen).otherwise(other)
    ).drop("_rn")


def split_random_k(
    df: DataFrame, roles: Roles = DEFAULT, k: int = 1, seed: int = SEED
) -> DataFrame:
    """k random test rows per user, the rest is train."""
    return _flagged(df, roles, k, seed, "test", "train")


def split_leave_one_out(df: DataFrame, roles: Roles = DEFAULT, seed: int = SEED) -> DataFrame:
    """One random test row per user by a partial-aggregated minimum digest."""
    digest = md5_key(*roles.key, seed=seed)
    held = (
        df.select(*roles.key, digest.alias("_h"))
        .groupBy(roles.user)
        .agg(F.min_by(roles.item, "_h").alias(roles.item))
        .withColumn("_held", F.lit(True))
    )
    return df.join(held, roles.key, "left").withColumn(
        "split", F.when(F.col("_held"), "test").otherwise("train")
    ).drop("_held")


def split_first_k_train(
    df: DataFrame, roles: Roles = DEFAULT, k: int = MAIN_USER_RATINGS, seed: int = SEED
) -> DataFrame:
    """Active users: k random rows are train, all remaining rows are test."""
    return _flagged(active_users(df, roles), roles, k, seed, "train", "test")


def split_global(
    df: DataFrame, roles: Roles = DEFAULT, test_ratio: float = TEST_RATIO, seed: int = SEED
) -> DataFrame:
    """Bernoulli split by digest bucket: a projection, no shuffle."""
    unit = md5_unit(md5_key(*roles.key, seed=seed))
    return df.withColumn("split", F.when(unit < test_ratio, "test").otherwise("train"))


def split_global_exact(
    df: DataFrame,
    roles: Roles = DEFAULT,
    test_ratio: float = TEST_RATIO,
    seed: int = SEED,
    cell_rows: int = R.CELL_ROWS,
) -> DataFrame:
    """Exactly ``ceil(n * ratio)`` random test rows, found as one digest cut value."""
    n = math.ceil(df.count() * test_ratio)
    digest = md5_key(*roles.key, seed=seed)
    leveled, chosen = R.first_rows(df, R.md5_levels(digest), n, cell_rows)
    return leveled.withColumn("split", F.when(chosen, "test").otherwise("train")).select(
        *df.columns, "split"
    )


def split_global_sequential(
    df: DataFrame,
    roles: Roles = DEFAULT,
    test_ratio: float = TEST_RATIO,
    seed: int = SEED,
    cell_rows: int = R.CELL_ROWS,
) -> DataFrame:
    """The first ``int(n * (1 - ratio))`` rows of the whole table by time are train."""
    n = int(df.count() * (1 - test_ratio))
    levels = R.time_levels(roles.ts, md5_key(*roles.key, seed=seed))
    leveled, chosen = R.first_rows(df, levels, n, cell_rows)
    return leveled.withColumn("split", F.when(chosen, "train").otherwise("test")).select(
        *df.columns, "split"
    )


def item_popularity(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    return df.groupBy(roles.item).agg(F.count(F.lit(1)).alias("n_ratings"))


def popular_items(
    df: DataFrame,
    roles: Roles = DEFAULT,
    share: float = POPULAR_SHARE,
    seed: int = SEED,
    cell_rows: int = R.CELL_ROWS,
) -> DataFrame:
    """The ``int(share * n_items)`` most rated items; ties by item digest."""
    counts = item_popularity(df, roles)
    return _top_share(counts, roles, F.col("n_ratings"), share, seed, cell_rows).select(
        roles.item, "n_ratings"
    )


def popular_items_blended(
    df: DataFrame,
    roles: Roles = DEFAULT,
    share: float = POPULAR_SHARE,
    seed: int = SEED,
    cell_rows: int = R.CELL_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Blended score per item, and the items in its top share."""
    stats = df.groupBy(roles.item).agg(
        F.count(F.lit(1)).alias("n_ratings"), F.avg(roles.rating).alias("avg_rating")
    )
    scale = stats.agg((F.max("n_ratings") / F.max("avg_rating")).alias("scale")).scalar()
    scored = stats.withColumn(
        "score", F.round(0.5 * F.col("n_ratings") + 0.5 * F.col("avg_rating") * scale, 6)
    )
    return scored, _top_share(scored, roles, F.col("score"), share, seed, cell_rows)


def _top_share(items, roles, score, share, seed, cell_rows):
    n = int(items.count() * share)
    levels = {**R.double_levels(-score), **R.md5_levels(md5_key(roles.item, seed=seed))}
    leveled, chosen = R.first_rows(items, levels, n, cell_rows)
    return leveled.filter(chosen).drop(*levels)


def restrict_by_popularity(
    split: DataFrame, popular: DataFrame, roles: Roles = DEFAULT, which: str = "both"
) -> DataFrame:
    """Keep all train rows; test rows only of popular items, unpopular items or both."""
    test = split.filter(F.col("split") == "test")
    train = split.filter(F.col("split") == "train")
    keys = popular.select(roles.item)
    if which == "popular":
        kept = test.join(keys, roles.item, "left_semi")
    elif which == "unpopular":
        kept = test.join(keys, roles.item, "left_anti")
    elif which == "both":
        kept = test
    else:
        raise ValueError(f"unknown test set type: {which}")
    return train.unionByName(kept)


def history(
    df: DataFrame, roles: Roles = DEFAULT, k: int = MAIN_USER_RATINGS, seed: int = SEED,
    complete: bool = True,
) -> DataFrame:
    """k sampled rows per user, numbered ``rn``. Users with fewer than k rows are left
    out, or with ``complete=False`` keep all they have."""
    picked = R.top_k(
        df.withColumn("_h", md5_key(*roles.key, seed=seed)), [roles.user], [F.col("_h")], k
    ).drop("_h")
    if not complete:
        return picked
    most = F.max("rn").over(W.partitionBy(roles.user))  # at most k rows per user here
    return picked.withColumn("_m", most).filter(F.col("_m") == k).drop("_m")


def global_history(
    targets: DataFrame, pool: DataFrame, target: str, pool_key: list[str],
    k: int = MAIN_USER_RATINGS, seed: int = SEED,
) -> DataFrame:
    """k rows drawn from the whole pool for each target, as a join on drawn row numbers."""
    size = pool.agg(F.count(F.lit(1)).alias("n")).scalar()
    draws = targets.select(
        target, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("draw")
    ).withColumn("row_idx", F.pmod(md5_int(md5_key(target, "draw", seed=seed)), size))
    numbered = R.row_index(pool, md5_key(*pool_key, seed=seed))
    return draws.join(numbered, "row_idx")


def sample_keys(df: DataFrame, key: str, k: int, seed: int = SEED) -> DataFrame:
    """k distinct keys drawn at random; each partition keeps at most k."""
    return df.select(key).distinct().orderBy(md5_key(key, seed=seed), key).limit(k)


def drop_duplicates_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key in a total order (``dropDuplicates`` would keep any row)."""
    return R.top_k(df, keys, order, 1, "_rn").drop("_rn")


def negative_samples(
    positives: DataFrame, items: DataFrame, roles: Roles = DEFAULT,
    num_negatives: int = 4, seed: int = SEED,
) -> DataFrame:
    """Each positive (label 1) plus ``num_negatives`` uniformly drawn items (label 0)."""
    size = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    numbered = R.row_index(items.select(roles.item), md5_key(roles.item, seed=seed))
    drawn = positives.select(
        roles.user, F.col(roles.item).alias("pos_item"),
        F.explode(F.sequence(F.lit(1), F.lit(num_negatives))).alias("draw"),
    ).withColumn("row_idx", F.pmod(md5_int(md5_key(roles.user, "pos_item", "draw", seed=seed)), size))
    negatives = drawn.join(numbered, "row_idx").select(
        roles.user, "pos_item", "draw", roles.item, F.lit(0).alias("label")
    )
    return positives.select(
        roles.user, F.col(roles.item).alias("pos_item"), F.lit(0).alias("draw"),
        roles.item, F.lit(1).alias("label"),
    ).unionByName(negatives)


def split_by_popularity(
    df: DataFrame,
    how: str = "random",
    which: str = "both",
    measure: str = "count",
    roles: Roles = DEFAULT,
    required: tuple[str, ...] = (),
    share: float = POPULAR_SHARE,
    test_ratio: float = TEST_RATIO,
    seed: int = SEED,
    cell_rows: int = R.CELL_ROWS,
) -> DataFrame:
    """A split of the whole table whose test rows are of popular items, unpopular ones or both.

    Rows without an item, a rating or a value of the ``required`` columns go first, so they count neither
    for popularity nor for the split. ``how`` is ``random`` or ``sequential``, ``measure`` is ``count`` or
    ``blended`` (half number of ratings, half mean rating).
    """
    rows = df.dropna(subset=[roles.item, roles.rating, *required])
    if measure == "count":
        popular = popular_items(rows, roles, share, seed, cell_rows)
    elif measure == "blended":
        _, popular = popular_items_blended(rows, roles, share, seed, cell_rows)
    else:
        raise ValueError(f"unknown popularity measure: {measure}")
    if how == "random":
        split = split_global_exact(rows, roles, test_ratio, seed, cell_rows)
    elif how == "sequential":
        split = split_global_sequential(rows, roles, test_ratio, seed, cell_rows)
    else:
        raise ValueError(f"unknown kind of split: {how}")
    return restrict_by_popularity(split, popular, roles, which)
