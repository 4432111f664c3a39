"""Ratings of similar users, and numeric predictions from them.

Everything attached to a test row has a fixed size: k neighbours, n ratings each, or
one lookup per neighbour on the composite (user, item) key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastegrid.constants import RATINGS_PER_NEIGHBOR, SEED
from tastegrid.functions.hashing import md5_key
from tastegrid.operators.ranking import top_k
from tastegrid.operators.similarity import symmetrized
from tastegrid.roles import Roles
from tastegrid.session import stage

DEFAULT = Roles()
DIGITS = 6
LISTED = 100  # similar items of a target that are joined as a list
SIGNATURE = 256  # bits that tell which items a user cannot have rated
HASHED = {"byte", "short", "integer", "long", "string"}


def rated_lists(
    train: DataFrame, n: int, how: str = "top", roles: Roles = DEFAULT, seed: int = SEED
) -> DataFrame:
    """n ratings per user, numbered ``rank``: best rated, first in time, or random."""
    if how == "first" and roles.ts not in train.columns:
        raise ValueError(f"ratings in order of time need the column {roles.ts}")
    order = {
        "top": [F.col(roles.rating).desc(), F.col(roles.item)],
        "first": [F.col(roles.ts), F.col(roles.item)] if roles.ts in train.columns else None,
        "random": [md5_key(*roles.key, seed=seed)],
    }[how]
    return top_k(train, [roles.user], order, n, "rank")


def neighbor_ratings(
    neighbors: DataFrame, train: DataFrame, n: int = RATINGS_PER_NEIGHBOR,
    how: str = "top", roles: Roles = DEFAULT, seed: int = SEED,
) -> DataFrame:
    """(user, neighbor, sim, rn, rank, item, rating, ...) for each user's neighbours.
    ``how="all"`` keeps every rating of a neighbour."""
    who = neighbors.select(F.col("a").alias(roles.user), F.col("b").alias("neighbor"), "sim", "rn")
    lists = train if how == "all" else rated_lists(train, n, how, roles, seed)
    return who.join(lists.withColumnRenamed(roles.user, "neighbor"), "neighbor")


def neighbor_ratings_by_item(
    targets: DataFrame, neighbors: DataFrame, item_edges: DataFrame, train: DataFrame,
    n: int = RATINGS_PER_NEIGHBOR, roles: Roles = DEFAULT, listed: int = LISTED,
) -> DataFrame:
    """Per (user, target item, neighbour): the n ratings of the neighbour whose items are
    most similar to the target, then the neighbour's best rated.

    ``item_edges`` (a, b, sim), a < b, are similarities of items; those above 0 count, however
    many an item has. A target with fewer similar items than ``LISTED`` is joined by them with what
    the neighbours rated, and besides only a neighbour's n best rated rows are needed, as rows
    without a similar item come last. For other targets each rating of a neighbour is looked up
    by its pair with the target. n rows of a neighbour leave a task.
    """
    user, item, rating = roles.user, roles.item, roles.rating
    who = stage(neighbors.select(F.col("a").alias(user), F.col("b").alias("neighbor"), "sim", "rn"), "neighbors")
    history = train.select(F.col(user).alias("neighbor"), item, rating)
    sims = item_edges.filter(F.col("sim") > 0).select("a", "b", F.col("sim").alias("item_sim"))
    sims = stage(sims, "item-sims")
    both = symmetrized(sims.filter("a <> b")).unionByName(sims.filter("a = b"))
    wide = both.groupBy(F.col("a").alias("target")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= listed).select(
        "target", F.lit(True).alias("_wide"))
    aimed = targets.select(user, F.col(item).alias("target")).join(wide, "target", "left")
    few, many = aimed.filter(F.col("_wide").isNull()).drop("_wide"), aimed.filter(F.col("_wide")).drop("_wide")
    order = [F.col("item_sim").desc_nulls_last(), F.col(rating).desc(), F.col(item)]
    columns = ["neighbor", user, "target", "sim", "rn", item, rating, "item_sim"]

    near = both.select(F.col("a").alias("target"), F.col("b").alias(item), "item_sim")
    offered = who.join(history, "neighbor")  # what a user's neighbours rated, once for all of the user's targets
    hits = stage(few.join(near, "target").join(offered, [user, item]).select(*columns), "similar-rated")
    best = top_k(history, ["neighbor"], [F.col(rating).desc(), F.col(item)], n, "_rank").drop("_rank")
    rest = few.join(who, user).join(best, "neighbor").withColumn("item_sim", F.lit(None).cast("double"))
    place = [user, "target", "neighbor", item]  # a best rated row may be a hit as well
    by_list = hits.unionByName(rest.select(*columns).join(hits.select(*place), place, "left_anti").select(*columns))

    rated = many.join(who, user).join(history, "neighbor").withColumns({
        "a": F.least("target", item), "b": F.greatest("target", item)})
    by_pair = rated.join(sims, ["a", "b"], "left")
    return top_k(by_list.unionByName(by_pair.select(*columns)), [user, "target", "neighbor"], order, n, "rank")


def predict_item_mean(train: DataFrame, pairs: DataFrame, key: str, roles: Roles = DEFAULT) -> DataFrame:
    """Mean rating of the row's ``key`` (a title), null when it was never rated."""
    means = train.groupBy(key).agg(F.round(F.avg(roles.rating), DIGITS).alias("prediction"))
    return pairs.join(means, key, "left")


def predict_user_knn(
    train: DataFrame, pairs: DataFrame, neighbors: DataFrame, roles: Roles = DEFAULT
) -> DataFrame:
    """User mean plus the similarity-weighted deviation of the neighbours who rated the
    item; falls back to the user mean, the item mean, the global mean."""
    user, item, rating = roles.user, roles.item, roles.rating
    user_means = train.groupBy(user).agg(F.avg(rating).alias("_um"))
    item_means = train.groupBy(item).agg(F.avg(rating).alias("_im"))
    overall = train.agg(F.avg(rating).alias("m")).scalar()
    deviations = train.join(user_means, user).select(
        F.col(user).alias("neighbor"), item, (F.col(rating) - F.col("_um")).alias("_dev")
    )
    who = neighbors.select(F.col("a").alias(user), F.col("b").alias("neighbor"), "sim")
    weighed = (
        pairs.select(user, item).join(who, user).join(deviations, ["neighbor", item])
        .groupBy(user, item)
        .agg(
            (F.sum(F.col("sim") * F.col("_dev")) / F.nullif(F.sum(F.abs("sim")), F.lit(0.0))).alias("_shift"),
            F.count(F.lit(1)).alias("n_neighbors"),
        )
    )
    return (
        pairs.join(weighed, [user, item], "left")
        .join(user_means, user, "left").join(item_means, item, "left")
        .withColumn("n_neighbors", F.coalesce("n_neighbors", F.lit(0)))
        .withColumn("prediction", F.round(
            F.coalesce(F.col("_um") + F.col("_shift"), F.col("_um"), F.col("_im"), overall), DIGITS
        ))
        .drop("_shift", "_um", "_im")
    )


def predict_item_knn(
    train: DataFrame, pairs: DataFrame, item_neighbors: DataFrame, roles: Roles = DEFAULT
) -> DataFrame:
    """Similarity-weighted mean of the user's own ratings of the item's nearest items;
    null when the user rated none of them.

    A user's items are bits of a signature. A near item whose bit is not set is not rated, so only the others
    are joined with the ratings.
    """
    user, item, rating = roles.user, roles.item, roles.rating
    near = item_neighbors.select(F.col("a").alias(item), F.col("b").alias("_near"), "sim")
    own = train.select(user, F.col(item).alias("_near"), F.col(rating).alias("_r"))
    offered = pairs.select(user, item)
    kinds = {frame.schema["_near"].dataType.typeName() for frame in (near, own)}
    if len(kinds) == 1 and kinds <= HASHED:  # most near items are not rated, and do not travel
        words, bit = SIGNATURE // 64, F.pmod(F.xxhash64("_near"), F.lit(SIGNATURE)).cast("int")
        word, place = F.floor(bit / 64), bit % 64
        marks = own.groupBy(user).agg(*[
            F.bit_or(F.when(word == i, F.call_function("shiftleft", F.lit(1).cast("bigint"), place))).alias(f"_s{i}")
            for i in range(words)])
        mark = F.coalesce(*[F.when(word == i, F.col(f"_s{i}")) for i in range(words)])
        offered = offered.join(marks, user).join(near, item).filter(F.getbit(mark, place) == 1).select(
            user, item, "_near", "sim")
    else:
        offered = offered.join(near, item)
    weighed = (
        offered.join(own, [user, "_near"])
        .groupBy(user, item)
        .agg(
            (F.sum(F.col("sim") * F.col("_r")) / F.nullif(F.sum(F.abs("sim")), F.lit(0.0))).alias("_p")
        )
    )
    return pairs.join(weighed, [user, item], "left").withColumn(
        "prediction", F.round("_p", DIGITS)
    ).drop("_p")


def recommend_from_neighbors(
    rated: DataFrame, neighbors: DataFrame, n: int = 4, roles: Roles = DEFAULT,
) -> DataFrame:
    """Best ``n`` items that the user has not rated, by the summed similarity of the
    neighbours who rated them. Every rating of a neighbour counts."""
    user, item = roles.user, roles.item
    offered = neighbor_ratings(neighbors, rated, how="all", roles=roles)
    scores = offered.groupBy(user, item).agg(F.round(F.sum("sim"), DIGITS).alias("score"))
    fresh = scores.join(rated.select(user, item), [user, item], "left_anti")
    return top_k(fresh, [user], [F.col("score").desc(), F.col(item)], n)


def conflicts(ratings: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Items that a user's neighbours rated differently. Input: neighbor_ratings rows."""
    said = F.concat_ws(
        "=", F.col("neighbor").cast("string"), F.col(roles.rating).cast("string"),
        F.format_string("%.6f", "sim"),
    )
    # at most one entry per neighbour of the user
    return (
        ratings.groupBy(roles.user, roles.item)
        .agg(
            F.min(roles.rating).alias("lowest"), F.max(roles.rating).alias("highest"),
            F.count(F.lit(1)).alias("n_neighbors"),
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("rn", said.alias("s")))), lambda x: x["s"]),
                "; ",
            ).alias("said"),
        )
        .filter(F.col("lowest") < F.col("highest"))
    )


def sweep(
    pairs: DataFrame, neighbors: DataFrame, train: DataFrame,
    neighbor_counts: list[int], rating_counts: list[int], roles: Roles = DEFAULT, how: str = "top",
) -> DataFrame:
    """RMSE and MAE for every (neighbours, ratings per neighbour) setting in one pass.
    ``how`` picks a neighbour's ratings as in :func:`rated_lists`.

    The widest setting is joined once; each row is then counted in every setting whose
    limits it meets. The prediction is the similarity-weighted mean of the ratings.
    """
    user, item, rating = roles.user, roles.item, roles.rating
    lists = rated_lists(train, max(rating_counts), how, roles).select(
        F.col(user).alias("_n"), F.col(rating).alias("_r"), "rank"
    )
    who = neighbors.select(F.col("a").alias(user), F.col("b").alias("_n"), "sim", "rn")
    per_user = who.join(lists, "_n")
    settings = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"))
        for k in neighbor_counts for n in rating_counts
    ])
    counted = (
        per_user.select(user, "rn", "rank", "sim", "_r", F.explode(settings).alias("s"))
        .filter((F.col("rn") <= F.col("s.k")) & (F.col("rank") <= F.col("s.n")))
        .groupBy(user, F.col("s.k").alias("n_neighbors"), F.col("s.n").alias("n_ratings"))
        .agg((F.sum(F.col("sim") * F.col("_r")) / F.sum("sim")).alias("_p"))
    )
    err = F.col(rating) - F.col("_p")
    return (
        pairs.select(user, item, rating).join(counted, user)
        .groupBy("n_neighbors", "n_ratings")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sqrt(F.avg(err * err)), DIGITS).alias("rmse"),
            F.round(F.avg(F.abs(err)), DIGITS).alias("mae"),
        )
    )
