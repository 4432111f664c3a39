"""Rating similarities as edge lists ``(a, b, n_common, sim)`` with ``a < b``.

``axis="user"`` compares users over items, ``axis="item"`` items over users. Input is
one row per (user, item); see ``interactions``. Pairs that are absent from an edge list
have similarity 0 or lie below the requested bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.constants import DELTA, EPSILON, VALID_NEIGHBOR_THRESHOLD
from tastegrid.functions.hashing import md5_key
from tastegrid.operators.pairs import BLOCK, bounded_pairs, co_rating_sums, numbers
from tastegrid.operators.ranking import row_index, top_k
from tastegrid.roles import Roles
from tastegrid.session import stage

DEFAULT = Roles()
DIGITS = 6
FLAT = 1e-9  # a smaller sum of squared deviations counts as "no variance"
USER_BLOCK = 2048  # profiles that a task compares with as many others
TILE_ROWS = 256
MOST_TASKS = 8192


def interactions(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """One row per (user, item) with the mean of duplicate ratings."""
    return df.groupBy(*roles.key).agg(F.avg(roles.rating).alias(roles.rating))


def interactions_binary(
    df: DataFrame, user: str, item: str, value: str, at_least: float = 1.0
) -> DataFrame:
    """(user, item) pairs whose summed value reaches the threshold."""
    return (
        df.groupBy(user, item).agg(F.sum(value).alias("total"))
        .filter(F.col("total") >= at_least)
    )


def wide_interactions(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """A row per user and a column per item of the data with the mean rating; 0 where there is none.

    For few items: a table has a column for each of them (Spark's pivot stops above
    ``spark.sql.pivotMaxValues``). Every other operator works on the long form.
    """
    return df.groupBy(roles.user).pivot(roles.item).agg(F.round(F.avg(roles.rating), DIGITS)).na.fill(0.0)


def _axis(roles: Roles, axis: str) -> tuple[str, str]:
    if axis == "user":
        return roles.user, roles.item
    if axis == "item":
        return roles.item, roles.user
    raise ValueError(f"unknown axis: {axis}")


def _edges(pairs: DataFrame, sim: Column) -> DataFrame:
    """Round to DIGITS by scaling to whole numbers, as SQL engines with binary rounding do."""
    scale = float(10**DIGITS)
    return pairs.select("a", "b", "n_common", (F.round(sim * scale) / scale).alias("sim"))


def _moments() -> tuple[Column, Column, Column]:
    """Centred product and squared deviations over the shared features."""
    n = F.col("n_common")
    sx, sy = F.col("sx"), F.col("sy")
    num = F.col("sxy") - sx * sy / n
    vx = F.col("sxx") - sx * sx / n
    vy = F.col("syy") - sy * sy / n
    return num, F.greatest(vx, F.lit(0.0)), F.greatest(vy, F.lit(0.0))


def pearson(
    df: DataFrame, roles: Roles = DEFAULT, axis: str = "user",
    min_common: int = 2, block: int = BLOCK,
) -> DataFrame:
    """Pearson over co-rated features. One shared feature gives 0, so 2 loses nothing."""
    key, feature = _axis(roles, axis)
    pairs = co_rating_sums(df, key, feature, roles.rating, min_common, block=block)
    num, vx, vy = _moments()
    sim = F.when((vx > FLAT) & (vy > FLAT), num / (F.sqrt(vx) * F.sqrt(vy) + EPSILON))
    return _edges(pairs, sim.otherwise(0.0))


def weighted_pearson(
    df: DataFrame, roles: Roles = DEFAULT, axis: str = "user", delta: int = DELTA,
    min_common: int = 2, block: int = BLOCK,
) -> DataFrame:
    """Pearson times ``min(n, delta) / delta``; pairs without variance are left out."""
    key, feature = _axis(roles, axis)
    pairs = co_rating_sums(df, key, feature, roles.rating, min_common, block=block)
    num, vx, vy = _moments()
    sim = num / (F.sqrt(vx) * F.sqrt(vy)) * F.least(F.col("n_common"), F.lit(delta)) / delta
    return _edges(pairs.filter((vx > FLAT) & (vy > FLAT)), sim)


def global_mean_pearson(
    df: DataFrame, roles: Roles = DEFAULT, axis: str = "item", delta: int = DELTA,
    min_common: int = 1, min_sim: float = 0.0, block: int = BLOCK,
) -> DataFrame:
    """Pearson around each key's overall mean, significance-weighted.

    |sim| cannot exceed ``n / delta``, so a bound on |sim| is a bound on the overlap.
    """
    key, feature = _axis(roles, axis)
    r = F.col(roles.rating)
    means = df.groupBy(key).agg(
        (F.sum(r) / (F.sum(F.least(r, F.lit(1.0))) + EPSILON)).alias("_mean")
    )
    dev = df.join(means, key).select(roles.user, roles.item, (r - F.col("_mean")).alias("_dev"))
    overlap = max(min_common, math.ceil(min_sim * delta - FLAT))
    pairs = co_rating_sums(
        dev, key, feature, "_dev", overlap, sums=("sxx", "syy", "sxy"), block=block
    )
    counted = F.least(F.col("n_common"), F.lit(delta))
    sim = F.col("sxy") / (F.sqrt("sxx") * F.sqrt("syy") + EPSILON) * counted / delta
    edges = _edges(pairs, sim)
    return edges.filter(F.abs("sim") >= min_sim) if min_sim else edges


def cosine(
    df: DataFrame, roles: Roles = DEFAULT, axis: str = "user",
    min_common: int = 1, min_sim: float = 0.0, block: int = BLOCK,
) -> DataFrame:
    """Cosine of zero-filled rating vectors: dot over shared, norms over all features.

    Rows are scaled to length 1 before pairing, so the pair needs no second lookup.

    ``min_sim`` keeps pairs that cannot reach it from being formed. With ``min_sim=0`` and
    ``min_common=1`` the result itself holds every co-rated pair, which grows with the square
    of the largest feature.
    """
    key, feature = _axis(roles, axis)
    r = F.col(roles.rating)
    norms = df.groupBy(key).agg(F.sqrt(F.sum(r * r)).alias("_norm"), F.count(F.lit(1)).alias("size"))
    scaled = df.join(norms, key).withColumn("_x", r / F.nullif(F.col("_norm"), F.lit(0.0))).filter(F.col("_x") != 0)
    if min_sim <= 0:  # a missing feature is common to nobody, as with a bound
        pairs = co_rating_sums(scaled.filter(F.col(feature).isNotNull()), key, feature, "_x", min_common, sums=("sxy",), block=block)
        return _edges(pairs, F.col("sxy"))
    rows = scaled.select(F.col(key).alias("key"), F.col(feature).alias("feature"), F.col("_x").cast("double").alias("x"), "size")
    pairs = bounded_pairs(rows, "cosine", min_sim - 10**-DIGITS, block).filter(F.col("n_common") >= min_common)
    return _edges(pairs, F.col("sxy")).filter(F.col("sim") >= min_sim)


def jaccard(
    df: DataFrame, roles: Roles = DEFAULT, axis: str = "user",
    min_common: int = 1, min_sim: float = 0.0, block: int = BLOCK,
) -> DataFrame:
    """Shared over united feature sets; pairs that cannot reach ``min_sim`` are not formed."""
    key, feature = _axis(roles, axis)
    rated = df.filter(F.col(roles.rating) != 0)
    sizes = rated.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    sized = rated.select(roles.user, roles.item).join(sizes, key)
    n = F.col("n_common")
    if min_sim <= 0:
        pairs = co_rating_sums(sized, key, feature, "size", min_common, sums=("sx", "sy"), block=block)
        return _edges(pairs, n / (F.col("sx") / n + F.col("sy") / n - n))  # each shared feature has both sizes
    rows = sized.select(F.col(key).alias("key"), F.col(feature).alias("feature"), F.lit(0.0).alias("x"), "size")
    pairs = bounded_pairs(rows, "jaccard", min_sim - 10**-DIGITS, block).filter(n >= min_common)
    edges = _edges(pairs, n / (F.col("na") + F.col("nb") - n).cast("double"))
    return edges.filter(F.col("sim") >= min_sim)


def corated_items(
    df: DataFrame, roles: Roles = DEFAULT, axis: str = "user",
    min_common: int = 2, block: int = BLOCK,
) -> DataFrame:
    """Pairs with the size of their shared feature set."""
    key, feature = _axis(roles, axis)
    return co_rating_sums(df, key, feature, F.lit(1.0), min_common, sums=(), block=block)


def symmetrized(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, from one pass over the edges."""
    rest = [F.col(c) for c in edges.columns if c not in ("a", "b")]
    both = F.array(
        F.struct(F.col("a"), F.col("b"), *rest),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), *rest),
    )
    return edges.select(F.inline(both))


def top_neighbors(edges: DataFrame, k: int, min_sim: float | None = None) -> DataFrame:
    """k most similar neighbours per key: (a, b, n_common, sim, rn), ties by id."""
    if min_sim is not None:
        edges = edges.filter(F.col("sim") > min_sim)
    return top_k(symmetrized(edges), ["a"], [F.col("sim").desc(), F.col("b")], k)


def valid_neighbors(
    edges: DataFrame, threshold: float = VALID_NEIGHBOR_THRESHOLD, keys: DataFrame | None = None
) -> DataFrame:
    """Neighbour rows above the threshold; ``keys`` adds each key as its own neighbour."""
    rows = symmetrized(edges).filter(F.col("sim") > threshold).select("a", "b", "sim")
    if keys is None:
        return rows
    name = keys.columns[0]
    own = keys.select(F.col(name).alias("a"), F.col(name).alias("b"), F.lit(1.0).alias("sim"))
    return rows.unionByName(own)


def item_traits(items: DataFrame, item: str) -> DataFrame:
    """(item, attribute, value) from a column per attribute; arrays have a row per entry, nulls none."""
    rows = None
    for name in items.columns:
        if name == item:
            continue
        several = items.schema[name].dataType.typeName() == "array"
        value = F.explode(name) if several else F.col(name)
        part = items.select(item, F.lit(name).alias("attribute"), value.cast("string").alias("value") if not several
                            else value.alias("value"))
        part = part.filter(F.col("value").isNotNull())
        rows = part if rows is None else rows.unionByName(part)
    return rows


def feature_profiles(df: DataFrame, traits: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """(user, attribute, value, w): what a user has rated, by its traits. Each attribute of a
    user has length 1, and weighs one part of all attributes that ``traits`` has."""
    w = df.join(traits, roles.item).groupBy(roles.user, "attribute", "value").agg(F.sum(roles.rating).alias("w"))
    length = w.groupBy(roles.user, "attribute").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_len"))
    n = traits.agg(F.count_distinct("attribute")).first()[0]
    return w.join(length, [roles.user, "attribute"]).select(
        roles.user, "attribute", "value", (F.col("w") / F.nullif("_len", F.lit(0.0)) / math.sqrt(max(n, 1))).alias("w"))


def _rounded(x: np.ndarray) -> np.ndarray:
    """To DIGITS, half away from zero, as in :func:`_edges`."""
    return np.copysign(np.floor(np.abs(x) * 10**DIGITS + 0.5), x) / 10**DIGITS + 0.0


def _products(left: tuple, right: tuple, tile: int = 512, at_once: int = 2**22) -> tuple[np.ndarray, np.ndarray]:
    """Dot products of all profiles of two blocks, and which pairs have a trait in common.

    A block is its number of users and the entries (user's place, trait, weight). Traits that many pairs of
    the blocks share are multiplied as matrices, the others are added pair by pair.
    """
    (nx, xu, xt, xw), (ny, yu, yt, yw) = left, right
    traits = np.intersect1d(xt, yt)
    xs, ys = np.isin(xt, traits), np.isin(yt, traits)
    (xu, xw, xp), (yu, yw, yp) = (xu[xs], xw[xs], np.searchsorted(traits, xt[xs])), (yu[ys], yw[ys], np.searchsorted(traits, yt[ys]))
    cx, cy = (np.bincount(p, minlength=len(traits)) for p in (xp, yp))
    many = cx * cy >= max(1, nx * ny // 128)
    out, met = np.zeros((nx, ny)), np.zeros((nx, ny), bool)
    dense = np.flatnonzero(many)
    for lo in range(0, len(dense), tile):
        own = dense[lo:lo + tile]
        sides = []
        for n, u, p, w in ((nx, xu, xp, xw), (ny, yu, yp, yw)):
            at = np.searchsorted(own, p)
            hit = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == p)
            m, has = np.zeros((n, len(own))), np.zeros((n, len(own)), np.float32)
            np.add.at(m, (u[hit], at[hit]), w[hit])
            has[u[hit], at[hit]] = 1
            sides.append((m, has))
        out += sides[0][0] @ sides[1][0].T
        met |= sides[0][1] @ sides[1][1].T > 0
    rare = np.flatnonzero(~many[xp])
    order = np.argsort(yp, kind="stable")
    first = np.cumsum(cy) - cy
    ends = np.cumsum(cy[xp[rare]])
    lo = 0
    while lo < len(rare):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + at_once, side="right")))
        own = rare[lo:hi]
        n = cy[xp[own]]
        x = np.repeat(own, n)
        y = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[xp[own]], n)]
        np.add.at(out, (xu[x], yu[y]), xw[x] * yw[y])
        met[xu[x], yu[y]] = True
        lo = hi
    return out, met


def _profile_blocks(profiles: DataFrame, roles: Roles, block: int) -> tuple[DataFrame, int]:
    """(blk, keys, u, t, w): the profiles of a block's users in one row, keys in order, entries by place and trait; the number of blocks."""
    known = profiles.select(F.col(roles.user).alias("key"), "attribute", "value", F.col("w").cast("double").alias("w")).dropna()
    known = stage(known, "profiles")
    traits = stage(row_index(known.select("attribute", "value").distinct(), md5_key("attribute", "value"), "t"), "traits")
    count = max(1, math.ceil(known.select("key").distinct().count() / block))
    rows = known.join(traits, ["attribute", "value"]).select(
        _block_of(F.col("key"), count).alias("blk"), "key", F.col("t").cast("int").alias("t"), "w")
    key_type = rows.schema["key"].dataType.simpleString()

    def pack(t: pa.Table) -> pa.Table:
        keys, (at,) = numbers(t["key"])
        return pa.table({"blk": t["blk"].slice(0, 1), **{name: pa.ListArray.from_arrays(
            pa.array([0, len(v)], pa.int32()), v) for name, v in (
                ("keys", keys), ("u", pa.array(at.astype(np.int32))), ("t", t["t"].combine_chunks()), ("w", t["w"].combine_chunks()))}})

    packed = rows.groupBy("blk").applyInArrow(pack, f"blk int, keys array<{key_type}>, u array<int>, t array<int>, w array<double>")
    return stage(packed, "profile-blocks"), count


def _block_of(key: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def feature_augmented(
    edges: DataFrame, profiles: DataFrame, roles: Roles = DEFAULT, alpha: float = 0.5, block: int = USER_BLOCK,
) -> DataFrame:
    """Blend rating similarity with profile similarity over the full outer set of pairs: a pair without a common
    trait has profile similarity 0, a pair with one but without an edge has ``n_common`` and rating similarity 0.

    Users are dealt into blocks of about ``block``. A task has the profiles of two blocks and the edges between
    them, and its pairs leave it a tile at a time; no list of pairs is shuffled.
    """
    blocks, count = _profile_blocks(profiles, roles, block)
    key_type = blocks.schema["keys"].dataType.elementType.simpleString()
    a_type, b_type, n_type = (edges.schema[c].dataType.simpleString() for c in ("a", "b", "n_common"))
    last = F.lit(count - 1)
    first = blocks.select(F.col("blk").alias("i"), F.explode(F.sequence("blk", last)).alias("j"), F.lit(0).alias("kind"), "keys", "u", "t", "w")
    second = blocks.select(F.explode(F.sequence(F.lit(0), "blk")).alias("i"), F.col("blk").alias("j"), F.lit(1).alias("kind"), "keys", "u", "t", "w")
    named = edges.select(F.col("a").cast(key_type).alias("a"), F.col("b").cast(key_type).alias("b"), F.col("n_common").cast("long").alias("n_common"), "sim")
    of_a, of_b = (_block_of(F.col(c), count) for c in "ab")
    listed = named.groupBy(F.least(of_a, of_b).alias("i"), F.greatest(of_a, of_b).alias("j")).agg(
        F.collect_list(F.struct("a", "b", "n_common", "sim")).alias("e")).select(
        "i", "j", F.lit(2).alias("kind"), *[F.col(f"e.{c}").alias(c) for c in named.columns])
    # a task's work is its pairs, not its bytes
    tasks = first.unionByName(second).unionByName(listed, allowMissingColumns=True).repartition(
        min(MOST_TASKS, count * (count + 1)), "i", "j")

    def blend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        own = rows["i"][0] == rows["j"][0]
        sides = []
        for kind in (0, 1):
            found = rows.filter(pc.equal(rows["kind"], kind))
            keys, u, t, w = (found[c].combine_chunks().flatten() for c in ("keys", "u", "t", "w"))
            sides.append((keys, (len(keys), u.to_numpy(), t.to_numpy(), w.to_numpy())))
        (ka, left), (kb, right) = sides
        products, met = _products(left, right)
        known = rows.filter(pc.equal(rows["kind"], 2))
        a, b, n, sim = (known[c].combine_chunks().flatten() for c in ("a", "b", "n_common", "sim"))
        ends = [pc.fill_null(pc.index_in(x, k), -1).to_numpy() for x, k in ((a, ka), (b, kb), (b, ka), (a, kb))]
        straight = (ends[0] >= 0) & (ends[1] >= 0)
        x, y = np.where(straight, ends[0], ends[2]), np.where(straight, ends[1], ends[3])
        there = np.flatnonzero((x >= 0) & (y >= 0))
        profile = np.zeros(len(x))
        profile[there] = products[x[there], y[there]]
        met[x[there], y[there]] = False  # the rest are the pairs without an edge
        if own:
            met[y[there], x[there]] = False
            met = np.triu(met, 1)
        names = ["a", "b", "n_common", "profile_sim", "sim", "edge"]
        both = alpha * pc.fill_null(sim, 0.0).to_numpy() + (1 - alpha) * profile
        yield pa.RecordBatch.from_arrays(
            [a, b, n, pa.array(profile), pa.array(both, mask=pc.is_null(sim).to_numpy(zero_copy_only=False)),
             pa.array(np.ones(len(x), bool))], names=names)
        keys, (ra, rb) = numbers(pa.chunked_array([ka]), pa.chunked_array([kb]))
        for lo in range(0, len(met), TILE_ROWS):
            x, y = np.nonzero(met[lo:lo + TILE_ROWS])
            x += lo
            p, q = np.minimum(ra[x], rb[y]), np.maximum(ra[x], rb[y])
            profile = products[x, y]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(p)), keys.take(pa.array(q)), pa.array(np.zeros(len(x), np.int64)),
                 pa.array(_rounded(profile)), pa.array(_rounded((1 - alpha) * profile)), pa.array(np.zeros(len(x), bool))], names=names)

    pairs = tasks.groupBy("i", "j").applyInArrow(
        blend, f"a {key_type}, b {key_type}, n_common long, profile_sim double, sim double, edge boolean")
    # of edges the session rounds, as it rounded their similarity; the many other pairs come rounded
    rounded = [F.when(F.col("edge"), F.round(c, DIGITS)).otherwise(F.col(c)).alias(c) for c in ("profile_sim", "sim")]
    return pairs.select(F.col("a").cast(a_type).alias("a"), F.col("b").cast(b_type).alias("b"),
                        F.col("n_common").cast(n_type).alias("n_common"), *rounded)
