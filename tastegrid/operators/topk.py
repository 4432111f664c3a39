"""The k most similar keys of every key, without the list of all pairs.

Keys are dealt into blocks. A block gets, besides its own rows, the raters of each feature
that it has a rating of: a feature's rows once per block, not once per pair. There all pairs
of one key come together, so overlaps are counted first, and the similarity, which is at most
``min(n, delta) / delta`` at an overlap of n, is worked out in the order of that bound until
no further pair can beat the k-th best. Only k rows a key leave the block.

On sparse tables the keys of a block hardly share a feature, and blocks would get every feature's
raters once per key. There the pairs are counted from partner lists instead (``pairs.cells``), and
only those with enough shared features become rows.

A block whose features have very many raters is dealt into several tasks by the partner's
hash, as many as its number of rows asks for; each task gives k rows a key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastegrid.constants import DELTA
from tastegrid.operators.pairs import numbers
from tastegrid.operators.ranking import top_k
from tastegrid.operators.similarity import top_neighbors, weighted_pearson
from tastegrid.roles import Roles

DEFAULT = Roles()
DIGITS = 6
FLAT = 1e-9  # a smaller sum of squared deviations counts as "no variance"
BLOCK_KEYS = 1024
TASK_ROWS = 1_000_000
PAIRS_AT_ONCE = 2_000_000


def _groups(sorted_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each run of equal codes."""
    first = np.flatnonzero(np.diff(sorted_codes, prepend=-1))
    return first, np.diff(np.append(first, len(sorted_codes)))


def best_partners(a, fa, x, b, fb, y, k, delta, min_common, least, pairs_at_once=PAIRS_AT_ONCE, tried=None):
    """(a, b, n_common, sim) arrays that hold the ``k`` best partners of each ``a``, and ties with the last.

    ``a`` (sorted) and ``b`` number the keys, equal numbers are one key; ``fa``, ``fb`` number the
    features. Key pairs with less than ``min_common`` shared features, without variance on them,
    or with a rounded similarity not above ``least`` are left out. ``tried`` collects how many
    similarities were worked out.
    """
    order = np.argsort(fb, kind="stable")
    b, fb, y = b[order], fb[order], y[order]
    lo, hi = np.searchsorted(fb, fa), np.searchsorted(fb, fa, side="right")
    met = np.cumsum(hi - lo)
    starts, lengths = _groups(a)
    ends = starts + lengths
    out = []
    at = 0
    while at < len(starts):  # keys whose pairs fit at once, one at least
        before = met[starts[at]] - (hi - lo)[starts[at]]
        to = max(at + 1, int(np.searchsorted(met[ends - 1] - before, pairs_at_once, side="right")))
        rows = np.arange(starts[at], ends[to - 1])
        n = (hi - lo)[rows]
        left = np.repeat(rows, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[rows], n)
        keep = a[left] != b[right]
        left, right = left[keep], right[keep]
        width = int(b.max()) + 1 if len(b) else 1
        code = a[left] * width + b[right]
        by = np.argsort(code, kind="stable")
        left, right, code = left[by], right[by], code[by]
        first, shared = _groups(code)
        enough = shared >= min_common
        first, shared = first[enough], shared[enough]
        if len(first):
            out.append(_best(code[first] // width, code[first] % width, first, shared, x[left], y[right],
                             k, delta, least, tried))
        at = to
    if not out:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(float)
    return tuple(np.concatenate(c) for c in zip(*out))


def _similarity(first, shared, x, y, delta):
    """Weighted Pearson of the pairs whose shared ratings begin at ``first``; NaN without variance."""
    rows = np.repeat(first - (np.cumsum(shared) - shared), shared) + np.arange(shared.sum())
    begin = np.cumsum(shared) - shared
    u, v = x[rows], y[rows]
    su, sv, suu, svv, suv = (np.add.reduceat(c, begin) for c in (u, v, u * u, v * v, u * v))
    vu, vv = np.maximum(suu - su * su / shared, 0), np.maximum(svv - sv * sv / shared, 0)
    varies = (vu > FLAT) & (vv > FLAT)
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = (suv - su * sv / shared) / (np.sqrt(vu) * np.sqrt(vv)) * np.minimum(shared, delta) / delta
    scaled = np.where(varies, sim, 0) * 10**DIGITS
    return np.where(varies, np.copysign(np.floor(np.abs(scaled) + 0.5), scaled) / 10**DIGITS + 0.0, np.nan)


def _best(a, b, first, shared, x, y, k, delta, least, tried):
    """Pairs sorted by ``a``, visited in rounds by falling overlap; see :func:`best_partners`."""
    bound = np.minimum(shared, delta) / delta
    order = np.lexsort((b, -shared, a))
    a, b, first, shared, bound = (c[order] for c in (a, b, first, shared, bound))
    start, length = _groups(a)
    turn = np.arange(len(a)) - np.repeat(start, length)
    found = []
    open_ = np.ones(len(a), bool)
    reach = np.full(len(a), -np.inf)  # of each pair, the k-th best similarity its key has found so far
    upto = max(2 * k, 8)
    best_a, best_sim = np.zeros(0, a.dtype), np.zeros(0)
    while open_.any():
        now = np.flatnonzero(open_ & (turn < upto))
        open_[now] = False
        if len(now):
            if tried is not None:
                tried.append(len(now))
            sim = _similarity(first[now], shared[now], x, y, delta)
            good = ~np.isnan(sim) if least is None else sim > least
            now, sim = now[good], sim[good]
            found.append((a[now], b[now], shared[now], sim))
            best_a, best_sim = np.concatenate([best_a, a[now]]), np.concatenate([best_sim, sim])
            by = np.lexsort((-best_sim, best_a))
            best_a, best_sim = best_a[by], best_sim[by]
            s, n = _groups(best_a)
            place = np.arange(len(best_a)) - np.repeat(s, n)
            last = place == k - 1
            at = np.searchsorted(best_a[last], a)
            if last.any():
                at = np.minimum(at, last.sum() - 1)
                full = best_a[last][at] == a
                reach = np.where(full, best_sim[last][at], reach)
            best_a, best_sim = best_a[place < k], best_sim[place < k]
        # a bound is not rounded, a similarity is
        open_ &= bound + 10.0**-DIGITS >= reach
        upto *= 4
    a, b, shared, sim = (np.concatenate(c) for c in zip(*found))
    by = np.lexsort((b, -sim, a))
    a, b, shared, sim = a[by], b[by], shared[by], sim[by]
    s, n = _groups(a)
    keep = np.arange(len(a)) - np.repeat(s, n) < k
    return a[keep], b[keep], shared[keep], sim[keep]


def top_weighted_pearson(
    df: DataFrame, k: int, roles: Roles = DEFAULT, axis: str = "user", delta: int = DELTA,
    min_sim: float | None = None, min_common: int = 2,
    block_keys: int = BLOCK_KEYS, task_rows: int = TASK_ROWS, pairs_at_once: int = PAIRS_AT_ONCE,
    list_pairs: bool | None = None,
) -> DataFrame:
    """(a, b, n_common, sim, rn): the first ``k`` keys b by weighted Pearson above ``min_sim``, ties by id.

    The same rows as ``top_neighbors(weighted_pearson(df), k, min_sim)``. One row per (user, item).
    ``list_pairs`` takes that way (True) or the blocks' (False); None takes the one that moves less.
    """
    key, feature = (roles.user, roles.item) if axis == "user" else (roles.item, roles.user)
    rows = df.select(F.col(key).alias("key"), F.col(feature).alias("f"), F.col(roles.rating).cast("double").alias("x"))
    key_type = rows.schema["key"].dataType.simpleString()
    n_keys = rows.agg(F.count_distinct("key")).first()[0]
    blocks = max(1, -(-n_keys // block_keys))
    raters = rows.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    if list_pairs is None:  # a feature goes to each block that has one of its raters, by expectation
        n, met = F.col("n"), blocks * (1 - F.pow(F.lit(1 - 1 / blocks), F.col("n")))
        rows_sent, n_pairs = raters.agg(
            F.coalesce(F.sum(n * met), F.lit(0.0)), F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))).first()
        list_pairs = rows_sent > n_pairs / 2
    if list_pairs:  # keys of a block have few features in common, and most pairs share too few to be listed
        return top_neighbors(weighted_pearson(df, roles, axis, delta, min_common), k, min_sim)
    own = rows.withColumn("blk", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    wanted = own.select("blk", "f").distinct()
    tasks = wanted.join(raters, "f").groupBy("blk").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("n") / task_rows)).cast("int").alias("tasks"))
    partners = wanted.join(tasks, "blk").join(rows, "f").select(
        "blk", F.pmod(F.xxhash64("key", F.lit(1)), F.col("tasks")).cast("int").alias("task"), "key", "f", "x"
    ).toDF("pblk", "ptask", "key", "f", "x")
    owners = own.join(tasks, "blk").select(
        "blk", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "key", "f", "x")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, (a, b) = numbers(left["key"], right["key"])
        _, (fa, fb) = numbers(left["f"], right["f"])
        order = np.argsort(a, kind="stable")
        a, b, n, sim = best_partners(
            a[order], fa[order], left["x"].to_numpy()[order], b, fb, right["x"].to_numpy(),
            k, delta, min_common, min_sim, pairs_at_once)
        return pa.table({"a": keys.take(pa.array(a)), "b": keys.take(pa.array(b)),
                         "n_common": pa.array(n.astype(np.int64)), "sim": pa.array(sim)})

    found = owners.groupBy("blk", "task").cogroup(partners.groupBy("pblk", "ptask")).applyInArrow(
        solve, f"a {key_type}, b {key_type}, n_common long, sim double")
    return top_k(found, ["a"], [F.col("sim").desc(), F.col("b")], k)
