"""Co-rating pairs: the join behind every rating similarity.

``co_rating_sums`` returns one row per pair (a < b) of keys that share at least
``min_common`` features, with the sums needed for Pearson, cosine and Jaccard.
"Key" and "feature" are user and item for user similarity, and the reverse for item
similarity.

Block pairs. The raters of a feature are dealt into blocks of bounded size, and what is
joined are blocks, not rows: (feature, i, j) for i < j, and each block with itself. A
feature rated by a third of all keys thus becomes many equal pieces of work, and no row of
the join stands for more than ``block`` squared pairs.

Lists, not pairs, are shuffled. A block gives each of its keys one row with the list of the
partners after it. The lists of a key meet in one cell of about ``TASK_PAIRS`` partners, which
counts them in arrays: most pairs share a single feature and never become a row. A key with
more partners than that is dealt into several cells by the partner's hash.

Bounds. With a bound on the similarity, features are put in classes by popularity. If all
that two keys share lies in the popular classes of one of them, and what that key has in
these classes cannot reach the bound, the pair cannot either. So each key leaves these
classes, its tail, out of the join. A pair that was found goes on if what it shares plus
the smaller tail can reach the bound, and gets the tail's share added then. Only class
sums by key are needed for this, never a key's rows in order.

Narrow lists. A key and its value are repeated in the lists of all partners, so they travel in
the fewest bytes that hold them exactly: see ``slim``. Lists of which only few pairs are kept are
made a share of the keys at a time (``ROUND_PAIRS``).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tastegrid.session import stage

BLOCK = 512
TASK_PAIRS = 2_000_000
TASK_CELLS = 8  # that one task may take one after the other
ROUND_PAIRS = 2**30  # list entries on disk at a time, where the pairs are written before they go on
CODES = 2**15 - 1  # distinct values that are numbered
CLASSES_PER_DOUBLING = 4  # of a feature's popularity
SLACK = 1e-9

# sums over the shared features of a pair; x belongs to a, y to b
SUMS = {
    "sx": lambda x, y: x, "sy": lambda x, y: y, "sxx": lambda x, y: x * x,
    "syy": lambda x, y: y * y, "sxy": lambda x, y: x * y,
}
OF_A, OF_B = {"sx", "sxx"}, {"sy", "syy"}  # a null of the other key does not matter to them
MOMENTS = tuple(SUMS)


def _sums(names: tuple[str, ...]) -> list[Column]:
    x, y = F.col("x"), F.col("y")
    return [
        F.count(F.lit(1)).alias("n_common"), *[F.sum(SUMS[n](x, y)).alias(n) for n in names]
    ]


def packed(rows: DataFrame, payload: list[str], block: int = BLOCK, cut: bool = True) -> DataFrame:
    """(feature, block, blocks, members): the keys of each feature, in blocks.

    Blocks are drawn by hash and filled to half of ``block`` by expectation. Without ``cut`` every
    feature is one block.
    """
    half = max(1, block // 2)
    dealt = rows.withColumn("blocks", F.lit(1))
    if cut:
        large = (
            rows.groupBy("feature").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > half)
            .select("feature", F.ceil(F.col("_n") / half).cast("int").alias("blocks"))
        )
        dealt = rows.join(large, "feature", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return (
        dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .groupBy("feature", "block", "blocks")
        .agg(F.sort_array(F.collect_list(F.struct("key", *payload))).alias("members"))
    )


def partner_lists(rows: DataFrame, payload: list[str], block: int = BLOCK) -> DataFrame:
    """(l, others): a key's struct and those of the keys after it that share a feature, a row or more
    for each feature of the key. ``rows`` is unique on (key, feature)."""
    blocks = packed(rows, payload, block)
    within = blocks.select("members", F.posexplode("members").alias("_i", "l")).select(
        "l", F.expr("slice(members, _i + 2, size(members))").alias("others")
    )
    return within.unionByName(_across(blocks)).filter(F.size("others") > 0)


def _across(blocks: DataFrame, share: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of :func:`partner_lists` whose partners lie in another block of the feature, of the keys of the ``share``."""
    many = blocks.filter(F.col("blocks") > 1)
    first = many.filter(F.col("block") < F.col("blocks") - 1).select(
        "feature", F.col("block").alias("i"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("j"),
        F.col("members").alias("of_i"),
    )
    second = many.filter(F.col("block") > 0).select(
        "feature", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"),
        F.col("members").alias("of_j"),
    )
    both_ways = F.array(F.struct(F.col("of_i").alias("p"), F.col("of_j").alias("q")),
                        F.struct(F.col("of_j").alias("p"), F.col("of_i").alias("q")))
    owned = first.join(second, ["feature", "i", "j"]).select(F.inline(both_ways)).select(F.explode("p").alias("l"), "q")
    return (
        (owned if share is None else owned.filter(share(F.col("l.key"))))
        .select("l", F.expr("filter(q, m -> m.key > l.key OR (l.key IS NULL AND m.key IS NOT NULL))").alias("others"))
    )


def _list_columns(rows: DataFrame, payload: list[str], block: int, cut: bool,
                  share: Callable[[Column], Column] | None = None) -> DataFrame:
    """:func:`partner_lists` with a plain column for each field: ``key`` and the payload of a key, ``_<name>``
    lists of its partners. Lists of numbers are cut as they are, structs would be taken apart. ``cut`` says
    whether any feature has more than one block."""
    fields = ["key", *payload]
    blocks = packed(rows, payload, block, cut)
    whole = blocks.select(*[F.col(f"members.{c}").alias(f"_{c}") for c in fields])
    owned = whole.select("*", F.posexplode("_key").alias("_i", "key"))
    listed = (owned if share is None else owned.filter(share(F.col("key")))).select(
        "key", *[F.expr(f"_{c}[_i]").alias(c) for c in payload],
        *[F.expr(f"slice(_{c}, _i + 2, size(_{c}))").alias(f"_{c}") for c in fields])
    if cut:
        listed = listed.unionByName(_across(blocks, share).select(
            *[F.col(f"l.{c}").alias(c) for c in fields], *[F.col(f"others.{c}").alias(f"_{c}") for c in fields]))
    return listed.filter(F.size("_key") > 0)


def block_pairs(rows: DataFrame, payload: list[str], block: int = BLOCK) -> DataFrame:
    """(l, r): structs of two different keys that share a feature, the smaller key as ``l``;
    a row for each feature that they share. ``rows`` is unique on (key, feature)."""
    return partner_lists(rows, payload, block).select("l", F.explode("others").alias("r"))


def _raters(rows: DataFrame) -> tuple[DataFrame, float, int]:
    """(feature, _n), staged, the entries that all partner lists have, and the keys of the most popular feature."""
    raters = stage(rows.groupBy("feature").agg(F.count(F.lit(1)).alias("_n")), "raters")
    entries, most = raters.agg(F.coalesce(F.sum(F.col("_n") * (F.col("_n") - 1) / 2), F.lit(0.0)),
                               F.coalesce(F.max("_n"), F.lit(0))).first()
    return raters, entries, most


def cells(rows: DataFrame, payload: list[str], block: int = BLOCK, task_pairs: int = TASK_PAIRS,
          counted: tuple[DataFrame, float, int] | None = None, turn: int = 0, rounds: int = 1) -> DataFrame:
    """(cell, part, a, a_<payload>, b, b_<payload>): partner lists, all that two keys share in one (cell, part).

    The number of cells follows the number of pairs. Keys that may have more than ``task_pairs``
    partners have several parts. Of several ``rounds`` each has the lists of its share of the keys;
    ``counted`` is what :func:`_raters` gave.
    """
    raters, entries, most = counted or _raters(rows)
    n_cells = max(1, math.ceil(entries / rounds / task_pairs))
    share = None if rounds == 1 else (lambda key: F.pmod(F.xxhash64(key, F.lit(7)), F.lit(rounds)) == turn)
    # only keys that could be heavy by their number of features are weighed
    widths = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_f"))
    widest = widths.agg(F.coalesce(F.max("_f"), F.lit(0))).first()[0]
    cut = most > max(1, block // 2)
    if widest * most > task_pairs:
        candidates = widths.filter(F.col("_f") * most > task_pairs).select("key")
        heavy = (
            rows.join(candidates, "key", "left_semi").join(raters, "feature").groupBy("key").agg(F.sum("_n").alias("_w"))
            .filter(F.col("_w") > task_pairs).select("key", F.ceil(F.col("_w") / task_pairs).cast("int").alias("_parts"))
        )
        weighed = rows.join(heavy, "key", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        lists = _list_columns(weighed, [*payload, "_parts"], block, cut, share)
        whole = lists.filter("_parts = 1").withColumn("part", F.lit(0))
        dealt = lists.filter("_parts > 1").withColumn("part", F.explode(F.expr("sequence(0, _parts - 1)")))
        mine = F.expr("transform(_key, k -> pmod(xxhash64(k, 1), _parts) = part)")
        dealt = dealt.withColumn("_mine", mine).withColumns({
            f"_{c}": F.filter(f"_{c}", lambda _, i: F.col("_mine")[i]) for c in ("key", *payload)}).drop("_mine")
        lists = whole.unionByName(dealt).filter(F.size("_key") > 0)
    else:
        lists = _list_columns(rows, payload, block, cut, share).withColumn("part", F.lit(0))
    placed = lists.select(
        F.pmod(F.xxhash64("key"), F.lit(n_cells)).alias("cell"), "part",
        F.col("key").alias("a"), *[F.col(c).alias(f"a_{c}") for c in payload],
        F.col("_key").alias("b"), *[F.col(f"_{c}").alias(f"b_{c}") for c in payload])
    tasks = -(-n_cells // TASK_CELLS)
    # what a task sorts stays small enough for its memory, however few partitions the session has
    few = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "cell", "part") if tasks > few else placed


def slim(rows: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """``rows`` (key, feature, x, ...) with a narrow ``key`` and ``x``, and the values that ``x`` then numbers, or None.

    Whole numbers within 32 bits become ``int``. Where ``x`` has at most ``CODES`` distinct values it is
    replaced by its place among them, else it stays. Nulls stay null. ``rows`` is read several times.
    """
    whole = rows.schema["key"].dataType.simpleString() == "bigint"
    low, high, kinds = rows.agg(*[f(F.col("key")) if whole else F.lit(None) for f in (F.min, F.max)],
                                F.approx_count_distinct("x")).first()
    if whole and low is not None and -2**31 <= low and high < 2**31:
        rows = rows.withColumn("key", F.col("key").cast("int"))
    if kinds > CODES:
        return rows, None
    found = [r[0] for r in rows.select("x").filter(F.col("x").isNotNull()).distinct().limit(CODES + 1).collect()]
    if not 0 < len(found) <= CODES:
        return rows, None
    values = np.sort(np.array(found, float))
    places = rows.sparkSession.createDataFrame(
        pd.DataFrame({"x": values, "_code": np.arange(len(values), dtype=np.int16)}), "x double, _code smallint")
    return rows.join(F.broadcast(places), "x", "left").drop("x").withColumnRenamed("_code", "x"), values


def numbers(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values in order, and each column as places among them."""
    if pa.types.is_integer(columns[0].type) and not any(col.null_count for col in columns):
        kinds, places = np.unique(np.concatenate([col.to_numpy() for col in columns]), return_inverse=True)
        return pa.array(kinds, columns[0].type), np.split(places, np.cumsum([len(col) for col in columns])[:-1])
    values = pa.chunked_array([c for col in columns for c in col.chunks], columns[0].type)
    kinds = values.unique().sort()
    return kinds, [pc.index_in(c, kinds).to_numpy().astype(np.int64) for c in columns]


def _again(a: pa.ChunkedArray, b: pa.ChunkedArray, owner: np.ndarray, min_common: int) -> np.ndarray | None:
    """Places in ``b`` whose pair may be met ``min_common`` times, those whose slot is met as often; None is all.

    Most pairs are met once. Whole numbers go to slots as they are, before keys are numbered.
    """
    if min_common < 2 or not pa.types.is_integer(a.type) or a.null_count or b.null_count or not len(b):
        return None
    bits = max(1, int(4 * len(b)).bit_length())
    with np.errstate(over="ignore"):
        code = (a.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[owner]
        code += b.to_numpy().astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    slot = (code >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] >= min_common)


def _pairs_of(cell: pa.Table, payload: list[str], min_common: int = 1) -> tuple:
    """Keys, (a, b) as places among them, and the payloads of both sides by name, an entry per list element.
    Elements whose pair is surely met less than ``min_common`` times may be left out. Without keys, places are the keys."""
    owner = np.repeat(np.arange(cell.num_rows), pc.list_value_length(cell["b"]).to_numpy())
    flat = {c: pc.list_flatten(cell[c]) for c in ("b", *[f"b_{c}" for c in payload])}
    at = _again(cell["a"], flat["b"], owner, min_common)
    if at is not None:
        owner, flat = owner[at], {c: column.take(pa.array(at)) for c, column in flat.items()}
    a, b = cell["a"], flat["b"]
    if a.type == pa.int32() and not a.null_count and not b.null_count and min(pc.min(a).as_py() or 0, pc.min(b).as_py() or 0) >= 0:
        keys, (a, b) = None, (c.to_numpy().astype(np.int64) for c in (a, b))
    else:
        keys, (a, b) = numbers(a, b)
    sides = {f"a_{c}": cell[f"a_{c}"].take(pa.array(owner)) for c in payload}
    sides |= {f"b_{c}": flat[f"b_{c}"] for c in payload}
    return keys, a[owner], b, sides


def _named(keys: pa.Array | None, places: np.ndarray, key_type: str) -> pa.Array:
    """The keys at these places, of the type that the query's keys have."""
    found = pa.array(places, pa.int32()) if keys is None else keys.take(pa.array(places))
    return found.cast(pa.int64()) if key_type == "bigint" else found


def _by_pair(a: np.ndarray, b: np.ndarray, min_common: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by pair, and where each pair begins and how long it is; shorter ones are left out."""
    width = int(b.max()) + 1 if len(b) else 1
    code = a * width + b
    if min_common > 1:  # most pairs are met once: only rows whose slot is met again are sorted
        slot = code % (4 * len(code) + 1)
        again = np.flatnonzero(np.bincount(slot)[slot] >= min_common)
    else:
        again = np.arange(len(code))
    order = again[np.argsort(code[again])]
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    n = np.diff(np.append(first, len(code)))
    enough = n >= min_common
    order, n = order[np.repeat(enough, n)], n[enough]
    return order, np.cumsum(n) - n, n


def _plain(column: pa.ChunkedArray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values, any for null, and which are not null. A column of places stands for ``values``."""
    plain = pc.fill_null(column, 0).to_numpy()
    return plain if values is None else values[plain], pc.is_valid(column).to_numpy()


def popularity_tails(rows: DataFrame, need: Column, weight: Column) -> DataFrame:
    """Adds ``last`` and ``tail`` to rows (key, feature, size, ...).

    ``last`` is the most popular class of features that the key must be found by, ``tail``
    what it has beyond (the sum of ``weight``), which is below ``need``.
    """
    degree = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("_d"))
    cls = F.floor(F.log2("_d") * CLASSES_PER_DOUBLING).cast("int")
    classed = rows.join(degree.select("feature", cls.alias("cls")), "feature")
    by_class = classed.groupBy("key", "cls").agg(F.sum(weight).alias("_w"), F.first(need).alias("_need"))
    # a key has a row per class here, whatever the number of its features
    above = W.partitionBy("key").orderBy(F.desc("cls")).rowsBetween(W.unboundedPreceding, 0)
    reached = by_class.withColumn("_sum", F.sum("_w").over(above))
    found = F.col("_sum") >= F.col("_need") - SLACK
    ends = reached.groupBy("key").agg(
        F.max(F.when(found, F.col("cls"))).alias("last"),
        F.coalesce(F.max(F.when(~found, F.col("_sum"))), F.lit(0)).cast("double").alias("tail"),
    )
    return classed.join(ends, "key").withColumn("last", F.coalesce("last", F.lit(-1)))


def co_rating_sums(
    ratings: DataFrame,
    key: str,
    feature: str,
    value: Column | str,
    min_common: int = 2,
    sums: tuple[str, ...] = MOMENTS,
    block: int = BLOCK,
) -> DataFrame:
    """Pairs (a, b, n_common) with the chosen ``sums``; input unique on (key, feature)."""
    value = F.col(value) if isinstance(value, str) else value
    rows = ratings.select(
        F.col(key).alias("key"), F.col(feature).alias("feature"), value.cast("double").alias("x")
    )
    key_type = rows.schema["key"].dataType.simpleString()
    rows, values = slim(stage(rows, "pair-rows"))

    def count(cell: pa.Table) -> pa.Table:
        keys, a, b, sides = _pairs_of(cell, ["x"], min_common)
        order, first, n = _by_pair(a, b, min_common)
        (x, has_x), (y, has_y) = (tuple(c[order] for c in _plain(sides[side], values)) for side in ("a_x", "b_x"))
        one = order[first]
        out = {"a": _named(keys, a[one], key_type), "b": _named(keys, b[one], key_type),
               "n_common": pa.array(n.astype(np.int64))}
        for name in sums:
            has = has_x if name in OF_A else has_y if name in OF_B else has_x & has_y
            if len(first):
                total = np.add.reduceat(np.where(has, SUMS[name](x, y), 0.0), first)
                out[name] = pa.array(total, pa.float64(), mask=~np.logical_or.reduceat(has, first))
            else:
                out[name] = pa.array([], pa.float64())
        return pa.table(out)

    schema = ", ".join([f"a {key_type}, b {key_type}, n_common long", *[f"{n} double" for n in sums]])
    return cells(rows, ["x"], block).groupBy("cell", "part").applyInArrow(count, schema)


def bounded_pairs(rows: DataFrame, kind: str, min_sim: float, block: int = BLOCK) -> DataFrame:
    """(a, b, n_common, sxy, na, nb) of all pairs (a < b) that can reach ``min_sim``, and of few others.

    ``rows``: (key, feature, x, size), unique on (key, feature). ``kind`` "jaccard" compares
    sets of ``size`` features; "cosine" takes x as a component of a vector of length 1.
    ``na`` and ``nb`` are the sizes; "cosine" has none.
    """
    if kind == "jaccard":
        need, weight = F.ceil(F.col("size") * min_sim - SLACK).cast("double"), F.lit(1.0)
    elif kind == "cosine":
        need, weight = F.lit(min_sim**2), F.col("x") * F.col("x")
    else:
        raise ValueError(f"unknown kind: {kind}")
    placed = stage(popularity_tails(rows, need, weight), "popularity-tails")
    front = placed.filter(F.col("cls") <= F.col("last"))
    key_type = rows.schema["key"].dataType.simpleString()
    payload = ["last", "tail", "x" if kind == "cosine" else "size"]
    # narrow types, as every partner carries them; a tail may be taken for a little more than it is
    front, values = slim(front.withColumns({
        "size": F.col("size").cast("int"), "last": F.col("last").cast("tinyint"), "tail": (F.col("tail") * (1 + 1e-6)).cast("float")}))

    def reach(cell: pa.Table) -> pa.Table:
        """The pairs of a cell that can reach the bound with what lies beyond the front."""
        keys, a, b, sides = _pairs_of(cell, payload)
        sides = {name: column.to_numpy() for name, column in sides.items()}
        if kind == "jaccard":  # sizes too far apart
            na, nb = sides["a_size"], sides["b_size"]
            near = np.flatnonzero((na >= nb * min_sim - SLACK) & (nb >= na * min_sim - SLACK))
            a, b, sides = a[near], b[near], {name: column[near] for name, column in sides.items()}
        order, first, n = _by_pair(a, b, 1)
        sxy = np.zeros(len(first))
        if kind == "cosine" and len(first):
            x, y = (sides[c] if values is None else values[sides[c]] for c in ("a_x", "b_x"))
            sxy = np.add.reduceat((x * y)[order], first)
        one = order[first]
        a, b, of = a[one], b[one], {name: column[one] for name, column in sides.items()}
        # what a pair shares beyond the earlier end lies in the tail of the key whose end that is
        short = np.where(of["a_last"] < of["b_last"], of["a_tail"], np.where(
            of["b_last"] < of["a_last"], of["b_tail"], np.minimum(of["a_tail"], of["b_tail"])))
        if kind == "jaccard":
            go_on = n + short >= (of["a_size"] + of["b_size"]) * (min_sim / (1 + min_sim)) - SLACK
        else:  # the rest is at most the tail's length, as the other key's vector has length 1
            go_on = sxy + np.sqrt(short) >= min_sim - SLACK
        na, nb = (pa.array(of[c][go_on].astype(np.int64)) if c in of else pa.nulls(int(go_on.sum()), pa.int64())
                  for c in ("a_size", "b_size"))
        return pa.table({
            "a": _named(keys, a[go_on], key_type), "b": _named(keys, b[go_on], key_type),
            "n_common": pa.array(n[go_on].astype(np.int64)), "sxy": pa.array(sxy[go_on], pa.float64()), "na": na, "nb": nb,
            "short": pa.array(short[go_on], pa.float64()), "a_ends": pa.array(of["a_last"][go_on] <= of["b_last"][go_on])})

    counted = _raters(front)
    rounds = max(1, math.ceil(counted[1] / ROUND_PAIRS))
    seen = reduce(lambda one, other: one.unionByName(other), [
        stage(cells(front, payload, block, counted=counted, turn=turn, rounds=rounds).groupBy("cell", "part").applyInArrow(
            reach, f"a {key_type}, b {key_type}, n_common long, sxy double, na long, nb long, short double, a_ends boolean"),
            "bounded-pairs") for turn in range(rounds)])
    whole, open_ = seen.filter("short = 0"), seen.filter("short > 0")

    def side(frame: DataFrame, name: str, value: str) -> DataFrame:
        return frame.select(F.col("key").alias(name), "feature", F.col("x").alias(value))

    beyond = placed.filter(F.col("cls") > F.col("last"))
    of_a = open_.filter("a_ends").select("a", "b").join(side(beyond, "a", "x"), "a").join(
        side(placed, "b", "y"), ["b", "feature"])
    of_b = open_.filter("NOT a_ends").select("a", "b").join(side(beyond, "b", "y"), "b").join(
        side(placed, "a", "x"), ["a", "feature"])
    cols, kept = ["a", "b", "x", "y"], ["a", "b", "n_common", "sxy", "na", "nb"]
    added = of_a.select(*cols).unionByName(of_b.select(*cols)).groupBy("a", "b").agg(*_sums(("sxy",)))
    more = open_.select(*kept).unionByName(added, allowMissingColumns=True).groupBy("a", "b").agg(
        F.sum("n_common").alias("n_common"), F.sum("sxy").alias("sxy"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return whole.select(*kept).unionByName(more)
