"""Ranking that never needs a whole unbounded group in one task.

* ``top_k`` – small k per group; Spark trims each map partition to k rows first.
* ``range_ranks`` – each row's place in its group, from ranges of the sorted table.
* ``first_rows`` – "the first n rows in this order" as a filter with literal cut
  values, found by successively finer histograms; the data itself is not shuffled.
* ``row_index`` – a global row number from a 65,536-cell histogram.
* ``exact_quantiles`` – order statistics of doubles, digit by digit from counts.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, LongType

from tastegrid.session import stage

CELL_ROWS = 1_000_000
PREFIX_HEX = 4  # 16**4 = 65,536 cells
DIGIT_BITS = 16


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """First k rows per key. ``order`` must end in a unique column."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def range_ranks(df: DataFrame, keys: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """Adds ``_rank`` (from 1, by ``order``) and ``_rows`` of each row's group.

    The table is cut into ranges of (keys, order) and written; a group's ranges are counted, and
    a row's rank is the count of its group's earlier ranges plus its place in its own. A group
    may have any number of rows: what is sorted together is a group's part of one range.
    ``order`` must be total but for equal rows.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order)))
    by = [*[F.col(k) for k in keys], *[F.col(n) for n in names]]
    ranged = keyed.repartitionByRange(parts, *by) if parts else keyed.repartitionByRange(*by)
    # a place in the sorted range is all that is kept of the order
    sorted_ = ranged.sortWithinPartitions(*by).select(
        *df.columns, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at"))
    placed = stage(sorted_, "ranges")
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    group = W.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(  # a row per group and range that it lies in
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"), F.sum("_n").over(group).alias("_rows"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    ranked = placed.join(offsets, same & (F.col("_range") == F.col("_r")))
    return ranked.withColumn("_rank", F.col("_at") + F.col("_shift")).select(*df.columns, "_rank", "_rows")


def _before(names: list[str], values: list) -> Column:
    """Lexicographic ``(names) <= (values)`` against literals."""
    pairs = [(F.col(n), F.lit(v)) for n, v in zip(names, values)]
    parts = []
    for i, (c, v) in enumerate(pairs):
        same = [pc == pv for pc, pv in pairs[:i]]
        last = c <= v if i == len(pairs) - 1 else c < v
        parts.append(reduce(lambda x, y: x & y, [*same, last]))
    return reduce(lambda x, y: x | y, parts)


def first_rows(
    df: DataFrame,
    levels: dict[str, Column],
    n: int,
    cell_rows: int = CELL_ROWS,
) -> tuple[DataFrame, Column]:
    """Return ``df`` with the level columns added, and the predicate "among the first n".

    ``levels`` go from coarse to fine and together give a total order; each level
    refines the one before, and each histogram runs only over the rows that tie on
    the coarser levels. The driver receives one boundary row per level.
    """
    leveled = df.withColumns(levels)
    names = list(levels)
    if n <= 0:
        return leveled, F.lit(False)
    cell, remaining, bound = leveled.select(*names), n, []
    for i, name in enumerate(names[:-1]):
        hist = cell.groupBy(name).agg(F.count(F.lit(1)).alias("c"))
        cum = hist.withColumn("cum", F.sum("c").over(W.orderBy(name)))
        row = cum.filter(F.col("cum") >= remaining).orderBy(name).first()
        if row is None:  # n covers every row
            return leveled, F.lit(True)
        remaining -= row["cum"] - row["c"]
        bound.append(row[name])
        cell = cell.filter(F.col(name) == F.lit(row[name]))
        if row["c"] <= cell_rows:
            break
    rest = names[len(bound):]
    ranked = cell.withColumn("rn", F.row_number().over(W.orderBy(*rest)))
    row = ranked.filter(F.col("rn") == remaining).first()
    if row is None:
        return leveled, F.lit(True)
    return leveled, _before(names, bound + [row[r] for r in rest])


def md5_levels(digest: Column, prefix: str = "_h") -> dict[str, Column]:
    """Levels for an order given by an md5 digest: 4 hex digits, 8 hex digits, all."""
    return {
        f"{prefix}4": F.substring(digest, 1, 4),
        f"{prefix}8": F.substring(digest, 1, 8),
        prefix: digest,
    }


def time_levels(ts: str, digest: Column) -> dict[str, Column]:
    """Levels for an order by time, ties by digest."""
    return {
        "_day": F.to_date(ts),
        "_minute": F.date_trunc("minute", F.col(ts)),
        "_ts": F.col(ts),
        **md5_levels(digest),
    }


def double_levels(value: Column, prefix: str = "_d") -> dict[str, Column]:
    """Levels for an order by a double: its bits, 16 at a time, so that each histogram is bounded."""
    bits = ordered_bits(value.cast("double"))
    return {f"{prefix}{64 - shift}": F.shiftright(bits, shift) if shift else bits
            for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS)}


def row_index(df: DataFrame, digest: Column, name: str = "row_idx") -> DataFrame:
    """0-based global row number in digest order.

    A histogram over the first hex digits (at most 65,536 rows, so broadcastable)
    gives each cell's offset; rows are then numbered inside their cell.
    """
    keyed = df.withColumn("_digest", digest).withColumn(
        "_cell", F.substring("_digest", 1, PREFIX_HEX)
    )
    hist = keyed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_c"))
    offsets = hist.select(
        "_cell", (F.sum("_c").over(W.orderBy("_cell")) - F.col("_c")).alias("_offset")
    )
    inside = W.partitionBy("_cell").orderBy("_digest")
    return (
        keyed.join(F.broadcast(offsets), "_cell")
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_digest", "_cell", "_offset")
    )


@F.pandas_udf(LongType())
def ordered_bits(values: pd.Series) -> pd.Series:
    """The 64 bits of a double as a whole number of the same order; both zeros are one."""
    bits = (values.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


@F.pandas_udf(DoubleType())
def from_ordered_bits(values: pd.Series) -> pd.Series:
    bits = values.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64))


def exact_quantiles(df: DataFrame, key: str, value: str, marks: list[float]) -> DataFrame:
    """(key, n, quantiles): per key the interpolated quantiles of a double, one for each of ``marks``.

    Ranks are found by radix selection: values are counted by their 16 highest bits, which tells
    the cell of each rank, then the rows of these cells by the next 16, and so on. All keys and
    marks go down together; a key and cell never has more than 65,536 counts, and no values are
    sorted or held. Null values do not count; a key with nulls only has no row.
    """
    rows = stage(df.filter(F.col(value).isNotNull()).select(
        F.col(key).alias("_k"), ordered_bits(F.col(value).cast("double")).alias("bits")), "bits")
    sizes = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
    at = (F.col("n") - 1) * F.col("q")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(marks)])
    wanted = sizes.select("_k", "n", F.inline(wanted))
    ends = F.array(F.floor(at).cast("bigint"), F.ceil(at).cast("bigint"))
    open_ = wanted.select("_k", F.explode(ends).alias("rank")).distinct().withColumns({
        "left": F.col("rank"), "prefix": F.lit(0).cast("bigint")})
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftright("bits", shift)  # keeps the sign, so the first digits are in order too
        first = shift == 64 - DIGIT_BITS
        above = F.lit(0).cast("bigint") if first else F.shiftright("bits", shift + DIGIT_BITS)
        own = open_.select(F.col("_k").alias("_o"), F.col("prefix").alias("_p")).distinct()
        cell = rows.join(own, F.col("_k").eqNullSafe(F.col("_o")) & (above == F.col("_p"))).groupBy(
            "_o", "_p", digit.alias("digit")).agg(F.count(F.lit(1)).alias("c"))
        upto = W.partitionBy("_o", "_p").orderBy("digit").rowsBetween(W.unboundedPreceding, 0)
        cum = cell.withColumn("cum", F.sum("c").over(upto))
        hit = (F.col("left") < F.col("cum")) & (F.col("left") >= F.col("cum") - F.col("c"))
        open_ = stage(open_.join(cum, F.col("_k").eqNullSafe(F.col("_o")) & (F.col("prefix") == F.col("_p")) & hit).select(
            "_k", "rank", (F.col("left") - F.col("cum") + F.col("c")).alias("left"), F.col("digit").alias("prefix")), "digits")
    found = open_.select(F.col("_k").alias("_o"), "rank", from_ordered_bits("prefix").alias("v"))
    low = found.select(F.col("_o").alias("_lo"), F.col("rank").alias("_rl"), F.col("v").alias("vl"))
    high = found.select(F.col("_o").alias("_hi"), F.col("rank").alias("_rh"), F.col("v").alias("vh"))
    both = wanted.join(low, F.col("_k").eqNullSafe(F.col("_lo")) & (F.floor(at) == F.col("_rl"))).join(
        high, F.col("_k").eqNullSafe(F.col("_hi")) & (F.ceil(at) == F.col("_rh")))
    between = F.when(F.col("_rl") == F.col("_rh"), F.col("vl")).otherwise(
        F.col("vl") + (F.col("vh") - F.col("vl")) * (at - F.floor(at)))
    return both.groupBy(F.col("_k").alias(key), "n").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("i", between.alias("v")))), lambda x: x["v"]).alias("quantiles"))
