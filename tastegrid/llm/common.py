"""Column expressions and table helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.session import stage

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    """The words of a text, in order; null and blank texts have none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(col, F.lit("")), GAP), lambda w: w != "")


def n_words(text: str | Column) -> Column:
    return F.size(words(text)).cast("long")


def draw(*parts: Column | str) -> Column:
    """A non-negative 60-bit number that depends on the given values alone (null counts as a value)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def keep(df: DataFrame, name: str) -> DataFrame:
    """:func:`tastegrid.session.stage` under the name that the operators here use."""
    return stage(df, name)


#: Most values of :func:`spot`; a broadcast of spots has that many rows at most.
SPOTS = 1 << 20


def spot(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SPOTS)).cast("int")


def parted(rows: DataFrame, ids: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """(rows that certainly have none of the ids, rows that may have one), without a shuffle of ``rows``.

    Both tables have ``cols``. Rows are told apart by a hash of fixed range, so what is broadcast is bounded;
    with very many ids most rows are in the second part, which is then joined as usual.
    """
    some = F.broadcast(ids.select(spot(*cols).alias("_spot")).distinct())
    marked = rows.withColumn("_spot", spot(*cols))
    return marked.join(some, "_spot", "left_anti").drop("_spot"), marked.join(some, "_spot", "left_semi").drop("_spot")


def bit_filter(keys: DataFrame, key: str, n_bits: int) -> np.ndarray:
    """A packed bit array: bit ``pmod(key, n_bits)`` is set for every key (long). n_bits is a multiple of 2^18."""
    at = F.pmod(key, F.lit(n_bits)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # n_bits in all
    seen = np.zeros(n_bits // 8, np.uint8)
    for r in maps:
        part = np.frombuffer(r["bits"], np.uint8)
        lo = (r["k"] - 1) * len(part)
        seen[lo:lo + len(part)] = part
    return seen


def has_bit(seen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (len(seen) * 8 - 1)  # n_bits is a power of two, so this is pmod
    return (seen[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
