"""Deterministic stand-ins for random draws: everything is ranked by an md5 of its key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tastegrid.constants import SEED


def md5_key(*parts: str | Column, seed: int = SEED) -> Column:
    """md5 of ``seed|part|part...``; uniform, partition-independent, reproducible in SQL."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def md5_int(digest: Column) -> Column:
    """First 28 bits of a hex digest as a bigint."""
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint")


def md5_unit(digest: Column) -> Column:
    """A digest as a number in [0, 1)."""
    return md5_int(digest) / F.lit(float(16**7))
