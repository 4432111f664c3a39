"""Fixed virtual slots: records are hashed into slots, and a versioned map says which shard has a slot.

Only the map decides placement. It is built from the bytes of each slot, and rebalancing edits
the map: a new version differs from the last in the slots it moves, and nothing else moves.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tastegrid.llm.common import draw
from tastegrid.session import stage

#: Slots of a map. The map has one row per slot, so this bounds what the driver and a broadcast hold.
SLOTS = 8192
#: Bytes that a record needs besides its text.
RECORD_BYTES = 16


def records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, vslot) of every row; other columns are left out.

    A null text has no bytes (crc32 of nothing: 0). Id and text checksum choose the slot, so rows
    that share an id but not the text (or have none) spread; rows equal in both share a slot.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    out = df.select(
        F.col(id_col), (F.octet_length(raw) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"))
    return out.withColumn("vslot", (draw(id_col, "text_crc32") % n_slots).cast("int"))


def slot_sizes(recs: DataFrame) -> DataFrame:
    return recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def balanced_map(sizes: dict[int, int], n_shards: int) -> dict[int, int]:
    """slot -> shard: the largest slots first, each to the shard with the fewest bytes so far.

    Ties go to the smaller slot and the smaller shard.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for slot in sorted(sizes, key=lambda v: (-sizes[v], v)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes[slot], shard))
    return out


def rebalanced_map(current: dict[int, int], sizes: dict[int, int], n_shards: int) -> dict[int, int]:
    """The next version of a map for ``n_shards`` shards, moving slots only to lower the largest load.

    Slots of shards that no longer exist are placed first. Then, as long as that helps, the largest
    slot that fits the gap goes from the fullest shard to the emptiest.
    """
    out = {v: s for v, s in current.items() if s < n_shards}
    load = [0] * n_shards
    for v, s in out.items():
        load[s] += sizes.get(v, 0)
    for v in sorted(set(sizes) - set(out), key=lambda v: (-sizes[v], v)):
        out[v] = s = min(range(n_shards), key=lambda i: (load[i], i))
        load[s] += sizes[v]
    while True:
        full = max(range(n_shards), key=lambda i: (load[i], -i))
        empty = min(range(n_shards), key=lambda i: (load[i], i))
        gap = load[full] - load[empty]
        fits = [v for v, s in out.items() if s == full and 0 < 2 * sizes.get(v, 0) <= gap]
        if not fits:
            return out
        move = max(fits, key=lambda v: (sizes[v], -v))
        out[move] = empty
        load[full] -= sizes[move]
        load[empty] += sizes[move]


def assign(recs: DataFrame, n_shards: int, version: int = 1,
           current: dict[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Shards of records from :func:`records`, and the slot map that decided them.

    Returns (rows with ``shard`` and ``position``, map with version, vslot, shard, bytes, n, first).
    ``position`` counts the rows of a shard from 0 without gaps: slot after slot, by id and checksum
    within a slot. Both are empty for an empty table. ``current`` is an earlier map to be edited.
    """
    spark = recs.sparkSession
    found = slot_sizes(recs).collect()  # one row per slot, at most SLOTS
    sizes = {r["vslot"]: r["bytes"] for r in found}
    placed = balanced_map(sizes, n_shards) if current is None else rebalanced_map(current, sizes, n_shards)
    first, rows = [0] * n_shards, []
    for r in sorted(found, key=lambda r: r["vslot"]):
        shard = placed[r["vslot"]]
        rows.append((version, r["vslot"], shard, r["bytes"], r["n"], first[shard]))
        first[shard] += r["n"]
    slots = stage(spark.createDataFrame(
        rows, "version int, vslot int, shard int, bytes long, n long, first long").coalesce(1), "slot-map")
    order = Window.partitionBy("vslot").orderBy(*[c for c in recs.columns if c != "vslot"])
    out = (
        recs.withColumn("_rank", F.row_number().over(order))
        .join(F.broadcast(slots.select("vslot", "shard", "first")), "vslot")
        .withColumn("position", F.col("first") + F.col("_rank") - 1)
        .drop("_rank", "first")
    )
    return out, slots


def op5_sharding(spark, folder: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes (law ``bytes``)."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    placed, _ = assign(stage(records(docs), "records"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
