"""Mixing sources to target weights: token blocks drawn per output shard.

The words of a source's documents, in a fixed order, are one stream that is cut into blocks of equal
length. The mix is a list of slots, dealt over output shards; every slot names a source and an
index of that source. The counts of a shard's sources are a multinomial draw under the condition that
each source has as many slots over all shards as its target asks for: slot numbers go through a
pseudorandom permutation of all slots, and each source owns a range of the permuted numbers. The place
within that range goes through the source's own permutation of its blocks, once per pass over them,
and slots meet blocks by (source, index). Everything follows from ids and the seed: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tastegrid.llm.common import GAP, draw, keep, n_words

BLOCK_WORDS = 128
SHARD_SLOTS = 1024
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Parts that a source's documents are dealt into, so that running sums are not one task per source.
PARTS = 4096
#: Rounds of the permutation.
ROUNDS = 32
SEED = 7
#: Slots that one row stands for before it is spread out.
CHUNK = 1 << 13
#: Tasks that make slots, at most.
MOST_TASKS = 10_000


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Targets from (source, source_size): weight, target, one row per source.

    ``share`` times all sizes is divided by weight; a target stops at ``cap`` times its source's size
    and the excess goes to the others by weight until none is above. With sources in order of
    size / weight those that stop come first and the level falls after them, so one pass over running
    sums finds it.
    The windows run over one row per source. Null is a source of its own, last in order.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("_rank", rank).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1)))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        share * F.sum("source_size").over(whole)
        - F.coalesce(cap * F.sum("source_size").over(before), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    return (
        weighed.withColumn("_level", level)
        .withColumn("_stops", F.col("_level") * F.col("weight") >= cap * F.col("source_size"))
        .withColumn("_level", F.max(F.when(~F.col("_stops"), F.col("_level"))).over(whole))
        .withColumn("target", F.when(F.col("_stops"), cap * F.col("source_size"))
                    .otherwise(F.col("_level") * F.col("weight")).cast("double"))
        .select("source", "source_size", "weight", "target", F.col("_rank").alias("source_no"))
    )


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """``index`` in [0, n) through a pseudorandom permutation of [0, n) that the key chooses.

    Each round pairs x with (k - x) mod n, a pairing of the whole range, and swaps the pair or not by
    one hashed bit of its larger member; so every round, and the whole, is a permutation for any n.
    """
    def swap_or_not(x: Column, r: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, y), r, *key).bitwiseAND(F.lit(1)) == 1, y).otherwise(x)

    rounds = F.array(*[F.lit(r).cast("long") for r in range(ROUNDS)])
    return F.aggregate(rounds, index.cast("long"), swap_or_not)


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source") -> DataFrame:
    """(id, source, size, crc) of every document; size counts words, a null text has none."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"))


def plan(recs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS,
         block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of documents from :func:`records`: (documents in their streams, slots).

    Documents: the records with source_size, target, source_no, n_blocks and the half-open range
    [first, last) of their words in the stream of their source. Slots: shard, slot, source_no, pass,
    block, with every block of a source at most ``cap`` times, rounded up to whole passes over its
    blocks. A source without words has no blocks, no slots and target 0. Both are empty for an
    empty table.
    """
    spark = recs.sparkSession
    sizes = recs.groupBy("source").agg(F.sum("size").alias("source_size"))
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    asked = F.when(F.col("source_size") > 0, F.round(blocks * F.col("target") / F.col("source_size"))).otherwise(0)
    sources = keep(
        targets(sizes, share, cap, weights)
        .withColumn("n_blocks", blocks).withColumn("n_slots", asked.cast("long"))
        .withColumn("first_slot", F.coalesce(F.sum("n_slots").over(
            Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .coalesce(1), "mix-sources")  # one row per source
    n_slots = sources.agg(F.sum("n_slots")).first()[0] or 0

    placed = keep(
        recs.join(sources.select(F.col("source").alias("_s"), "source_no", "source_size", "target", "n_blocks"),
                  F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        .withColumn("part", (draw("id", "crc") % PARTS).cast("int")), "mix-records")
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("source_no", "part").agg(F.sum("size").alias("n")).withColumn(
        "part_first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("source_no", "part").orderBy("id", "crc", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    stream = (
        placed.withColumn("last", F.sum("size").over(inside))
        .join(parts, ["source_no", "part"])
        .withColumn("last", F.col("last") + F.col("part_first"))
        .withColumn("first", F.col("last") - F.col("size"))
        .drop("part", "part_first")
    )

    chunks = (
        sources.filter("n_slots > 0")
        .select("source_no", "n_slots", "n_blocks", "first_slot",
                F.explode(F.expr(f"sequence(0L, (n_slots - 1) div {CHUNK}L)")).alias("chunk"))
    )
    # a number of its own, or small chunk rows would be put into one task that makes all slots
    chunks = chunks.repartition(max(1, min(MOST_TASKS, -(-n_slots // CHUNK))), "source_no", "chunk")
    numbers = F.expr(f"sequence(chunk * {CHUNK}L, least(n_slots, (chunk + 1) * {CHUNK}L) - 1)")
    key = F.lit(seed).cast("long")
    slots = (
        chunks.select("source_no", "n_blocks", "first_slot", F.explode(numbers).alias("q"))
        .withColumn("slot", permuted(F.col("first_slot") + F.col("q"), F.lit(n_slots).cast("long"), key))
        .withColumn("pass", F.expr("q div n_blocks"))
        .withColumn("block", permuted(
            F.expr("q % n_blocks"), F.col("n_blocks"), key, F.col("source_no").cast("long"), F.col("pass")))
        .select(F.expr(f"cast(slot div {SHARD_SLOTS} as int)").alias("shard"), "slot", "source_no", "pass", "block")
    )
    return stream, keep(slots, "mix-slots")  # written, so that its size is known where it is joined


def block_words_of(stream: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per (document, block it has words in): the stream's columns, block, n (words in it).

    Documents without words have one row with a null block.
    """
    numbers = F.when(F.col("size") > 0, F.expr(
        f"sequence(first div {block_words}L, (last - 1) div {block_words}L)"))
    out = stream.withColumn("block", F.explode_outer(numbers))
    lo = F.greatest(F.col("first"), F.col("block") * block_words)
    hi = F.least(F.col("last"), (F.col("block") + 1) * block_words)
    return out.withColumn("n", F.coalesce(hi - lo, F.lit(0)))


def taken_words(stream: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document with ``taken``: its words in all slots of the mix, repeats counted."""
    uses = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses"))
    return (
        block_words_of(stream, block_words).join(uses, ["source_no", "block"], "left")
        .groupBy("source_no", "first", "id", "crc", "size", "source_size", "target")
        .agg(F.sum(F.col("n") * F.coalesce("uses", F.lit(0))).cast("long").alias("taken"),
             F.count(F.lit(1)).alias("_rows"),
             F.max(F.col("block").isNull()).alias("_blank"))
        # blank documents that share all of these are one group: give each its row back
        .withColumn("_copy", F.explode(F.when(F.col("_blank"), F.expr("sequence(1L, _rows)")).otherwise(F.array(F.lit(1).cast("long")))))
        .drop("_rows", "_blank", "_copy")
    )


def mixed_documents(docs: DataFrame, stream: DataFrame, slots: DataFrame,
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: a row per document and pass, with the text of the blocks that pass took.

    ``docs`` has doc_id, text, lang, source, n_chars; so has the result, with n_chars counted anew.
    A text that is taken whole stays as it is; of others the words taken stay, in order, each with the
    white space behind it. Documents of which nothing is taken have no row. Rows equal in id, source,
    words and checksum are copies: each gets the plan of the first.
    """
    keys = ["id", "source", "size", "crc"]
    taken = (
        block_words_of(stream.filter("size > 0"), block_words)
        .join(slots.select("source_no", "pass", "block"), ["source_no", "block"])
        .groupBy(*keys, "first", "pass")
        .agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("block")).alias("blocks"))
        .groupBy(*keys)
        .agg(F.min_by(F.struct("first", F.col("pass"), "n", "blocks"), F.struct("first", "pass")).alias("one"),
             F.sort_array(F.collect_list(F.struct("first", F.col("pass"), "n", "blocks"))).alias("passes"))
        .withColumn("passes", F.filter("passes", lambda p: p["first"] == F.col("one")["first"]))
        .select(*keys, F.explode("passes").alias("p"))
    )
    mine = docs.select("doc_id", "text", "lang", F.col("source").alias("_source"), F.crc32(
        F.coalesce("text", F.lit("")).cast("binary")).alias("_crc"))
    joined = mine.join(
        taken, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("_source").eqNullSafe(F.col("source"))
        & (F.col("_crc") == F.col("crc")))
    # a word and the white space behind it; the white space before the first word stays with it
    tokens = F.regexp_extract_all("text", F.lit(rf"(?:^{GAP})?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    slices = F.transform(F.col("p.blocks"), lambda b: F.slice(
        "_tokens", (F.greatest(b * block_words - F.col("p.first"), F.lit(0)) + 1).cast("int"),
        (F.least((b + 1) * block_words, F.col("p.first") + F.col("size"))
         - F.greatest(b * block_words, F.col("p.first"))).cast("int")))
    cut = F.array_join(F.flatten(slices), "")
    return (
        joined.withColumn("_tokens", F.when(F.col("p.n") < F.col("size"), tokens))
        .withColumn("text", F.when(F.col("p.n") < F.col("size"), cut).otherwise(F.col("text")))
        .select("doc_id", "text", "lang", F.col("_source").alias("source"),
                F.length("text").cast("long").alias("n_chars"))
    )


def op2_mixing(spark, folder: str) -> DataFrame:
    """The default mix of all documents: what it takes of each."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stream, slots = plan(keep(records(docs), "mix-sizes"))
    return taken_words(stream, slots).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
