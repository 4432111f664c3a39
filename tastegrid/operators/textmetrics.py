"""BLEU and ROUGE of text pairs ``(pair_id, reference, output)``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tastegrid.functions import text as X

DIGITS = 6
SHORT_REFERENCE = 5      # below this many tokens zero counts are smoothed
SMOOTHING = 0.1
BLEU_WEIGHTS = {         # fixed weights per order
    1: (1.0,),
    2: (0.5, 0.5),
    3: (0.33, 0.33, 0.33),
    4: (0.25, 0.25, 0.25, 0.25),
}


def gram_overlap(
    pairs: DataFrame, key: str, reference: str, output: str, orders: tuple[int, ...]
) -> DataFrame:
    """Per (pair, n): matched, output and reference n-gram counts, as multisets and sets.

    N-grams become rows and are counted with map-side combine, so a long text is spread
    over tasks instead of being compared inside one row.
    """
    sides = pairs.select(
        key, F.explode(F.array(
            F.struct(F.lit(1).alias("ref"), F.col(reference).alias("t")),
            F.struct(F.lit(0).alias("ref"), F.col(output).alias("t")),
        )).alias("s"),
    ).select(key, "s.ref", X.tokens(F.col("s.t")).alias("words"))
    grams = sides.select(
        key, "ref", F.explode(F.array(*[
            F.struct(F.lit(n).alias("n"), X.ngrams(F.col("words"), n).alias("grams")) for n in orders
        ])).alias("o"),
    ).select(key, "ref", "o.n", F.explode("o.grams").alias("gram"))
    counts = grams.groupBy(key, "n", "gram").agg(
        F.sum("ref").alias("in_ref"), F.sum(1 - F.col("ref")).alias("in_out")
    )
    both = (F.col("in_ref") > 0) & (F.col("in_out") > 0)
    return counts.groupBy(key, "n").agg(
        F.sum(F.least("in_ref", "in_out")).alias("matched"),
        F.sum("in_out").alias("out_total"), F.sum("in_ref").alias("ref_total"),
        F.count_if(both).alias("matched_set"),
        F.count_if(F.col("in_out") > 0).alias("out_set"), F.count_if(F.col("in_ref") > 0).alias("ref_set"),
    )


def bleu(pairs: DataFrame, key: str, reference: str, output: str) -> DataFrame:
    """BLEU-1 to BLEU-4 per pair; zero counts are smoothed for short references only."""
    grams = gram_overlap(pairs, key, reference, output, (1, 2, 3, 4))
    wide = grams.groupBy(key).agg(
        *[F.max(F.when(F.col("n") == n, F.col("matched"))).alias(f"m{n}") for n in BLEU_WEIGHTS],
        *[F.max(F.when(F.col("n") == n, F.col("out_total"))).alias(f"c{n}") for n in BLEU_WEIGHTS],
    )
    lengths = pairs.select(
        key, F.size(X.tokens(F.col(reference))).alias("ref_len"),
        F.size(X.tokens(F.col(output))).alias("out_len"),
    )
    rows = lengths.join(wide, key, "left")
    small = F.col("ref_len") < SHORT_REFERENCE
    brevity = F.when(F.col("out_len") == 0, 0.0).when(
        F.col("out_len") > F.col("ref_len"), 1.0
    ).otherwise(F.exp(1 - F.col("ref_len") / F.col("out_len")))

    def log_precision(n: int) -> Column:
        matched = F.coalesce(F.col(f"m{n}"), F.lit(0))
        total = F.greatest(F.coalesce(F.col(f"c{n}"), F.lit(0)), F.lit(1))
        value = F.when(matched > 0, matched / total).when(small, SMOOTHING / total)
        return F.ln(value)  # null when there is no match to take a logarithm of

    def score(weights: tuple[float, ...]) -> Column:
        logs = sum((w * log_precision(n + 1) for n, w in enumerate(weights)), F.lit(0.0))
        matched1 = F.coalesce(F.col("m1"), F.lit(0))
        return F.round(F.when(matched1 == 0, 0.0).otherwise(
            F.coalesce(brevity * F.exp(logs), F.lit(0.0))
        ), DIGITS)

    return rows.select(key, *[score(w).alias(f"bleu_{n}") for n, w in BLEU_WEIGHTS.items()])


def _prf(matched: Column, ref: Column, out: Column) -> tuple[Column, Column, Column]:
    r = F.coalesce(matched / F.nullif(ref, F.lit(0)), F.lit(0.0))
    p = F.coalesce(matched / F.nullif(out, F.lit(0)), F.lit(0.0))
    f = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return r, p, f


def rouge_n(
    pairs: DataFrame, key: str, reference: str, output: str,
    orders: tuple[int, ...] = (1, 2), unique: bool = True,
) -> DataFrame:
    """Recall, precision and F of n-gram overlap; distinct n-grams by default."""
    grams = gram_overlap(pairs, key, reference, output, orders)
    names = ("matched_set", "ref_set", "out_set") if unique else ("matched", "ref_total", "out_total")
    r, p, f = _prf(*[F.col(c) for c in names])
    return grams.select(
        key, "n", F.round(r, DIGITS).alias("recall"), F.round(p, DIGITS).alias("precision"),
        F.round(f, DIGITS).alias("f1"),
    )


def _common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit per token of ``a``."""
    where: dict[str, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        hit = row & where.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_common_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def rouge_l(pairs: DataFrame, key: str, reference: str, output: str) -> DataFrame:
    """Recall, precision and F of the longest common subsequence over whole texts."""
    words = pairs.select(
        key, X.tokens(F.col(reference)).alias("r"), X.tokens(F.col(output)).alias("o")
    ).withColumn("lcs", common_subsequence("r", "o"))
    r, p, f = _prf(F.col("lcs"), F.size("r"), F.size("o"))
    return words.select(
        key, "lcs", F.round(r, DIGITS).alias("recall"), F.round(p, DIGITS).alias("precision"),
        F.round(f, DIGITS).alias("f1"),
    )
