"""Scoring of predictions: errors, intervals, ranking metrics, class reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.constants import BOOTSTRAP_RESAMPLES, CONFIDENCE_Z, SEED
from tastegrid.functions.hashing import md5_int, md5_key
from tastegrid.functions.parsing import failed, numeric
from tastegrid.roles import Roles
from tastegrid.session import stage

DEFAULT = Roles()
DIGITS = 6
EXACT_MEAN = 64  # of a Poisson number


def _error(actual: str, predicted: str) -> Column:
    return F.col(actual) - F.col(predicted)


def numeric_predictions(df: DataFrame, predicted: str = "predicted_rating") -> DataFrame:
    """Rows with a usable prediction, as the double ``predicted_value``."""
    return df.filter(~failed(F.col(predicted))).withColumn(
        "predicted_value", numeric(F.col(predicted))
    )


def positive_predictions(df: DataFrame, predicted: str = "predicted_value") -> DataFrame:
    return df.filter(F.col(predicted) > 0)


def rmse_mae(df: DataFrame, actual: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """RMSE and MAE over rows with a prediction, and how many have none."""
    e = _error(actual, predicted)
    return df.groupBy(*by).agg(
        F.count(e).alias("n"),
        F.count_if(F.col(predicted).isNull()).alias("n_failed"),
        F.round(F.sqrt(F.avg(e * e)), DIGITS).alias("rmse"),
        F.round(F.avg(F.abs(e)), DIGITS).alias("mae"),
    )


def confidence_interval(
    df: DataFrame, actual: str, predicted: str, z: float = CONFIDENCE_Z, by: list[str] = ()
) -> DataFrame:
    """Mean ± z standard errors of the squared and the absolute error; the bounds of the
    squared error are also given on the RMSE scale."""
    e = _error(actual, predicted)

    def moments(name: str, x: Column) -> list[Column]:
        return [
            F.avg(x).alias(f"_m_{name}"),
            (F.stddev_samp(x) / F.sqrt(F.count(x))).alias(f"_s_{name}"),
        ]

    stats = df.groupBy(*by).agg(F.count(e).alias("n"), *moments("se", e * e), *moments("ae", F.abs(e)))
    mse, s_se, mae, s_ae = (F.col(c) for c in ("_m_se", "_s_se", "_m_ae", "_s_ae"))
    return stats.select(
        *by, "n",
        F.round(F.sqrt(mse), DIGITS).alias("rmse"),
        F.round(F.sqrt(F.greatest(mse - z * s_se, F.lit(0.0))), DIGITS).alias("rmse_low"),
        F.round(F.sqrt(mse + z * s_se), DIGITS).alias("rmse_high"),
        F.round(s_se, DIGITS).alias("stderr_se"),
        F.round(mae, DIGITS).alias("mae"),
        F.round(mae - z * s_ae, DIGITS).alias("mae_low"),
        F.round(mae + z * s_ae, DIGITS).alias("mae_high"),
        F.round(s_ae, DIGITS).alias("stderr_ae"),
    )


def poisson_cdf(mean: int) -> list[float]:
    """P(X <= k) for k = 0, 1, ... up to where it no longer grows."""
    out, total = [], 0.0
    for k in range(mean + 12 * math.isqrt(mean) + 30):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        out.append(total)
    return out


def poisson_draw(mean: Column, cdf: Column, digest: Column) -> Column:
    """A Poisson number with a whole mean, drawn by an md5 digest.

    Up to EXACT_MEAN the inverse of the distribution function ``cdf``; above it a normal number
    with the first term for the skew, whose error is far below one there.
    """
    unit = (md5_int(digest) + 0.5) / float(16**7)
    other = (md5_int(F.substring(digest, 8, 7)) + 0.5) / float(16**7)
    small = F.size(F.filter(cdf, lambda x: x <= unit))
    z = F.sqrt(-2 * F.ln(unit)) * F.cos(2 * math.pi * other)
    large = F.floor(mean + F.sqrt(mean) * z + (z * z - 1) / 6 + 0.5)
    return F.when(mean <= EXACT_MEAN, small.cast("bigint")).otherwise(F.greatest(large, F.lit(0).cast("bigint")))


def bootstrap_interval(
    df: DataFrame, actual: str, predicted: str, resamples: int = BOOTSTRAP_RESAMPLES, seed: int = SEED,
) -> DataFrame:
    """Percentile bootstrap of RMSE and MAE.

    A resample takes each row a Poisson(1) number of times. Rows with the same actual and
    predicted value are one cell, and f of them are taken Poisson(f) times together, so the work
    is cells x resamples. Draws depend on the resample and the cell's values (to six digits).
    """
    e = _error(actual, predicted)
    six = lambda c: F.round(F.col(c).cast("double") * 1e6).cast("bigint")
    cells = df.filter(e.isNotNull()).groupBy(six(actual).alias("_a"), six(predicted).alias("_p")).agg(
        F.count(F.lit(1)).alias("f"), F.avg(e * e).alias("se"), F.avg(F.abs(e)).alias("ae"))
    tables = df.sparkSession.createDataFrame(
        [(m, poisson_cdf(m)) for m in range(1, EXACT_MEAN + 1)], "f bigint, cdf array<double>")
    reps = stage(cells, "cells").join(F.broadcast(tables), "f", "left").withColumn(
        "rep", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    drawn = reps.withColumn("m", poisson_draw(F.col("f"), F.col("cdf"), md5_key("rep", "_a", "_p", seed=seed)))
    n = F.sum("m")
    replicates = drawn.groupBy("rep").agg(
        F.sqrt(F.sum(F.col("m") * F.col("se")) / F.nullif(n, F.lit(0))).alias("rmse"),
        (F.sum(F.col("m") * F.col("ae")) / F.nullif(n, F.lit(0))).alias("mae"),
    )
    ends = F.array(F.lit(0.025), F.lit(0.975))
    out = replicates.agg(
        F.count(F.lit(1)).alias("n_resamples"),
        F.percentile("rmse", ends).alias("r"), F.percentile("mae", ends).alias("m"),
    )
    return out.select(
        "n_resamples",
        F.round(F.col("r")[0], DIGITS).alias("rmse_low"), F.round(F.col("r")[1], DIGITS).alias("rmse_high"),
        F.round(F.col("m")[0], DIGITS).alias("mae_low"), F.round(F.col("m")[1], DIGITS).alias("mae_high"),
    )


def average_over_runs(df: DataFrame, actual: str, predicted: str, run: str = "run_id") -> DataFrame:
    """Mean of the per-run metrics, all runs in one job."""
    return rmse_mae(df, actual, predicted, [run]).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.round(F.avg("rmse"), DIGITS).alias("avg_rmse"),
        F.round(F.avg("mae"), DIGITS).alias("avg_mae"),
    )


def hit_and_gain(position: Column, k: int) -> tuple[Column, Column]:
    """HR@k and NDCG@k of a single relevant item at a 1-based position (null = absent)."""
    within = position.isNotNull() & (position <= k)
    hit = F.when(within, 1.0).otherwise(0.0)
    gain = F.when(within, 1.0 / F.log2(position + 1)).otherwise(0.0)
    return hit, gain


def hr_ndcg(positions: DataFrame, position: str = "position", ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Mean HR@k and NDCG@k over one row per user with the position of the held-out item."""
    cols = [F.count(F.lit(1)).alias("n_users")]
    for k in ks:
        hit, gain = hit_and_gain(F.col(position), k)
        cols += [
            F.round(F.avg(hit), DIGITS).alias(f"hr_{k}"),
            F.round(F.avg(gain), DIGITS).alias(f"ndcg_{k}"),
        ]
    return positions.agg(*cols)


def list_position(recommended: Column, truth: Column) -> Column:
    """Position of ``truth`` in a recommended array, null when absent."""
    return F.nullif(F.array_position(recommended, truth), F.lit(0))


def candidate_positions(
    scored: DataFrame, user: str, item: str, score: str, label: str
) -> DataFrame:
    """Rank of each user's positive among its candidates (score descending, ties by
    item, unscored last), by counting the candidates ahead of it."""
    value = F.coalesce(F.col(score), F.lit(float("-inf")))
    best = scored.filter(F.col(label) == 1).select(
        user, F.col(item).alias("_pos"), value.alias("_ps")
    )
    rows = scored.filter(F.col(label) == 0).select(
        user, F.col(item).alias("_neg"), value.alias("_ns")
    ).distinct()
    ahead = (F.col("_ns") > F.col("_ps")) | (
        (F.col("_ns") == F.col("_ps")) & (F.col("_neg") < F.col("_pos"))
    )
    return best.join(rows, user, "left").groupBy(user, "_pos").agg(
        (F.count_if(ahead) + 1).alias("position")
    ).withColumnRenamed("_pos", item)


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class from the confusion counts."""
    cells = df.groupBy(F.col(label).alias("t"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("c")
    )
    sides = cells.select(
        F.explode(F.array(
            F.struct(F.col("t").alias("class"), F.col("c").alias("support"), F.lit(0).cast("bigint").alias("called"),
                     F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0).alias("right")),
            F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("c").alias("called"),
                     F.lit(0).cast("bigint").alias("right")),
        )).alias("s")
    ).select("s.*")
    totals = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("right").alias("right")
    )
    precision = F.coalesce(F.col("right") / F.nullif(F.col("called"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("right") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(
        2 * F.col("right") / F.nullif(F.col("called") + F.col("support"), F.lit(0)), F.lit(0.0)
    )
    return totals.select(
        "class", F.round(precision, DIGITS).alias("precision"), F.round(recall, DIGITS).alias("recall"),
        F.round(f1, DIGITS).alias("f1"), "support",
    )


def best_and_worst(df: DataFrame, method: str = "method", rmse: str = "rmse", mae: str = "mae") -> DataFrame:
    return df.agg(
        F.min(rmse).alias("best_rmse"), F.min_by(method, F.struct(rmse, method)).alias("best_rmse_method"),
        F.max(rmse).alias("worst_rmse"), F.max_by(method, F.struct(rmse, method)).alias("worst_rmse_method"),
        F.min(mae).alias("best_mae"), F.max(mae).alias("worst_mae"),
    )


def failures_by_method(df: DataFrame, method: str, predicted: str) -> DataFrame:
    return df.groupBy(method).agg(
        F.count_if(failed(F.col(predicted))).alias("n_failed"), F.count(F.lit(1)).alias("n")
    )
