"""Batch scoring by a caller's function, and repair of failed predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tastegrid.functions.parsing import failed
from tastegrid.session import stage

BATCH = 100


def score_batches(
    df: DataFrame, fn: Callable[[list], Iterable], input_col: str, output_col: str,
    output_type: str, batch: int = BATCH,
) -> DataFrame:
    """Score each distinct input once, in batches on the executors, and join back."""
    distinct = df.select(input_col).distinct()
    input_type = df.schema[input_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame[input_col].tolist()
            scores: list = []
            for start in range(0, len(values), batch):
                scores.extend(fn(values[start:start + batch]))
            yield pd.DataFrame({input_col: values, output_col: scores})

    scored = distinct.mapInPandas(run, f"{input_col} {input_type}, {output_col} {output_type}")
    return df.join(scored, input_col, "left")


def failed_rows(predictions: DataFrame, predicted: str = "predicted_rating") -> DataFrame:
    return predictions.filter(failed(F.col(predicted)))


def repair(
    predictions: DataFrame, rescored: DataFrame, keys: list[str],
    predicted: str = "predicted_rating",
) -> DataFrame:
    """Overwrite only the failed rows with their new score; a row that failed again
    keeps its old text."""
    new = rescored.select(*keys, F.col(predicted).cast("string").alias("_new"))
    is_failed = failed(F.col(predicted))
    return predictions.join(new, keys, "left").withColumns({
        "repaired": is_failed & F.col("_new").isNotNull(),
        predicted: F.when(is_failed, F.coalesce("_new", predicted)).otherwise(F.col(predicted)),
    }).drop("_new")


def repair_in_context(
    predictions: DataFrame, rebuild: Callable[[DataFrame], DataFrame], fn: Callable[[list], Iterable],
    keys: list[str], predicted: str = "predicted_rating", batch: int = BATCH,
) -> DataFrame:
    """Score the failed rows again from prompts built anew, and overwrite them alone.

    ``rebuild`` gets the failed rows, once per key, and returns ``keys`` with ``prompt``; distinct prompts
    go through ``fn`` in batches. The result has ``prompt`` (null where nothing failed) and
    ``repaired``; a row whose new score is null or failed again keeps its old text.
    """
    targets = stage(failed_rows(predictions, predicted).dropDuplicates(keys), "failed")
    prompts = stage(rebuild(targets).select(*keys, "prompt"), "prompts")
    scored = score_batches(prompts, fn, "prompt", predicted, "string", batch)
    usable = scored.withColumn(predicted, F.when(~failed(F.col(predicted)), F.col(predicted)))
    shown = prompts.withColumnRenamed("prompt", "_prompt")
    out = repair(predictions, usable, keys, predicted).join(shown, keys, "left")
    return out.withColumnRenamed("_prompt", "prompt")
