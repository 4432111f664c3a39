"""The comparison table of methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tastegrid.operators.cleaning import keyword_filter


def union_results(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def method_report(
    tables: list[DataFrame], include: list[str] = (), exclude: list[str] = (),
    datasets: list[str] = (), drop: list[str] = (), sort_by: str = "rmse",
    method: str = "method", dataset: str = "dataset",
) -> DataFrame:
    """Union the result tables, filter by method keywords and data set, sort by metric."""
    rows = keyword_filter(union_results(tables), method, include, exclude)
    if datasets:
        rows = rows.filter(F.col(dataset).isin(list(datasets)))
    return rows.drop(*drop).orderBy(sort_by, method)
