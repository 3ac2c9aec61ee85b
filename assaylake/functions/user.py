"""User-supplied functions: element-wise on Arrow batches, and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_values(df: DataFrame, col: str, fn: Callable[[pd.Series], pd.Series], returns: str = "double", out: str | None = None) -> DataFrame:
    """Apply a vectorised function to a column, one Arrow batch at a time."""

    @F.pandas_udf(returns)
    def run(x: pd.Series) -> pd.Series:
        return fn(x)

    return df.withColumn(out or col, run(F.col(col)))


def aggregate_by(df: DataFrame, by: str, aggs: Mapping[str, Column]) -> DataFrame:
    """Named aggregate expressions per group. Written as columns they are combined before the shuffle."""
    return df.groupBy(by).agg(*[c.alias(name) for name, c in aggs.items()])


def merge_by(
    df: DataFrame, by: str, partial: Callable[[pd.DataFrame], dict], merge: Callable[[pd.DataFrame], dict], fields: str
) -> DataFrame:
    """A user aggregate in Python that never holds a whole group.

    ``partial`` reduces the rows of a group inside one batch to one row,
    ``merge`` reduces such rows to the result. Only the partial rows are shuffled.
    """
    by_type = df.schema[by].dataType.simpleString()

    def reduce_batches(batches):
        for pdf in batches:
            rows = [{by: key, **partial(part)} for key, part in pdf.groupby(by, dropna=False)]
            if rows:
                yield pd.DataFrame(rows)

    def reduce_group(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{by: pdf[by].iloc[0], **merge(pdf)}])

    schema = f"`{by}` {by_type}, {fields}"
    return df.mapInPandas(reduce_batches, schema).groupBy(by).applyInPandas(reduce_group, schema)
