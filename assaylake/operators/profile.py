"""Describe, profile, counts and group summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.columns import numeric_columns, sum_columns
from assaylake.operators.gram import gram
from assaylake.operators.quantiles import exact_quantiles


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: count, mean, sample std, min, quartiles, max."""
    cols = list(cols or numeric_columns(df))
    row = df.agg(
        *[
            F.struct(
                F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"),
            ).alias(c)
            for c in cols
        ]
    ).first()
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], counts={c: row[c]["count"] for c in cols})
    rows = [(c, row[c]["count"], row[c]["mean"], row[c]["std"], row[c]["min"], *q[c], row[c]["max"]) for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    )


def dimensions(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_cols"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, nulls, numeric columns, low variance flag, largest |r|."""
    num = numeric_columns(df)
    holes = sum_columns([F.col(f"`{c}`").isNull().cast("long") for c in df.columns])
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(holes).alias("missing"),
        *[F.var_samp(c).alias(f"v_{c}") for c in num],
    ).first()
    max_r = 0.0
    if len(num) > 1:
        r = np.abs(gram(df, num).correlation())
        upper = r[np.triu_indices(len(num), 1)]
        max_r = float(np.nanmax(upper)) if np.isfinite(upper).any() else None
    low = any(row[f"v_{c}"] is not None and row[f"v_{c}"] < 0.01 for c in num)
    return df.sparkSession.createDataFrame(
        [(row["n"], len(df.columns), int(row["missing"] or 0), len(num), low, max_r)],
        "no_of_rows long, no_of_cols long, missing_values long, numeric_cols long, "
        "has_low_variance boolean, max_correlation double",
    )


def group_means(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in cols])


def group_mode(df: DataFrame, by: str, col: str, out: str = "mode") -> DataFrame:
    """Most frequent value per group, smallest on ties, nulls skipped.

    Counted per (group, value) first, so a hot group reaches its task already
    reduced to its distinct values, and the pick is a streaming aggregate.
    """
    counted = df.where(F.col(col).isNotNull()).groupBy(by, col).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(col).alias("v")))
    return counted.groupBy(by).agg(best.alias("__b")).select(by, F.col("__b.v").alias(out))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))


def categories(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).cast("string").alias("category")).where("category IS NOT NULL").distinct().orderBy("category")


def histogram(df: DataFrame, col: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width counts over the range of all rows; empty bins are absent."""
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = float(row["lo"]), float(row["hi"])
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(*([by] if by else []), b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_start", F.lit(lo) + F.col("bin") * F.lit(width))
    )


def prediction_summary(df: DataFrame, col: str) -> DataFrame:
    return df.agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )
