"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Round to ``digits`` and turn negative zero into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order; booleans are not numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Map NaN to NULL in every float column (aggregates skip NULL, not NaN)."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def as_double(names: Iterable[str]) -> list[Column]:
    return [F.col(n).cast("double").alias(n) for n in names]


def safe_div(a: Column, b: Column) -> Column:
    """NULL on a zero denominator; plain division raises in ANSI mode."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def first_true(pairs: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """``when`` chain from (condition, value) pairs."""
    head, *tail = pairs
    out = F.when(head[0], head[1])
    for cond, value in tail:
        out = out.when(cond, value)
    return out.otherwise(default)


def sum_columns(cols: Sequence[Column]) -> Column:
    """Balanced sum, so a wide formula stays a shallow expression tree."""
    cols = list(cols)
    if not cols:
        return F.lit(0.0)
    while len(cols) > 1:
        cols = [cols[i] + cols[i + 1] if i + 1 < len(cols) else cols[i] for i in range(0, len(cols), 2)]
    return cols[0]


def tidy(df: DataFrame, ids: Sequence[str] = (), name: str = "metric", value: str = "value") -> DataFrame:
    """One wide row (per id) to long (name, value) rows."""
    values = [c for c in df.columns if c not in ids]
    return df.select(*ids, *as_double(values)).unpivot(list(ids), values, name, value)


def complete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in ``cols``.

    One predicate per column instead of ``na.drop``: its single many-column
    predicate makes constraint inference exponential over aliased columns.
    """
    tests = [F.col(f"`{c}`").isNotNull() for c in (cols or df.columns)]
    while len(tests) > 1:
        tests = [tests[i] & tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return df.where(tests[0]) if tests else df
