"""Operators over one global row order, without an unpartitioned window.

The rows are range-partitioned on the order key and sorted inside each
partition. What crosses a partition border (offsets, running sums, the last
value seen) is one row per partition and is joined back, so no task ever holds
more than one range. Order keys must end in a unique row key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.session import materialize

_PART, _ROW = "__part", "__row"
_ROW_BITS = 33  # layout of monotonically_increasing_id: partition << 33 | row


def _range_sorted(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` with its range partition number and position inside that range."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    mid = F.monotonically_increasing_id()
    ranged = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("__mid", mid)
        .withColumn(_PART, F.shiftright("__mid", _ROW_BITS).cast("int"))
        .withColumn(_ROW, F.col("__mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("__mid")
    )
    return materialize(ranged, "ordered")


def _before(summary: DataFrame, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over earlier partitions; ``summary`` has one row each."""
    w = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def with_global_index(df: DataFrame, order: Sequence[str | Column], out: str = "pos") -> DataFrame:
    """Add the 0-based position of every row in the global order."""
    ranged = _range_sorted(df, order)
    counts = ranged.groupBy(_PART).agg(F.count(F.lit(1)).alias("__n"))
    offsets = _before(counts, "__n", "__off").select(_PART, "__off")
    return (
        ranged.join(F.broadcast(offsets), _PART)  # one row per range partition
        .withColumn(out, (F.col("__off") + F.col(_ROW)).cast("long"))
        .drop(_PART, _ROW, "__off")
    )


def running_total(df: DataFrame, order: Sequence[str | Column], value: str, out: str) -> DataFrame:
    """Inclusive running sum of an integer ``value`` in the global order."""
    ranged = _range_sorted(df, order)
    sums = ranged.groupBy(_PART).agg(F.sum(value).alias("__s"))
    offsets = _before(sums, "__s", "__off").select(_PART, "__off")
    w = Window.partitionBy(_PART).orderBy(_ROW)
    return (
        ranged.withColumn("__local", F.sum(value).over(w))
        .join(F.broadcast(offsets), _PART)
        .withColumn(out, F.col("__off") + F.col("__local"))
        .drop(_PART, _ROW, "__off", "__local")
    )


def with_previous(
    df: DataFrame, order: Sequence[str], value: str, out: str, by: str | None = None
) -> DataFrame:
    """``lag(value)`` in the global order, restarted for every ``by`` value.

    A hot ``by`` value is spread over several ranges like any other rows.
    """
    key = F.col(by) if by else F.lit(0)
    ranged = _range_sorted(df.withColumn("__g", key), ([by] if by else []) + list(order))
    tails = ranged.groupBy(_PART).agg(F.max_by(F.struct("__g", value), _ROW).alias("__tail"))
    w = Window.orderBy(_PART)
    carry = tails.select(_PART, F.lag("__tail").over(w).alias("__carry"))
    inside = Window.partitionBy(_PART).orderBy(_ROW)
    prev = F.lag(F.struct("__g", value)).over(inside)
    return (
        ranged.withColumn("__prev", prev)
        .join(F.broadcast(carry), _PART)
        .withColumn("__prev", F.when(F.col(_ROW) == 0, F.col("__carry")).otherwise(F.col("__prev")))
        .withColumn(out, F.when(F.col("__prev.__g").eqNullSafe(F.col("__g")), F.col(f"__prev.{value}")))
        .drop(_PART, _ROW, "__g", "__prev", "__carry")
    )


def forward_fill(
    df: DataFrame, order: Sequence[str], value: str, out: str, by: str | None = None
) -> DataFrame:
    """Fill NULLs with the last earlier value, optionally within ``by``."""
    key = F.col(by) if by else F.lit(0)
    ranged = _range_sorted(df.withColumn("__g", key), ([by] if by else []) + list(order))
    known = F.col(value).isNotNull()
    # Per range: the group at each end, and the last known value of the tail group.
    ends = ranged.groupBy(_PART).agg(
        F.min_by("__g", _ROW).alias("__head"), F.max_by("__g", _ROW).alias("__tail")
    )
    tails = (
        ranged.join(F.broadcast(ends), _PART)
        .where(F.col("__g").eqNullSafe(F.col("__tail")) & known)
        .groupBy(_PART)
        .agg(F.max_by(value, _ROW).alias("__last"))
    )
    ends = ends.join(tails, _PART, "left")
    # Groups are contiguous, so the nearest earlier tail of the same group decides.
    earlier = ends.select(
        F.col(_PART).alias("__p2"), F.col("__tail").alias("__t2"), F.col("__last").alias("__l2")
    ).where(F.col("__l2").isNotNull())
    carry = (
        ends.join(
            earlier, F.col("__head").eqNullSafe(F.col("__t2")) & (F.col("__p2") < F.col(_PART)), "left"
        )
        .groupBy(_PART)
        .agg(F.first("__head").alias("__head"), F.max_by("__l2", "__p2").alias("__carry"))
    )
    w = Window.partitionBy(_PART, "__g").orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.when(F.col("__g").eqNullSafe(F.col("__head")), F.col("__carry"))
    return (
        ranged.withColumn("__fill", F.last(value, ignorenulls=True).over(w))
        .join(F.broadcast(carry), _PART)
        .withColumn(out, F.coalesce("__fill", carried))
        .drop(_PART, _ROW, "__g", "__fill", "__head", "__carry")
    )


def running_in_group(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str, total: str) -> DataFrame:
    """Inclusive running sum of ``value`` inside every group, and the group's total; null is a group.

    A group of any size lies in as many ranges as it needs; what is joined back
    is one row per range and group.
    """
    by = list(by)
    ranged = _range_sorted(df, [*by, *order])
    local = F.sum(value).over(Window.partitionBy(_PART).orderBy(_ROW))
    ranged = ranged.withColumn("__local", local)
    names = [f"__by{k}" for k in range(len(by))]
    spans = ranged.groupBy(F.col(_PART).alias("__p"), *[F.col(b).alias(n) for b, n in zip(by, names)]).agg(
        F.min(F.col("__local") - F.col(value)).alias("__start"), F.sum(value).alias("__sum")
    )
    group = Window.partitionBy(*names)
    earlier = group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"__before": F.coalesce(F.sum("__sum").over(earlier), F.lit(0)), total: F.sum("__sum").over(group)})
    same = F.col(_PART) == F.col("__p")
    for b, n in zip(by, names):
        same = same & F.col(b).eqNullSafe(F.col(n))
    return (
        ranged.join(spans, same).withColumn(out, F.col("__local") - F.col("__start") + F.col("__before"))
        .drop(_PART, _ROW, "__local", "__p", "__start", "__sum", "__before", *names)
    )


def rank_in_group(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rank", size: str = "size") -> DataFrame:
    """Add the 1-based place inside the group and the rows of the group."""
    return running_in_group(df.withColumn("__one", F.lit(1).cast("long")), by, order, "__one", out, size).drop("__one")


SALTS = 32  # parts into which the rows of a group are dealt when one row per group is joined to them


def join_group_rows(df: DataFrame, per_group: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join one row per group to the rows of ``df``; null is a group. A large group is dealt to ``SALTS`` tasks.

    Spark still broadcasts ``per_group`` where it finds it small.
    """
    names = [f"__by{k}" for k in range(len(by))]
    small = per_group.withColumnsRenamed(dict(zip(by, names))).withColumn("__dealt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)).cast("int"))
    same = F.col("__salt") == F.col("__dealt")
    for b, n in zip(by, names):
        same = same & F.col(b).eqNullSafe(F.col(n))
    return dealt.join(small, same, how).drop("__salt", "__dealt", *names)


def durbin_watson(df: DataFrame, order: Sequence[str], residual: str) -> DataFrame:
    """Sum of squared successive differences over sum of squares."""
    lagged = with_previous(df.select(*order, residual), order, residual, "__prev_e")
    e, prev = F.col(residual), F.col("__prev_e")
    return lagged.agg(
        F.try_divide(F.sum((e - prev) * (e - prev)), F.sum(e * e)).alias("durbin_watson"),
        F.count(residual).alias("n"),
    )
