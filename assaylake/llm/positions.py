"""Places of rows inside ordered groups, where one group may hold any share of all rows.

Rows are cut into ranges of the whole order, so a large group lies in many
ranges. What crosses a range border is one row per range and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.frames import written

ROWS_PER_RANGE = 50_000
_ROW_BITS = 33  # layout of monotonically_increasing_id: partition << 33 | row


def ranked(df: DataFrame, by: str, order: Sequence[Column | str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``rank`` (0-based place inside the group), ``size`` (rows of the group) and ``start``.

    ``start`` is the place of the group's first row among all rows, in the order
    of ``by`` (null first): it identifies the group and orders the groups. Rows
    equal in ``by`` and ``order`` are placed in any order. ``df`` should be a
    written table: it is read three times (count, sample, sort).
    """
    ranges = max(1, -(-df.count() // rows_per_range))
    keys = [F.col(by).asc_nulls_first(), *[c if isinstance(c, Column) else F.col(c).asc_nulls_first() for c in order]]
    mid = F.monotonically_increasing_id()
    cut = written(
        df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
        .withColumn("__range", F.shiftright(mid, _ROW_BITS)).withColumn("__row", mid.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))),
        "ranges",
    )
    spans = cut.groupBy("__range", F.col(by).alias("__by")).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    one = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = cut.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows")).select(F.col("__range").alias("__r"), F.coalesce(F.sum("__rows").over(one), F.lit(0)).alias("__offset"))
    group = Window.partitionBy("__by")
    earlier = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.join(offsets, F.col("__range") == F.col("__r")).select(
        F.col("__range").alias("__r"), "__by", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(group).alias("size"), F.min(F.col("__offset") + F.col("__first")).over(group).alias("start"),
    )
    return (
        cut.join(placed, (F.col("__range") == F.col("__r")) & F.col(by).eqNullSafe(F.col("__by")))
        .withColumn("rank", F.col("__row") - F.col("__first") + F.col("__before"))
        .drop("__range", "__r", "__row", "__by", "__first", "__before")
    )
