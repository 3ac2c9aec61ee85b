"""Exact quantiles and order statistics whose state stays bounded; the same bits whichever way they are found.

``percentile`` keeps every distinct value of a group in one task, so it is used
only where the group is counted first and found small. Larger columns go
through a sketch that brackets the wanted rank, and only the bracket is counted
value by value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.ordered import running_in_group

SMALL = 200_000  # values per group that one aggregate may hold
BRACKET = 20_000  # distinct values brought to the driver to end a search
ACCURACY = 10_000  # sketch size


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], small: int = SMALL, counts: dict[str, int] | None = None
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column, nulls skipped. Known ``counts`` save a pass."""
    cols, probs = list(cols), list(probs)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    counts = counts or data.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols if not counts[c]}
    direct = [c for c in cols if 0 < counts[c] <= small]
    if direct:
        row = data.agg(*[F.percentile(c, F.array(*map(F.lit, probs))).alias(c) for c in direct]).first()
        out |= {c: list(row[c]) for c in direct}
    large = {c: counts[c] for c in cols if counts[c] > small}
    ranks = {c: [p * (n - 1) for p in probs] for c, n in large.items()}
    found = order_statistics(data, {c: {r for x in xs for r in (math.floor(x), math.ceil(x))} for c, xs in ranks.items()}, large)
    for c, xs in ranks.items():
        low, high = [found[c, math.floor(x)] for x in xs], [found[c, math.ceil(x)] for x in xs]
        out[c] = [interpolate(x, a, b) for x, a, b in zip(xs, low, high)]
    return out


def interpolate(rank: float, low: float, high: float) -> float:
    """Value at a fractional rank, in the form that the ``percentile`` aggregate uses, so both ways give the same bits."""
    return low if low == high else (math.ceil(rank) - rank) * low + (rank - math.floor(rank)) * high


def order_statistics(df: DataFrame, ranks: dict[str, set[int]], counts: dict[str, int]) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks of several double columns in three passes.

    One pass sketches a bracket for every rank, one counts below and inside the
    brackets, one counts the values inside them. A bracket that is still too
    wide (heavy data, not heavy values) is searched further on its own.
    """
    targets = [(c, k) for c, ks in ranks.items() for k in sorted(ks)]
    if not targets:
        return {}
    eps = 4.0 / ACCURACY
    want = {c: [k / max(counts[c] - 1, 1) for k in sorted(ks)] for c, ks in ranks.items()}
    sketch = df.agg(*[
        F.percentile_approx(c, F.array(*[F.lit(x) for p in ps for x in (max(p - eps, 0.0), min(p + eps, 1.0))]), F.lit(ACCURACY)).alias(c)
        for c, ps in want.items()
    ]).first()
    bracket = {(c, k): tuple(sketch[c][2 * i : 2 * i + 2]) for c, ks in ranks.items() for i, k in enumerate(sorted(ks))}
    inside = {t: F.col(t[0]).between(F.lit(lo), F.lit(hi)) for t, (lo, hi) in bracket.items()}
    sizes = df.agg(*[
        f for i, t in enumerate(targets) for f in (F.count_if(F.col(t[0]) < F.lit(bracket[t][0])).alias(f"lt{i}"), F.count_if(inside[t]).alias(f"in{i}"))
    ]).first()
    below = {}
    for i, t in enumerate(targets):
        below[t] = sizes[f"lt{i}"]
        if not below[t] <= t[1] < below[t] + sizes[f"in{i}"]:
            raise RuntimeError("quantile sketch missed the requested rank")
    out = {t: lo for t, (lo, hi) in bracket.items() if lo == hi}
    open_ = [t for t in targets if t not in out]
    if open_:
        marks = F.array_compact(F.array(*[F.when(inside[t], F.struct(F.lit(i).alias("t"), F.col(t[0]).alias("v"))) for i, t in enumerate(open_)]))
        counted = df.select(F.explode(marks).alias("m")).groupBy("m.t", "m.v").agg(F.count(F.lit(1)).alias("c"))
        head = counted.limit(BRACKET * len(open_) + 1).collect()
        if len(head) <= BRACKET * len(open_):
            per: dict[int, list] = {}
            for r in head:
                per.setdefault(r["t"], []).append(r)
            for i, t in enumerate(open_):
                out[t] = _walk(sorted(per[i], key=lambda r: r["v"]), t[1] - below[t])
        else:
            for c, k in open_:
                out[c, k] = _select(df.select(F.col(c).alias("v")).where("v IS NOT NULL"), k, counts[c])
    return out


def _select(values: DataFrame, k: int, n: int):
    """Value at rank ``k``: sketch a bracket, count below it, repeat inside it."""
    inside, below, size = values, 0, n
    while True:
        distinct = inside.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        if size <= BRACKET:
            return _walk(distinct.orderBy("v").collect(), k - below)
        eps = 4.0 / ACCURACY
        p = (k - below) / max(size - 1, 1)
        lo, hi = inside.agg(
            F.percentile_approx(
                "v", F.array(F.lit(max(p - eps, 0.0)), F.lit(min(p + eps, 1.0))), F.lit(ACCURACY)
            ).alias("q")
        ).first()["q"]
        row = inside.agg(
            F.count_if(F.col("v") < F.lit(lo)).alias("lt"),
            F.count_if(F.col("v").between(F.lit(lo), F.lit(hi))).alias("inn"),
        ).first()
        if not below + row["lt"] <= k < below + row["lt"] + row["inn"]:
            raise RuntimeError("quantile sketch missed the requested rank")
        if lo == hi:
            return lo
        narrowed = inside.where(F.col("v").between(F.lit(lo), F.lit(hi)))
        head = narrowed.groupBy("v").agg(F.count(F.lit(1)).alias("c")).orderBy("v").limit(BRACKET + 1).collect()
        if len(head) <= BRACKET:
            return _walk(head, k - below - row["lt"])
        inside, below, size = narrowed, below + row["lt"], row["inn"]


def _walk(sorted_counts, k: int):
    for row in sorted_counts:
        if k < row["c"]:
            return row["v"]
        k -= row["c"]
    raise RuntimeError("rank outside the bracket")


def grouped_quantiles(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float], small: int = SMALL
) -> DataFrame:
    """One row per group with an array column of exact quantiles per value column."""
    by, cols, probs = list(by), list(cols), list(probs)
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= small:
        return df.groupBy(*by).agg(
            *[F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, probs))).alias(c) for c in cols]
        )
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(by, cols, "__col", "__v")
    keys = by + ["__col"]
    counted = long.where("__v IS NOT NULL").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    # Running counts know their group's total, so ranks are compared row by row; only the rows hit go to their group.
    running = running_in_group(counted, keys, ["__v"], "__c", "__cum", "__n")
    start = F.col("__cum") - F.col("__c")
    rank = lambda p: F.lit(p) * (F.col("__n") - 1)
    hits = F.array_compact(F.array(*[
        F.when(((F.floor(rank(p)) >= start) & (F.floor(rank(p)) < F.col("__cum"))) | ((F.ceil(rank(p)) >= start) & (F.ceil(rank(p)) < F.col("__cum"))), F.struct(F.lit(i).alias("i"), rank(p).alias("r")))
        for i, p in enumerate(probs)
    ]))
    picked = running.select(*keys, "__v", F.explode(hits).alias("__h"))
    low, high, r = F.min("__v"), F.max("__v"), F.max("__h.r")
    q = picked.groupBy(*keys, F.col("__h.i").alias("__i")).agg(F.when(low == high, low).otherwise((F.ceil(r) - r) * low + (r - F.floor(r)) * high).alias("__q"))
    arr = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__q"))), lambda s: s["__q"])
    return q.groupBy(*by, "__col").agg(arr.alias("__arr")).groupBy(*by).pivot("__col", cols).agg(F.first("__arr"))
