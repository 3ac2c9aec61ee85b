"""Rows within a radius of every row, counted without listing the pairs.

Copies of a point are merged. A k-d split, made on the driver from a bounded
sample, deals the points into leaves. What a leaf's box wholly holds within the
radius is added up; only points near the rim of a leaf's reach visit it. In a
task the points at hand are split on: a query takes the sum of every box inside
its ball, passes by every box outside, and measures the points of the few small
boxes that the rim of its ball crosses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.boxes import Split
from assaylake.session import materialize

SAMPLE, LEAVES, LEAF_POINTS = 1 << 17, 2048, 1 << 15
VISITORS = 1 << 19  # points that visit a leaf in one task, about
SMALL = 64  # points of a box that are measured one by one
CHUNK = 1 << 18
SLACK = 1e-9  # relative; boxes decide only what rounding cannot turn


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _reach(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared smallest and largest distance of points and boxes, row by row."""
    least, most = 0.0, 0.0
    for j in range(x.shape[1]):
        below, above = low[..., j] - x[:, j], x[:, j] - high[..., j]
        gap, far = np.maximum(np.maximum(below, above), 0.0), np.maximum(-below, -above)
        least, most = least + gap * gap, most + far * far
    return least, most


def count_within(x: np.ndarray, y: np.ndarray, w: np.ndarray, eps2: float) -> np.ndarray:
    """Sum of the weights ``w`` of the rows of ``y`` within the radius of every row of ``x``."""
    total = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), np.arange(len(y)))] if len(x) and len(y) else []
    while todo:
        asked, held = todo.pop()
        part = y[held]
        low, high = part.min(axis=0), part.max(axis=0)
        least, most = _reach(x[asked], low, high)
        inside = most <= eps2 * (1 - SLACK)
        total[asked[inside]] += w[held].sum()
        asked = asked[~inside & (least <= eps2 * (1 + SLACK))]
        if not len(asked):
            continue
        axis = int((high - low).argmax())
        if len(held) > SMALL and high[axis] > low[axis]:
            order = np.argpartition(part[:, axis], len(held) // 2)
            todo += [(asked, held[order[: len(held) // 2]]), (asked, held[order[len(held) // 2 :]])]
            continue
        step = max(1, CHUNK // len(held))
        for s in range(0, len(asked), step):
            some = asked[s : s + step]
            d2 = 0.0
            for j in range(x.shape[1]):
                gap = x[some, j][:, None] - part[:, j][None]
                d2 = d2 + gap * gap
            total[some] += ((d2 <= eps2).astype(np.float64) @ w[held].astype(np.float64)).astype(np.int64)
    return total


def neighbour_sums(points: DataFrame, d: int, eps: float, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """(x, n): for every point of a written table (x, w) with different x the sum of the weights within ``eps``, its own included."""
    eps2 = eps * eps
    total = points.count()
    share = min(1.0, SAMPLE / max(total, 1))
    picked = points.where(F.pmod(F.xxhash64("x"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else points
    sample = _matrix(picked.select("x").limit(2 * SAMPLE).toArrow().column(0), d)
    leaves = max(1, min(LEAVES, -(-total // leaf_points)))
    split = Split.of(sample, max(1, -(-len(sample) // leaves))) if len(sample) else Split.of(np.zeros((1, d)), 1)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(split.home(_matrix(batch.column(0), d)))], names=["x", "w", "leaf"])

    placed = materialize(points.select("x", "w").mapInArrow(home, "x array<double>, w long, leaf long"), "placed")
    axes = [F.element_at("x", j + 1) for j in range(d)]
    met = placed.groupBy("leaf").agg(F.count(F.lit(1)), F.sum("w"), *[F.min(a) for a in axes], *[F.max(a) for a in axes]).collect()  # at most a row per leaf
    met = np.array(sorted([float(v) for v in r] for r in met)).reshape(-1, 3 + 2 * d)
    number, size, weight, low, high = met[:, 0].astype(np.int64), met[:, 1], met[:, 2].astype(np.int64), met[:, 3 : 3 + d], met[:, 3 + d :]

    # Per leaf: what is within reach of all its points as a whole, and the leaves it has to be compared with.
    held, parts, hosts = np.zeros(len(met), np.int64), np.ones(len(met), np.int64), [[] for _ in met]
    for a in range(len(met)):
        least, most = 0.0, 0.0
        for j in range(d):
            gap = np.maximum(np.maximum(low[:, j] - high[a, j], low[a, j] - high[:, j]), 0.0)
            far = np.maximum(high[:, j] - low[a, j], high[a, j] - low[:, j])
            least, most = least + gap * gap, most + far * far
        inside = most <= eps2 * (1 - SLACK)
        held[a] = weight[inside].sum()
        some = np.flatnonzero(~inside & (least <= eps2 * (1 + SLACK)))
        parts[a] = max(1, -(-int(size[some].sum()) // VISITORS))
        for b in some:
            hosts[b].append(a)
    start = np.concatenate([[0], np.cumsum([len(h) for h in hosts])]).astype(np.int64)
    host = np.array([a for h in hosts for a in h], np.int32)
    shared = points.sparkSession.sparkContext.broadcast((number, low, high, start, host, parts, held))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Points for the leaves that they may meet; what all points of a leaf reach is sent as a sum (x is null)."""
        number, low, high, start, host, parts, _held = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                batch = whole.slice(s, 4096)
                x, w = _matrix(batch.column(0), d), batch.column(1).to_numpy()
                own = np.searchsorted(number, batch.column(2).to_numpy())
                first, reach = start[own], start[own + 1] - start[own]
                ends = np.cumsum(reach)
                for t in range(0, int(ends[-1]), CHUNK):
                    at = np.arange(t, min(t + CHUNK, int(ends[-1])))
                    q = np.searchsorted(ends, at, "right")
                    a = host[first[q] + at - (ends[q] - reach[q])]
                    least, most = _reach(x[q], low[a], high[a])
                    inside = most <= eps2 * (1 - SLACK)
                    rim = np.flatnonzero(~inside & (least <= eps2 * (1 + SLACK)))
                    sums = np.bincount(a[inside], w[q[inside]], len(number)).astype(np.int64) if inside.any() else np.zeros(len(number), np.int64)
                    full = np.flatnonzero(sums)
                    kept = pa.array(q[rim])
                    spot = (own[q[rim]] * 31 + q[rim]) % parts[a[rim]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(number[a[rim]]), pa.array(spot)], names=["x", "w", "leaf", "part"])
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(full), batch.schema.field(0).type), pa.array(sums[full]), pa.array(number[full]), pa.array(np.zeros(len(full), np.int64))], names=["x", "w", "leaf", "part"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every point of a leaf, once for each part of its visitors."""
        number, parts = shared.value[0], shared.value[5]
        for batch in batches:
            if batch.num_rows:
                often = parts[np.searchsorted(number, batch.column(2).to_numpy())]
                row = np.repeat(np.arange(batch.num_rows), often)
                part = np.arange(len(row)) - np.repeat(np.cumsum(often) - often, often)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part)], names=["x", "w", "leaf", "part"])

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.zeros(left.num_rows, np.int64)
        if left.num_rows:
            if left.column("part")[0].as_py() == 0:
                n += shared.value[6][np.searchsorted(shared.value[0], left.column("leaf")[0].as_py())]
            rim = right.filter(right.column("x").is_valid())
            n += int(right.filter(right.column("x").is_null()).column("w").to_numpy().sum())
            n += count_within(_matrix(left.column("x"), d), _matrix(rim.column("x"), d), rim.column("w").to_numpy(), eps2)
        return pa.table([left.column("x"), pa.array(n)], names=["x", "n"])

    schema = "x array<double>, w long, leaf long, part long"
    wide = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(leaves, 3 * points.sparkSession.sparkContext.defaultParallelism))
    here, there = (placed.mapInArrow(f, schema).repartition(wide, "leaf", "part") for f in (hold, visit))
    counted = here.groupBy("leaf", "part").cogroup(there.groupBy("leaf", "part")).applyInArrow(count, "x array<double>, n long")
    return counted.groupBy("x").agg(F.sum("n").alias("n")) if (parts > 1).any() else counted
