"""Pairs of boxes that lie near each other, in any number of dimensions, by a k-d split.

The split is made on the driver from a bounded sample of box corners. Each box
belongs to the leaf of its lower corner and visits all leaves within reach; a
task compares the boxes of a leaf with its visitors, and splits on while they
are many. Every axis takes part, so many dimensions do not pile up in few cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, LEAVES, LEAF_BOXES, INNER = 1 << 17, 1 << 13, 2000, 128


@dataclass(frozen=True)
class Split:
    """A k-d tree: node k divides ``axis[k]`` at ``value[k]`` into nodes ``below[k]`` and ``above[k]``; leaves have axis -1 and ``leaf`` their number."""

    axis: np.ndarray
    value: np.ndarray
    below: np.ndarray
    above: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def of(points: np.ndarray, most: int) -> Split:
        """Median splits along the widest axis until a leaf has at most ``most`` of the points, or only equal ones."""
        nodes: list[list] = []
        leaves = 0

        def grow(rows: np.ndarray) -> int:
            nonlocal leaves
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, 0])
            part = points[rows]
            wide = part.max(axis=0) - part.min(axis=0) if len(rows) > most else np.zeros(1)
            axis = int(wide.argmax())
            if wide[axis] > 0:
                middle = float(np.median(part[:, axis]))
                if not (part[:, axis] < middle).any():
                    middle = float(part[part[:, axis] > middle, axis].min())
                left = part[:, axis] < middle
                nodes[at] = [axis, middle, grow(rows[left]), grow(rows[~left]), 0]
            else:
                nodes[at][4] = leaves
                leaves += 1
            return at

        grow(np.arange(len(points)))
        columns = list(zip(*nodes))
        return Split(*[np.array(c, float if k == 1 else np.int64) for k, c in enumerate(columns)])

    def home(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(self.axis[at] >= 0)
            if not len(inner):
                return self.leaf[at]
            node = at[inner]
            at[inner] = np.where(points[inner, self.axis[node]] < self.value[node], self.below[node], self.above[node])

    def reached(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box, leaf) for all leaves that the boxes touch."""
        box, at = np.arange(len(low)), np.zeros(len(low), np.int64)
        boxes, leaves = [], []
        while len(at):
            end = self.axis[at] < 0
            boxes.append(box[end])
            leaves.append(self.leaf[at[end]])
            box, at = box[~end], at[~end]
            axis, value = self.axis[at], self.value[at]
            left, right = low[box, axis] < value, high[box, axis] >= value
            box, at = np.concatenate([box[left], box[right]]), np.concatenate([self.below[at[left]], self.above[at[right]]])
        return np.concatenate(boxes) if boxes else box, np.concatenate(leaves) if leaves else at


def near(alow: np.ndarray, ahigh: np.ndarray, blow: np.ndarray, bhigh: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) for boxes whose gap is at most ``eps``; b is compared where it can meet a's lower corner's leaf."""
    side = (ahigh - alow).max(axis=0)
    inner = Split.of(alow, INNER)
    of_a = inner.home(alow)
    b, of_b = inner.reached(blow - eps - side, bhigh + eps)
    order_a, order_b = np.argsort(of_a, kind="stable"), np.argsort(of_b, kind="stable")
    of_a, of_b, b = of_a[order_a], of_b[order_b], b[order_b]
    for leaf in np.unique(of_a):
        mine = order_a[np.searchsorted(of_a, leaf) : np.searchsorted(of_a, leaf, "right")]
        others = b[np.searchsorted(of_b, leaf) : np.searchsorted(of_b, leaf, "right")]
        for s in range(0, len(others), 1 << 14):
            part = others[s : s + (1 << 14)]
            gap2 = np.zeros((len(mine), len(part)))
            for j in range(alow.shape[1]):
                gap = np.maximum(np.maximum(blow[part, j][None] - ahigh[mine, j][:, None], alow[mine, j][:, None] - bhigh[part, j][None]), 0.0)
                gap2 += gap * gap
            x, y = np.nonzero(gap2 <= eps * eps)
            yield mine[x], part[y]


def _sides(batch: pa.RecordBatch | pa.Table, d: int) -> tuple[np.ndarray, np.ndarray]:
    col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy()
    return tuple(np.stack([col(f"{side}{j}") for j in range(d)], axis=1) if batch.num_rows else np.zeros((0, d)) for side in ("lo", "hi"))


def with_leaf(boxes: DataFrame, d: int) -> tuple[DataFrame, Split]:
    """Adds ``leaf`` to a written table with the columns lo0, hi0, ... of boxes."""
    total = boxes.count()
    share = min(1.0, SAMPLE / max(total, 1))
    picked = boxes.where(F.rand(7) < share) if share < 1 else boxes
    corners = _sides(picked.select(*[f"{s}{j}" for s in ("lo", "hi") for j in range(d)]).limit(2 * SAMPLE).toArrow(), d)[0]
    leaves = max(1, min(LEAVES, -(-total // LEAF_BOXES)))
    split = Split.of(corners, max(1, -(-len(corners) // leaves))) if len(corners) else Split.of(np.zeros((1, d)), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(split.home(_sides(batch, d)[0]))], names=[*batch.schema.names, "leaf"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema) + ", leaf long"
    return boxes.mapInArrow(run, schema), split


def visitors(boxes: DataFrame, split: Split, d: int, eps: float, widest: float) -> DataFrame:
    """Every box once for each leaf (column ``leaf``) that may hold a box within ``eps``; none is wider than ``widest`` along an axis."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = _sides(batch, d)
            box, leaf = split.reached(low - eps - widest, high + eps)
            for s in range(0, len(box), 1 << 16):
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(box[s : s + (1 << 16)])).columns, pa.array(leaf[s : s + (1 << 16)])], names=[*batch.schema.names, "leaf"])

    return boxes.mapInArrow(visit, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema) + ", leaf long")


def near_pairs(boxes: DataFrame, split: Split, key: str, d: int, eps: float, widest: float, asking: Column | None = None) -> DataFrame:
    """(a, b): names of all ordered pairs of different boxes whose gap is at most ``eps``; where ``asking`` is given, a is one of those.

    ``boxes`` has the columns of ``with_leaf``; no box is wider than ``widest`` along an axis.
    """
    sides = [f"{s}{j}" for s in ("lo", "hi") for j in range(d)]
    kind = boxes.schema[key].dataType.simpleString()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column(key), right.column(key)
        found = list(near(*_sides(left, d), *_sides(right, d), eps)) if left.num_rows and right.num_rows else []
        x = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        y = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        out = pa.table([a.take(pa.array(x)), b.take(pa.array(y))], names=["a", "b"])
        return out.filter(pc.not_equal(out.column("a"), out.column("b")))

    left = boxes if asking is None else boxes.where(asking)
    right = visitors(boxes.select(key, *sides), split, d, eps, widest)
    return left.select(key, *sides, "leaf").groupBy("leaf").cogroup(right.groupBy("leaf")).applyInArrow(compare, f"a {kind}, b {kind}")
