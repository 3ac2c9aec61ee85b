"""Density-based clustering on a grid, exact for any distribution.

Cells have side eps / sqrt(d), so rows of one cell are neighbours of each
other. A cell with ``min_samples`` rows is all core without comparing a single
pair; only rows of thinner cells are compared, with the rows of nearby cells.
Copies of a point are merged first, and large cells are dealt out in buckets.
The occupied cells form a dictionary over all axes; which of them are near each
other is found by a k-d split of their boxes, whatever the number of features.
Clusters are the connected parts of the graph of core cells, which is far
smaller than the data. Cells are linked by a few outermost core rows of each
wherever these lie within eps: inside a leaf of the split in one task, across
leaves in rounds. Only pairs of near cells that are in different parts after
that are compared by all their rows, so dense places cost no more than a pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.columns import sum_columns
from assaylake.operators.boxes import Split, _sides, near, near_pairs, visitors, with_leaf
from assaylake.operators.counting import _matrix
from assaylake.operators.ordered import with_global_index
from assaylake.session import materialize

BUCKET_ROWS = 10_000  # rows of one cell that a join task takes at a time
POINT_PAIRS = 4096  # up to this many pairs of rows two cell parts are compared row by row
ROUNDS = 2  # label rounds between two written tables
FINER = 4  # parts per side when a pair of cells stays undecided
DIAGONAL = 3  # up to this many features the outermost rows are also taken along the diagonals
PAIRS = 1 << 13  # pairs of cells whose outermost rows are compared at a time


def _squared(cols: Sequence[Column]) -> Column:
    return sum_columns([c * c for c in cols])


def _gap2(a: str, b: str, d: int) -> Column:
    """Squared smallest distance of two boxes."""
    lo, hi = (lambda s, j: F.col(f"{s}_lo{j}")), (lambda s, j: F.col(f"{s}_hi{j}"))
    return _squared([F.greatest(lo(b, j) - hi(a, j), lo(a, j) - hi(b, j), F.lit(0.0)) for j in range(d)])


def _span2(a: str, b: str, d: int) -> Column:
    """Squared largest distance of two boxes."""
    return _squared([
        F.greatest(F.abs(F.col(f"{b}_hi{j}") - F.col(f"{a}_lo{j}")), F.abs(F.col(f"{a}_hi{j}") - F.col(f"{b}_lo{j}"))) for j in range(d)
    ])


def _box(d: int) -> list[Column]:
    return [F.min(f"x{j}").alias(f"lo{j}") for j in range(d)] + [F.max(f"x{j}").alias(f"hi{j}") for j in range(d)]


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{p}_{c}" for c in df.columns})


def _dist2(a: str, b: str, d: int) -> Column:
    return _squared([F.col(f"{a}_x{j}") - F.col(f"{b}_x{j}") for j in range(d)])


def _outer(d: int) -> Column:
    """Coordinates of the outermost rows of a group along each direction, one after the other.

    All parts of a row come from one aggregate, which sees the rows in one
    order and keeps the first of equals, so they belong to the same row.
    """
    xs = [F.col(f"x{j}") for j in range(d)]
    along = xs + ([v for i in range(d) for j in range(i) for v in (xs[i] + xs[j], xs[i] - xs[j])] if d <= DIAGONAL else [])
    return F.array(*[pick(x, v) for v in along for pick in (F.min_by, F.max_by) for x in xs]).alias("outer")


def dbscan(df: DataFrame, features: Sequence[str], key: str, eps: float, min_samples: int = 5, out: str = "cluster") -> DataFrame:
    """Add the cluster number (-1 for noise), numbered by the first core row, and ``is_core``.

    Rows with a null or NaN feature are noise and nobody's neighbours.
    """
    d, eps2 = len(features), eps * eps
    side = eps / math.sqrt(d) * (1 - 1e-12)
    widest = side * (1 + 1e-9)  # a cell's rows, with rounding
    xs = [f"x{j}" for j in range(d)]
    raw = df.select(F.col(key).alias("row"), *[(F.col(c).cast("double") + 0.0).alias(x) for c, x in zip(features, xs)])
    for x in xs:
        raw = raw.where(F.col(x).isNotNull() & ~F.isnan(x))
    points = raw.groupBy(*xs).agg(F.count(F.lit(1)).alias("w"), F.min("row").alias("pid"))
    points = materialize(points.withColumn("cell", _unit(xs, side, 0)), "points")
    about = [F.min("pid").alias("own"), F.count(F.lit(1)).alias("n"), *_box(d), _outer(d)]
    cells = materialize(points.groupBy("cell").agg(F.sum("w").alias("w"), *about), "cells")
    cells, split = with_leaf(cells, d)
    cells = materialize(cells, "cells")
    dense = F.col("w") >= min_samples

    # Pairs of cells that may hold neighbours of the rows of thin cells; at most one cell in BUCKET_ROWS rows is large.
    large = F.broadcast(materialize(cells.where(F.col("n") > BUCKET_ROWS).select("cell", F.ceil(F.col("n") / BUCKET_ROWS).alias("nb")), "large"))
    close = near_pairs(cells, split, "cell", d, eps, widest, ~dense).toDF("a_cell", "b_cell")
    pairs = materialize(close.join(large.toDF("b_cell", "b_nb"), "b_cell", "left").select("a_cell", "b_cell", F.coalesce("b_nb", F.lit(1)).alias("b_nb")), "cell-pairs")

    thin_cells = cells.where(~dense).select("cell", F.col("w").alias("cw"))
    thin = materialize(points.join(thin_cells, "cell").select("cell", "cw", "pid", "w", *xs), "thin")
    dense_points = points.join(thin_cells, "cell", "left_anti").select("cell", "pid", "w", *xs)

    def facing(rows: DataFrame, cell_pairs: DataFrame, others: DataFrame) -> DataFrame:
        """Rows next to the rows of nearby cells within eps, large cells bucket by bucket."""
        spread = cell_pairs.withColumn("b_bucket", F.explode(F.sequence(F.lit(0), (F.col("b_nb") - 1).cast("int"))))
        left = _prefixed(rows.select("cell", *xs), "a").join(spread, "a_cell")
        bucketed = others.join(large, "cell", "left").withColumn("bucket", F.coalesce(F.pmod(F.xxhash64(*xs), "nb"), F.lit(0)).cast("int"))
        return left.join(_prefixed(bucketed.select("cell", "bucket", "w", *xs), "b"), ["b_cell", "b_bucket"]).where(_dist2("a", "b", d) <= eps2)

    around = facing(thin, pairs, points).groupBy(*[F.col(f"a_{x}").alias(x) for x in xs]).agg(F.sum("b_w").alias("seen"))
    counted = thin.join(around, xs, "left").withColumn("core", F.col("cw") + F.coalesce("seen", F.lit(0)) >= min_samples)
    counted = materialize(counted.select("cell", "pid", "w", "core", *xs), "thin-core")
    thin_core = counted.where("core").drop("core")
    core = dense_points.unionByName(thin_core)

    thin_nodes = thin_core.groupBy("cell").agg(*about).join(cells.select("cell", "leaf"), "cell")
    nodes = materialize(cells.where(dense).drop("w").unionByName(thin_nodes), "nodes")
    parts = connected(nodes, core, split, side, d, eps)
    firsts = nodes.select("cell", "own").join(parts, "cell").groupBy("label").agg(F.min("own").alias("own"))
    numbered = with_global_index(firsts, [F.col("own").asc_nulls_last(), F.col("label")], out).select("label", F.col(out).cast("int").alias(out))
    labels = materialize(parts.join(numbered, "label").select("cell", out), "labels")

    # Core rows take the label of their cell; border rows the smallest label in reach.
    border = counted.where("NOT core").drop("core")
    same = border.join(labels, "cell").select(*xs, out)
    reach = facing(border, pairs.join(labels.toDF("b_cell", "b_label"), "b_cell"), core).select(*[F.col(f"a_{x}").alias(x) for x in xs], F.col("b_label").alias(out))
    border_rows = same.unionByName(reach).groupBy(*xs).agg(F.min(out).alias(out))
    core_rows = thin_core.join(labels, "cell").select(*xs, out, F.lit(True).alias("is_core"))
    found = core_rows.unionByName(border_rows.withColumn("is_core", F.lit(False)))
    placed = raw.withColumn("cell", _unit(xs, side, 0))
    in_dense = placed.join(labels.join(thin_cells, "cell", "left_anti"), "cell").select("row", out, F.lit(True).alias("is_core"))
    in_thin = placed.join(thin_cells, "cell", "left_semi").join(found, xs, "left").select("row", out, "is_core")
    joined = in_dense.unionByName(in_thin).withColumnRenamed("row", key)
    return df.join(joined, key, "left").withColumns({out: F.coalesce(out, F.lit(-1)), "is_core": F.coalesce("is_core", F.lit(False))})


def core_edges(core: DataFrame, pairs: DataFrame, side: float, d: int, eps2: float) -> DataFrame:
    """Those of the pairs of core cells (a_cell, b_cell) that have two core rows within eps.

    Pairs are decided by their boxes where possible, row by row where few rows
    are involved, and otherwise by boxes of finer parts. No pair of large cells
    is ever enumerated.
    """
    xs = [f"x{j}" for j in range(d)]
    todo = pairs.select("a_cell", "b_cell", F.col("a_cell").alias("a_parent"), F.col("b_cell").alias("b_parent"))
    met = pairs.select(F.col("a_cell").alias("cell")).unionByName(pairs.select(F.col("b_cell").alias("cell"))).distinct()
    core = materialize(core.join(met, "cell", "left_semi").select("cell", *xs), "core")
    with_unit = lambda level: core.withColumn("parent", _unit(xs, side, level - 1)).withColumn("unit", _unit(xs, side, level))
    found: list[DataFrame] = []
    level = 0
    while True:
        units = with_unit(level).groupBy("cell", "parent", "unit").agg(F.count(F.lit(1)).alias("n"), *_box(d))
        ua, ub = _prefixed(units, "a"), _prefixed(units, "b")
        boxes = todo.join(ua, ["a_cell", "a_parent"]).join(ub, ["b_cell", "b_parent"]).where(_gap2("a", "b", d) <= eps2)
        boxes = materialize(boxes.withColumn("sure", _span2("a", "b", d) <= eps2), "boxes")
        small = boxes.where(~F.col("sure") & (F.col("a_n") * F.col("b_n") <= POINT_PAIRS)).select("a_cell", "b_cell", "a_unit", "b_unit")
        rows = with_unit(level).select("cell", "unit", *xs)
        hits = small.join(_prefixed(rows, "a"), ["a_cell", "a_unit"]).join(_prefixed(rows, "b"), ["b_cell", "b_unit"]).where(_dist2("a", "b", d) <= eps2)
        done = materialize(boxes.where("sure").select("a_cell", "b_cell").unionByName(hits.select("a_cell", "b_cell")).distinct(), "edges")
        found.append(done)
        todo = materialize(
            boxes.where(~F.col("sure") & (F.col("a_n") * F.col("b_n") > POINT_PAIRS)).join(done, ["a_cell", "b_cell"], "left_anti")
            .select("a_cell", "b_cell", F.col("a_unit").alias("a_parent"), F.col("b_unit").alias("b_parent")), "open-pairs"
        )
        if not todo.limit(1).count():
            break
        level += 1
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _unit(xs: Sequence[str], side: float, level: int) -> Column:
    """Name of the part of a cell at a resolution; level 0 and below is the cell itself."""
    if level <= 0:
        return F.concat_ws("_", *[F.floor(F.col(x) / F.lit(side)).cast("long").cast("string") for x in xs])
    return F.concat_ws("_", *[F.floor(F.col(x) / F.lit(side / FINER**level)).cast("long").cast("string") for x in xs])


def linked(nodes: DataFrame, split: Split, side: float, d: int, eps: float) -> DataFrame:
    """Core cells (cell, leaf, box, outer) linked by their outermost rows, a leaf and its visitors at a time.

    Rows (kind, a, b): 0, a cell and the first cell of its part of the leaf; 1, a
    link of cells of two leaves; 2, near cells that are not known to be linked.
    """
    eps2 = eps * eps

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        name, other = left.column("cell").combine_chunks(), right.column("cell").combine_chunks()
        kinds, firsts, seconds = [], [], []

        def put(kind: int, a: pa.Array, b: pa.Array) -> None:
            kinds.append(np.full(len(a), kind))
            firsts.append(a)
            seconds.append(b)

        if left.num_rows and right.num_rows:
            at = pc.fill_null(pc.index_in(other, name), -1).to_numpy()  # place in this leaf, -1 elsewhere
            outer, met = (_matrix(t.column("outer"), d) for t in (left, right))
            k = len(outer) // len(name)
            outer, met = outer.reshape(-1, k, d), met.reshape(-1, k, d)
            inside, open_inside, part = [], [], np.arange(len(name))
            for x, y in near(*_sides(left, d), *_sides(right, d), eps):
                once = np.where(at[y] >= 0, at[y] > x, pc.less(name.take(pa.array(x)), other.take(pa.array(y))).to_numpy(zero_copy_only=False))
                x, y = x[once], y[once]
                for s in range(0, len(x), PAIRS):
                    i, j = x[s : s + PAIRS], y[s : s + PAIRS]
                    d2 = 0.0
                    for c in range(d):
                        gap = outer[i, :, c][:, :, None] - met[j, :, c][:, None, :]
                        d2 = d2 + gap * gap
                    close, here = (d2 <= eps2).any(axis=(1, 2)), at[j] >= 0
                    inside.append((i[close & here], at[j[close & here]]))
                    open_inside.append((i[~close & here], at[j[~close & here]]))
                    for kind, some in ((1, close & ~here), (2, ~close & ~here)):
                        put(kind, name.take(pa.array(i[some])), other.take(pa.array(j[some])))
            if inside:
                a, b = (np.concatenate(e) for e in zip(*inside))
                while True:
                    new = part.copy()
                    low = np.minimum(part[a], part[b])
                    for end in (a, b, part[a], part[b]):
                        np.minimum.at(new, end, low)
                    new = new[new]
                    if (new == part).all():
                        break
                    part = new
                a, b = (np.concatenate(e) for e in zip(*open_inside))
                apart = part[a] != part[b]
                put(2, name.take(pa.array(a[apart])), name.take(pa.array(b[apart])))
            put(0, name, name.take(pa.array(part)))
        elif left.num_rows:
            put(0, name, name)
        kind = np.concatenate(kinds) if kinds else np.zeros(0, np.int64)
        columns = [pa.concat_arrays(c) if c else pa.array([], name.type) for c in (firsts, seconds)]
        return pa.table([pa.array(kind.astype(np.int32)), *columns], names=["kind", "a", "b"])

    boxed = nodes.select("cell", *[f"{s}{j}" for s in ("lo", "hi") for j in range(d)], "outer", "leaf")
    there = visitors(boxed.drop("leaf"), split, d, eps, side * (1 + 1e-9))
    return boxed.groupBy("leaf").cogroup(there.groupBy("leaf")).applyInArrow(link, "kind int, a string, b string")


def merged(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """Parts (cell, label) joined where an edge (a_cell, b_cell) leads from one to another."""
    of = parts.select("cell", "label")
    ends = edges.join(of.toDF("a_cell", "a"), "a_cell").join(of.toDF("b_cell", "b"), "b_cell").where("a != b")
    crossing = materialize(ends.select(F.least("a", "b").alias("a_cell"), F.greatest("a", "b").alias("b_cell")).distinct(), "crossing")
    if not crossing.limit(1).count():
        return parts
    met = crossing.select(F.col("a_cell").alias("cell")).unionByName(crossing.select(F.col("b_cell").alias("cell"))).distinct()
    joined = components(materialize(met.withColumn("own", F.col("cell")), "met"), crossing)
    step = parts.join(joined.select(F.col("cell").alias("label"), F.col("label").alias("to")), "label", "left")
    return materialize(step.select("cell", F.coalesce("to", "label").alias("label")), "parts")


def connected(nodes: DataFrame, core: DataFrame, split: Split, side: float, d: int, eps: float) -> DataFrame:
    """(cell, label): the same label for all core cells of a connected part."""
    links = materialize(linked(nodes, split, side, d, eps), "links")
    of = lambda kind: links.where(F.col("kind") == kind)
    parts = merged(of(0).select(F.col("a").alias("cell"), F.col("b").alias("label")), of(1).select(F.col("a").alias("a_cell"), F.col("b").alias("b_cell")))
    doubtful = of(2).join(parts.toDF("a", "a_label"), "a").join(parts.toDF("b", "b_label"), "b").where("a_label != b_label")
    doubtful = materialize(doubtful.select(F.col("a").alias("a_cell"), F.col("b").alias("b_cell")), "doubtful")
    return merged(parts, core_edges(core, doubtful, side, d, eps * eps)) if doubtful.limit(1).count() else parts


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest ``own`` value of the connected part of every node (cell, own).

    Each round takes the smallest label of the neighbours, then follows labels
    to the label of their owner, so paths halve; every few rounds are written out.
    """
    both = materialize(
        edges.select(F.col("a_cell").alias("src"), F.col("b_cell").alias("dst")).unionByName(
            edges.select(F.col("b_cell").alias("src"), F.col("a_cell").alias("dst"))), "graph"
    )

    def lowered(labels: DataFrame) -> DataFrame:
        sent = both.join(labels.select(F.col("cell").alias("src"), "label"), "src").select(F.col("dst").alias("cell"), "label")
        low = sent.groupBy("cell").agg(F.min("label").alias("low"))
        return labels.join(low, "cell", "left").select("cell", "own", F.least("label", F.coalesce("low", "label")).alias("label"))

    def jumped(labels: DataFrame) -> DataFrame:
        owner = labels.select(F.col("own").alias("label"), F.col("label").alias("jump"))
        return labels.join(owner, "label").select("cell", "own", F.least("label", "jump").alias("label"))

    labels = nodes.withColumn("label", F.col("own"))
    while True:
        step = labels
        for _ in range(ROUNDS):
            step = jumped(lowered(step))
        step = materialize(step.join(labels.select("cell", F.col("label").alias("old")), "cell"), "labels")
        changed = step.where(F.col("old") != F.col("label")).limit(1).count()
        labels = step.drop("old")
        if not changed:
            return labels.select("cell", "label")
