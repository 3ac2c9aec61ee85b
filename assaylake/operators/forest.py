"""Random forest grown on binned rows: large nodes by histograms of all tasks, small ones each in one task.

Spark ML's forest sends a histogram per node and task, 20 kB for 64 features and
10 classes, however few rows the node has; fully grown trees are mostly nodes of
a few rows. Here only nodes of more than ``LOCAL_WEIGHT`` rows are split by
histograms, level by level. The rows of a smaller node, at most that many, meet
in one task, which grows the rest of the tree and answers the rows asked for.

As there: Poisson bootstrap, up to 32 bins a feature, the square root of the
features drawn per node, Gini gain, class shares of the leaves added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.session import materialize

MAX_BINS, SPLIT_SAMPLE, MAX_CLASSES = 32, 10_000, 100
LOCAL_WEIGHT = 1 << 14  # bootstrap weight up to which a node is finished in one task
HISTOGRAM_NODES = 2048  # large nodes whose histograms a task holds at a time
EMIT_ROWS = 1 << 14
SHARE = 1 << 40  # shares of classes are added up as whole numbers, in any order the same
POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Evenly spread 64-bit numbers (splitmix64)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with mean 1, fixed by row, tree and seed."""
    start = _mixed(np.array([seed * 100_003 + tree], np.uint64))
    u = (_mixed(_mixed(ids.astype(np.uint64)) ^ start) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.searchsorted(POISSON, u, "right")


def drawn_features(seed: int, tree: int, nodes: np.ndarray, d: int) -> np.ndarray:
    """(node, slot): the features that a node may split by."""
    take = int(np.ceil(np.sqrt(d)))
    start = _mixed(np.array([seed * 100_003 + tree], np.uint64)) ^ np.uint64(0x5851F42D4C957F2D)
    keys = _mixed(_mixed(nodes.astype(np.uint64) ^ start)[:, None] + np.arange(d, dtype=np.uint64)[None])
    return np.argpartition(keys, take - 1, axis=1)[:, :take] if take < d else np.tile(np.arange(d), (len(nodes), 1))


def thresholds(values: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring values, or between about equal shares of the rows where the values are many."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) < MAX_BINS:
        return middles
    below = np.cumsum(counts)[:-1]
    wanted = len(values) * np.arange(1, MAX_BINS) / MAX_BINS
    return middles[np.unique(np.clip(np.searchsorted(below, wanted), 0, len(middles) - 1))]


def _children(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return 2 * node, 2 * node + 1


def _purity(counts: np.ndarray) -> np.ndarray:
    """Sum of squares over the total of class counts (last axis); the larger in both parts, the larger the Gini gain."""
    total = counts.sum(axis=-1)
    return (counts * counts).sum(axis=-1) / np.maximum(total, 1e-300)


@dataclass
class Tops:
    """The levels above the small nodes: per (tree, node) its split, or the class counts of a large leaf."""

    splits: list[dict[int, tuple[int, int]]]
    leaves: list[dict[int, np.ndarray]]

    def route(self, tree: int, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), np.int64)
        splits, level = self.splits[tree], [1] if self.splits[tree] else []
        while level:
            below = []
            for node in level:
                feature, edge = splits[node]
                here = np.flatnonzero(at == node)
                at[here] = 2 * node + (x[here, feature] > edge)
                below += [c for c in (2 * node, 2 * node + 1) if c in splits]
            level = below
        return at


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, asked: np.ndarray, classes: int, top: int, max_depth: int, tree: int, seed: int) -> np.ndarray:
    """Class shares, (asked row, class), of the leaves that the asked rows reach below the node ``top``; level by level, all nodes at once."""
    d = x.shape[1]
    shares = np.zeros((len(asked), classes))
    one_hot = np.zeros((len(y), classes))
    one_hot[np.arange(len(y)), y] = w
    rows, seekers = np.arange(len(y)), np.arange(len(asked))
    at, want = np.full(len(y), top, np.int64), np.full(len(asked), top, np.int64)
    depth = int(top).bit_length() - 1
    while len(seekers):
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        nodes, first = np.unique(at, return_index=True)
        own = np.searchsorted(nodes, at)
        totals = np.add.reduceat(one_hot[rows], first, axis=0)
        base = _purity(totals)
        gain, feature, edge = np.zeros(len(nodes)), np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
        if depth < max_depth:
            drawn = drawn_features(seed, tree, nodes, d)
            open_rows = np.flatnonzero(((totals > 0).sum(axis=1) > 1)[own])
            r, o = rows[open_rows], own[open_rows]
            for slot in range(drawn.shape[1] if len(r) else 0):
                value = x[r, drawn[o, slot]].astype(np.int64)
                sort = np.argsort(o * 256 + value, kind="stable")
                so, sv = o[sort], value[sort]
                left = np.cumsum(one_hot[r[sort]], axis=0)
                start = np.flatnonzero(np.diff(so, prepend=-1))
                ahead = np.zeros((len(start), classes))
                ahead[1:] = left[start[1:] - 1]
                cut = np.flatnonzero((so[1:] == so[:-1]) & (sv[1:] != sv[:-1]))
                if not len(cut):
                    continue
                group = np.searchsorted(start, cut, "right") - 1
                left = left[cut] - ahead[group]
                here = so[cut]
                better = _purity(left) + _purity(totals[here] - left) - base[here]
                begin = np.flatnonzero(np.diff(here, prepend=-1))
                top_gain = np.maximum.reduceat(better, begin)
                hit = np.flatnonzero(better == np.repeat(top_gain, np.diff(begin, append=len(here))))
                hit = hit[np.unique(here[hit], return_index=True)[1]]
                n = here[hit]
                won = better[hit] > np.maximum(gain[n], 1e-9)
                n, hit = n[won], hit[won]
                gain[n], feature[n], edge[n] = better[hit], drawn[n, slot], sv[cut[hit]]
        mine = np.searchsorted(nodes, want)
        ends = feature[mine] < 0
        shares[seekers[ends]] = totals[mine[ends]] / totals[mine[ends]].sum(axis=1, keepdims=True)
        mine, seekers = mine[~ends], seekers[~ends]
        want = 2 * nodes[mine] + (asked[seekers, feature[mine]] > edge[mine])
        on = feature[own] >= 0
        rows, own = rows[on], own[on]
        at = 2 * nodes[own] + (x[rows, feature[own]] > edge[own])
        depth += 1
    return shares


def _bins(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, d)


def _blobs(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


class RandomForestClassifier:
    """Takes the settings of Spark ML's class of this name; ``fit`` reads the rows, ``transform`` adds ``prediction``."""

    def __init__(self, featuresCol: str, labelCol: str, numTrees: int, maxDepth: int, seed: int):
        self.features, self.label, self.trees, self.depth, self.seed = featuresCol, labelCol, numTrees, maxDepth, seed

    def fit(self, train: DataFrame) -> ForestModel:
        label = F.col(self.label).cast("double")
        rows = materialize(train.select(F.monotonically_increasing_id().alias("id"), label.alias("y"), vector_to_array(self.features).alias("x")), "train")
        bad = F.col("y").isNull() | F.isnan("y") | (F.col("y") < 0) | (F.col("y") != F.floor("y"))
        n, top, wrong = rows.agg(F.count(F.lit(1)), F.max("y"), F.count_if(bad)).first()
        if not n or wrong:
            raise ValueError(f"{wrong} of {n} labels are not whole numbers from 0")
        if top >= MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        share = 2 * SPLIT_SAMPLE / n
        picked = rows.where(F.pmod(F.xxhash64("id", F.lit(self.seed)), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else rows
        sample = np.array(picked.select("x").limit(SPLIT_SAMPLE).toArrow().column(0).to_pylist(), dtype=float)
        edges = [thresholds(c) for c in sample.T]
        binned = materialize(_binned(rows, edges, "y double"), "binned")
        model = ForestModel(self, binned, edges, int(top) + 1, Tops([{} for _ in range(self.trees)], [{} for _ in range(self.trees)]))
        if n * 1.0 > LOCAL_WEIGHT / 2:  # bootstrap weights come close to the number of rows
            model.split_large_nodes()
        return model


def _binned(rows: DataFrame, edges: list[np.ndarray], more: str) -> DataFrame:
    """(id, one more column, x): the bin of every feature as one byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                x = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _blobs(x)], names=["id", batch.schema.names[1], "x"])

    return rows.mapInArrow(run, f"id long, {more}, x binary")


@dataclass
class ForestModel:
    settings: RandomForestClassifier
    rows: DataFrame  # (id, y, x) of the training rows
    edges: list[np.ndarray]
    classes: int
    tops: Tops

    def split_large_nodes(self) -> None:
        """Split nodes above ``LOCAL_WEIGHT`` by histograms, level by level; the driver holds a split for each of them."""
        s, d, classes = self.settings, len(self.edges), self.classes
        weight = self._root_weights()
        large = [(t, 1) for t in range(s.trees) if weight[t] > LOCAL_WEIGHT]
        while large:
            below = []
            for at in range(0, len(large), HISTOGRAM_NODES):
                part = large[at : at + HISTOGRAM_NODES]
                found = {(r["tree"], r["node"]): r for r in _histogram_splits(self.rows, self.tops, part, classes, d, s).collect()}
                for tree, node in part:
                    r = found[tree, node]
                    counts = np.array(r["counts"])
                    if r["feature"] < 0:
                        self.tops.leaves[tree][node] = counts
                        continue
                    self.tops.splits[tree][node] = (r["feature"], r["edge"])
                    left = np.array(r["left"])
                    for child, c in zip(_children(node), (left, counts - left)):
                        if c.sum() > LOCAL_WEIGHT:
                            if (c > 0).sum() > 1 and child.bit_length() - 1 < s.depth:
                                below.append((tree, child))
                            else:
                                self.tops.leaves[tree][child] = c
            large = below

    def _root_weights(self) -> list[int]:
        s = self.settings

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(s.trees, np.int64)
            for batch in batches:
                ids = batch.column(0).to_numpy()
                total += np.array([bootstrap(ids, t, s.seed).sum() for t in range(s.trees)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(s.trees)), pa.array(total)], names=["tree", "w"])

        found = self.rows.select("id").mapInArrow(run, "tree long, w long").groupBy("tree").agg(F.sum("w").alias("w")).collect()
        weight = {r["tree"]: r["w"] for r in found}
        return [weight.get(t, 0) for t in range(s.trees)]

    def transform(self, test: DataFrame) -> DataFrame:
        """``test`` with ``prediction``, the class with the largest sum of shares; ties go to the smaller class."""
        s = self.settings
        rows = materialize(test.withColumn("__row", F.monotonically_increasing_id()), "test")
        asked = _binned(rows.select(F.col("__row").alias("id"), F.lit(0.0).alias("y"), vector_to_array(s.features).alias("x")), self.edges, "y double")
        votes = self._votes(materialize(asked, "asked")).groupBy("id", "class").agg(F.sum("share").alias("share"))
        best = votes.groupBy("id").agg(F.max(F.struct("share", (-F.col("class")).alias("last"))).alias("b"))
        best = best.select(F.col("id").alias("__row"), (-F.col("b.last")).cast("double").alias("prediction"))
        return rows.join(best, "__row").drop("__row")

    def _votes(self, asked: DataFrame) -> DataFrame:
        s, d, classes, tops = self.settings, len(self.edges), self.classes, self.tops
        spark = asked.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)

        def dealt(training: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for whole in batches:
                    for s0 in range(0, whole.num_rows, EMIT_ROWS):
                        batch = whole.slice(s0, EMIT_ROWS)
                        ids, x = batch.column(0).to_numpy(), _bins(batch.column(2), d)
                        for t in range(s.trees):
                            w = bootstrap(ids, t, s.seed) if training else np.ones(len(ids), np.int64)
                            node = tops.route(t, x)
                            keep = w > 0
                            if training and tops.leaves[t]:
                                keep &= ~np.isin(node, list(tops.leaves[t]))
                            i = pa.array(np.flatnonzero(keep))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(i), t)), pa.array(node[keep]), batch.column(0).take(i), batch.column(1).take(i), batch.column(2).take(i), pa.array(w[keep])],
                                names=["tree", "node", "id", "y", "x", "w"],
                            )

            return run

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            share = np.zeros((0, classes))
            if right.num_rows:
                t, node = right.column("tree")[0].as_py(), right.column("node")[0].as_py()
                if node in tops.leaves[t]:
                    share = np.tile(tops.leaves[t][node] / tops.leaves[t][node].sum(), (right.num_rows, 1))
                elif left.num_rows:
                    order = np.argsort(left.column("id").to_numpy())
                    x, y, w = _bins(left.column("x"), d)[order], left.column("y").to_numpy()[order].astype(np.int64), left.column("w").to_numpy()[order]
                    share = grow(x, y, w, _bins(right.column("x"), d), classes, node, s.depth, t, s.seed)
            q, c = np.nonzero(share)
            return pa.table([right.column("id").take(pa.array(q)), pa.array(c), pa.array(np.rint(share[q, c] * SHARE).astype(np.int64))], names=["id", "class", "share"])

        schema = "tree long, node long, id long, y double, x binary, w long"
        sides = [t.mapInArrow(dealt(training), schema).repartition(n, "tree", "node") for t, training in ((self.rows, True), (asked, False))]
        return sides[0].groupBy("tree", "node").cogroup(sides[1].groupBy("tree", "node")).applyInArrow(answer, "id long, class long, share long")


def _histogram_splits(rows: DataFrame, tops: Tops, large: list[tuple[int, int]], classes: int, d: int, s: RandomForestClassifier) -> DataFrame:
    """The best split of every large node from counts per (node, drawn feature, bin, class) of all tasks."""
    by_tree: dict[int, list[int]] = {}
    for tree, node in large:
        by_tree.setdefault(tree, []).append(node)
    slots = drawn_features(s.seed, 0, np.array([1]), d).shape[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {t: np.zeros((len(nodes), slots, MAX_BINS, classes), np.int32) for t, nodes in by_tree.items()}
        for batch in batches:
            ids, x, y = batch.column(0).to_numpy(), _bins(batch.column(2), d), batch.column(1).to_numpy().astype(np.int64)
            for t, nodes in by_tree.items():
                names = np.sort(np.array(nodes))
                at = tops.route(t, x)
                own = np.clip(np.searchsorted(names, at), 0, len(names) - 1)
                w = bootstrap(ids, t, s.seed)
                i = np.flatnonzero((names[own] == at) & (w > 0))
                drawn = drawn_features(s.seed, t, names, d)
                for slot in range(slots):
                    spot = (own[i] * MAX_BINS + x[i, drawn[own[i], slot]]) * classes + y[i]
                    held[t][:, slot] += np.bincount(spot, w[i], len(names) * MAX_BINS * classes).reshape(len(names), MAX_BINS, classes).astype(np.int32)
        for t, nodes in by_tree.items():
            blobs = pa.array([h.tobytes() for h in held[t]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), t)), pa.array(np.sort(np.array(nodes))), blobs], names=["tree", "node", "h"])

    def choose(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        total = np.zeros((slots, MAX_BINS, classes), np.int64)
        for blob in table.column("h"):
            total += np.frombuffer(blob.as_py(), np.int32).reshape(total.shape)
        counts = total[0].sum(axis=0)
        left = np.cumsum(total, axis=1).astype(float)
        gain = _purity(left) + _purity(counts - left) - _purity(counts.astype(float))
        gain[(left.sum(axis=2) == 0) | (left.sum(axis=2) == counts.sum())] = 0.0
        slot, edge = np.unravel_index(gain.argmax(), gain.shape)
        feature = int(drawn_features(s.seed, tree, np.array([node]), d)[0, slot]) if gain[slot, edge] > 1e-9 else -1
        return pa.table({"tree": [tree], "node": [node], "feature": [feature], "edge": [int(edge)], "counts": [counts.tolist()], "left": [left[slot, edge].astype(np.int64).tolist()]})

    return rows.mapInArrow(count, "tree long, node long, h binary").groupBy("tree", "node").applyInArrow(
        choose, "tree long, node long, feature long, edge long, counts array<long>, left array<long>"
    )
