"""Exact nearest neighbours between two tables by a metric partition.

Pivots are chosen farthest-first on a bounded sample. Every base row goes to its
nearest pivot's ball and, sorted by its distance to the pivot, to a ring of at
most ``block_rows`` rows, so a ball of any size (copies included) is cut into
bounded blocks. For a query the triangle inequality bounds its distance to all
rows of a ring from its distance to the pivot, and the distances to two pivots
bound those to all rows of a ball. First a query is compared with the rings
around its own place, which gives the distance to beat; then only with rings
whose bound is not above it.

Where the data has no structure (all distances about alike, as between random
directions in many dimensions) no bound can spare a block; the work is then
that of all pairs, done as matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.counting import LEAF_POINTS, neighbour_sums
from assaylake.operators.ordered import with_global_index
from assaylake.session import materialize

BLOCK_ROWS = 2000
QUERY_ROWS = 20_000  # queries that meet one block in one task
PIVOTS, SAMPLE_ROWS, MAX_BLOCKS = 256, 8192, 1 << 20
SLACK = 1e-9  # relative; bounds are widened by it, so rounding never drops a neighbour


def _vectors(df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """(id, x): rows with a null or NaN feature have no place and no neighbours."""
    rows = df.select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    return rows.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product around the middle of ``y``; exact to about 1e-15 of the squared norms."""
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T), 0.0)


def farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample, each as far as possible from those before it; fewer if the sample has fewer distinct rows."""
    chosen = [0]
    gap = squared(sample, sample[:1])[:, 0]
    while len(chosen) < count:
        at = int(gap.argmax())
        if gap[at] <= 0:
            break
        chosen.append(at)
        gap = np.minimum(gap, ((sample - sample[at]) ** 2).sum(axis=1))
    return sample[chosen]


@dataclass(frozen=True)
class Partition:
    """The base table in blocks, and what bounds need: pivots, and per block its ball, distances to the pivot and rows."""

    rows: DataFrame  # (id, x, block)
    pivots: np.ndarray
    ball: np.ndarray  # per block, ascending; rings of a ball ascend by distance
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray

    def __post_init__(self) -> None:
        object.__setattr__(self, "first", np.searchsorted(self.ball, np.arange(len(self.pivots) + 1)))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(squared(x, self.pivots))

    def bounds(self) -> Partition:
        """Without the table, to be sent to tasks."""
        return Partition(None, self.pivots, self.ball, self.low, self.high, self.size)

    def around(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, block): rings next to the place of every query that hold ``k`` rows together."""
        to = self.distances(x)
        filled = np.flatnonzero(np.diff(self.first))
        home = filled[to[:, filled].argmin(axis=1)]
        own = to[np.arange(len(x)), home]
        rows, blocks = [], []
        for b in np.unique(home):
            here = np.flatnonzero(home == b)
            a, z = int(self.first[b]), int(self.first[b + 1])
            ring = np.clip(a + np.searchsorted(self.low[a:z], own[here], "right") - 1, a, z - 1)
            left, right = np.maximum(ring - 1, a), np.minimum(ring + 1, z - 1)
            total = np.concatenate([[0], np.cumsum(self.size[a:z])])
            while ((total[right + 1 - a] - total[left - a] < k) & ((left > a) | (right < z - 1))).any():
                short = total[right + 1 - a] - total[left - a] < k
                left, right = np.where(short, np.maximum(left - 1, a), left), np.where(short, np.minimum(right + 1, z - 1), right)
            reach = right - left + 1
            rows.append(np.repeat(here, reach))
            blocks.append(np.repeat(left, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach))
            if total[-1] < k:  # a ball with too few rows: further balls, the nearest first
                for q in here:
                    held = int(total[-1])
                    for other in filled[np.argsort(to[q, filled])]:
                        if held >= k:
                            break
                        if other != b:
                            more = np.arange(self.first[other], self.first[other + 1])
                            rows.append(np.full(len(more), q))
                            blocks.append(more)
                            held += int(self.size[more].sum())
        return np.concatenate(rows), np.concatenate(blocks)

    def within(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, block): all blocks that may hold a row within ``radius`` of the query."""
        to = self.distances(x)
        scale = np.abs(x).max(initial=0.0) + np.abs(self.pivots).max(initial=0.0) + self.high.max(initial=0.0)
        radius = radius * (1 + SLACK) + SLACK * scale * x.shape[1]
        nearest = to.min(axis=1)
        rows, blocks = [], []
        for b in np.flatnonzero(np.diff(self.first)):
            a, z = int(self.first[b]), int(self.first[b + 1])
            here = np.flatnonzero((to[:, b] - nearest) / 2 <= radius)
            left = a + np.searchsorted(self.high[a:z], to[here, b] - radius[here], "left")
            right = a + np.searchsorted(self.low[a:z], to[here, b] + radius[here], "right")
            reach = np.maximum(right - left, 0)
            rows.append(np.repeat(here, reach))
            blocks.append(np.repeat(left, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach))
        return np.concatenate(rows), np.concatenate(blocks)


def partition(base: DataFrame, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> Partition:
    """Cut (id, x) rows into balls and rings; at most ``MAX_BLOCKS`` blocks, which the driver knows by four numbers each."""
    base = materialize(base, "base")
    total = base.count()
    if not total:
        return Partition(base.withColumn("block", F.lit(0).cast("long")), np.zeros((0, 0)), *[np.zeros(0, t) for t in (np.int64, float, float, np.int64)])
    block_rows = max(block_rows, -(-total // MAX_BLOCKS))
    share = min(1.0, 2 * SAMPLE_ROWS / total)
    picked = base.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else base
    sample = _matrix(picked.select("x").limit(SAMPLE_ROWS).toArrow().column(0))
    if not len(sample):
        sample = _matrix(base.select("x").limit(SAMPLE_ROWS).toArrow().column(0))
    points = farthest_first(sample, max(1, min(pivots, total // block_rows + 1, len(sample))))
    kind = base.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = squared(_matrix(batch.column(1)), points) if batch.num_rows else np.zeros((0, 1))
            ball = d.argmin(axis=1)
            own = np.sqrt(d[np.arange(len(d)), ball])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball), pa.array(own)], names=["id", "x", "ball", "own"])

    placed = with_global_index(base.mapInArrow(assign, f"id {kind}, x array<double>, ball long, own double"), ["ball", "own", "id"], "pos")
    firsts = placed.groupBy("ball").agg(F.min("pos").alias("first"))  # at most ``pivots`` rows
    ringed = placed.join(F.broadcast(firsts), "ball").withColumn("ring", F.floor((F.col("pos") - F.col("first")) / block_rows))
    blocks = ringed.groupBy("ball", "ring").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count(F.lit(1)).alias("n")).toPandas().sort_values(["ball", "ring"])
    ahead = np.concatenate([[0], np.cumsum(np.bincount(blocks["ball"], minlength=len(points)))])
    number = F.element_at(F.array(*[F.lit(int(v)) for v in ahead[:-1]]), (F.col("ball") + 1).cast("int")) + F.col("ring")
    rows = materialize(ringed.select("id", "x", number.cast("long").alias("block")), "blocks")
    return Partition(rows, points, *[blocks[c].to_numpy() for c in ("ball", "low", "high", "n")])


def visits(queries: DataFrame, parts: Partition, find) -> DataFrame:
    """Every query with its columns, once per ``block`` that ``find(bounds, x, batch)`` names."""
    bounds = parts.bounds()
    shared = queries.sparkSession.sparkContext.broadcast(bounds)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema) + ", block long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                q, block = find(shared.value, _matrix(batch.column(1)), batch)
                for s in range(0, len(q), 1 << 16):
                    taken = batch.take(pa.array(q[s : s + (1 << 16)]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(block[s : s + (1 << 16)].astype(np.int64))], names=[*batch.schema.names, "block"])

    return queries.mapInArrow(run, schema)


def _met(visiting: DataFrame, parts: Partition, queries: int, run, schema: str) -> DataFrame:
    """``run(queries, rows)`` for the queries that visit a block and its rows.

    A block that more than ``QUERY_ROWS`` queries visit meets them in crowds of
    about that size, and its rows are sent once per crowd. One number per block
    (at most ``MAX_BLOCKS``) tells how many crowds there are.
    """
    rows = parts.rows.select(F.col("id").alias("base_id"), F.col("x").alias("y"), "block")
    if queries <= QUERY_ROWS:
        return visiting.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run, schema)
    crowds = F.broadcast(materialize(visiting.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("crowds")), "crowds"))
    left = visiting.join(crowds, "block").withColumn("crowd", F.pmod(F.xxhash64("id", F.lit(3)), "crowds")).drop("crowds")
    right = rows.join(crowds, "block").withColumn("crowd", F.explode(F.sequence(F.lit(0).cast("long"), F.col("crowds") - 1))).drop("crowds")
    return left.groupBy("block", "crowd").cogroup(right.groupBy("block", "crowd")).applyInArrow(run, schema)


def best(x: np.ndarray, y: np.ndarray, k: int, chunk: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, distance) of each query's ``k`` nearest rows (all ties at the end included), chunk by chunk.

    Matrix products choose, differences measure: whatever rounding could have put
    among the ``k`` is measured.
    """
    take = min(k, len(y))
    norms = (y * y).sum(axis=1).max(initial=0.0)
    step = max(1, chunk // max(len(y), 1))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        d2 = squared(part, y)
        edge = np.partition(d2, take - 1, axis=1)[:, take - 1]
        slack = 1e-12 * ((part * part).sum(axis=1) + norms) + SLACK * edge
        q, r = np.nonzero(d2 <= (edge + slack)[:, None])
        d = np.empty(len(q))
        for t in range(0, len(q), 1 << 16):
            d[t : t + (1 << 16)] = np.sqrt(((part[q[t : t + (1 << 16)]] - y[r[t : t + (1 << 16)]]) ** 2).sum(axis=1))
        yield q + s, r, d


def nearest(
    queries: DataFrame, base: DataFrame, features: Sequence[str], query_key: str, base_key: str, k: int = 1, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, rank, base_id, distance) of the ``k`` nearest base rows of every query row.

    Ties go to the smaller base key. Rows with a null or NaN feature are left out on both sides.
    """
    asked = materialize(_vectors(queries, features, query_key), "queries")
    parts = partition(_vectors(base, features, base_key), block_rows)
    kinds = [t.schema["id"].dataType.simpleString() for t in (asked, parts.rows)]
    schema = f"id {kinds[0]}, d double, base_id {kinds[1]}"
    if not len(parts.size):
        return asked.sparkSession.createDataFrame([], f"query_id {kinds[0]}, rank int, base_id {kinds[1]}, distance double")
    total = asked.count()

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table([left.column("id").slice(0, 0), pa.array([], pa.float64()), right.column("base_id").slice(0, 0)], names=["id", "d", "base_id"])
        if not left.num_rows or not right.num_rows:
            return empty
        x, y = _matrix(left.column("x")), _matrix(right.column("y"))
        rank = right.column("base_id").combine_chunks() if isinstance(right.column("base_id"), pa.ChunkedArray) else right.column("base_id")
        order = np.empty(len(y), np.int64)
        order[pc.sort_indices(rank).to_numpy()] = np.arange(len(y))
        qs, rs, ds = [], [], []
        for q, r, d in best(x, y, k):
            sort = np.lexsort((order[r], d, q))
            q, r, d = q[sort], r[sort], d[sort]
            start = np.flatnonzero(np.diff(q, prepend=-1))
            keep = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q))) < k
            qs.append(q[keep])
            rs.append(r[keep])
            ds.append(d[keep])
        return pa.table([left.column("id").take(pa.array(np.concatenate(qs))), pa.array(np.concatenate(ds)), right.column("base_id").take(pa.array(np.concatenate(rs)))], names=["id", "d", "base_id"])

    place = Window.partitionBy("id").orderBy("d", "base_id")
    top = lambda t: t.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    if len(parts.size) > 1:
        first = _met(visits(asked, parts, lambda b, x, _: b.around(x, k)), parts, total, search, schema)
        # The k-th distance so far is the one to beat; a query that met fewer rows has none.
        far = top(first).groupBy("id").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("met"))
        limited = asked.join(far, "id", "left").select("id", "x", F.when(F.col("met") >= k, F.col("far")).otherwise(float("inf")).alias("far"))
        limited = materialize(limited, "limits")
        visiting = visits(limited, parts, lambda b, x, batch: b.within(x, batch.column(2).to_numpy())).drop("far")
    else:
        visiting = asked.withColumn("block", F.lit(0).cast("long"))
    found = top(_met(visiting, parts, total, search, schema))
    return found.select(F.col("id").alias("query_id"), "rank", "base_id", F.col("d").alias("distance"))


def block_share(queries: DataFrame, base: DataFrame, features: Sequence[str], query_key: str, base_key: str, radius: float, block_rows: int = BLOCK_ROWS) -> float:
    """Share of all (query, block) pairs that the bounds leave for a search radius; 1 where they spare nothing."""
    asked = _vectors(queries, features, query_key)
    parts = partition(_vectors(base, features, base_key), block_rows)
    left = visits(asked, parts, lambda b, x, _: b.within(x, np.full(len(x), radius))).count()
    return left / max(1, asked.count() * len(parts.size))


def neighbour_counts(df: DataFrame, features: Sequence[str], key: str, eps: float, out: str = "neighbours", block_rows: int = LEAF_POINTS) -> DataFrame:
    """(key, out): rows within ``eps`` of every row, itself included; 0 for rows with a null or NaN feature."""
    rows = materialize(_vectors(df, features, key).withColumn("x", F.transform("x", lambda v: v + 0.0)), "rows")
    points = materialize(rows.groupBy("x").agg(F.count(F.lit(1)).alias("w")), "points")
    found = rows.join(neighbour_sums(points, len(features), eps, block_rows), "x").groupBy("id").agg(F.sum("n").alias(out))
    return df.select(key).join(found.withColumnRenamed("id", key), key, "left").select(key, F.coalesce(out, F.lit(0)).alias(out))


def classify_nearest(test: DataFrame, train: DataFrame, features: Sequence[str], key: str, label: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Label of the single nearest training row."""
    hit = nearest(test, train, features, key, key, 1, block_rows).select(F.col("query_id").alias(key), F.col("base_id").alias("__b"), "distance")
    labels = train.select(F.col(key).alias("__b"), F.col(label).alias("prediction"))
    return test.select(key, label).join(hit, key).join(labels, "__b").select(key, label, "prediction", "distance")


def k_distance(df: DataFrame, features: Sequence[str], key: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distance of every row to its k-th nearest row, itself counted."""
    return nearest(df, df, features, key, key, k, block_rows).where(F.col("rank") == k).select(F.col("query_id").alias(key), F.col("distance").alias("k_distance"))
