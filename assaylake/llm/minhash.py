"""Near-duplicate documents with min-max hashing, confirmed on full shingle sets.

Every permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so a signature of 2 * permutations values costs half the hash
evaluations; both values estimate the similarity without bias. Bands of
values propose candidates; they are as long as they can be for a pair at the
threshold to share no band with a probability below 1e-6 (24 bands of 5 values
at 0.85, 30 bands of 4 at 0.8). A link counts only after the full sets are
compared.

Large buckets never turn into all their pairs. Equal sets are one node. Every
bucket names its most central member (the one that shares most bands with
others) as hub; all members are compared with the hub. Only members that are
not linked to it are compared with the other members, in blocks of bounded
size: one matrix product counts all intersections of a block, and the block
returns only the edges that join something.

Special cases: a text that is null or has no word has an empty set and is linked
with nothing. A text of fewer words than a shingle is one shingle. Rows that
repeat an id count as one document (linked with each other, through any of
their texts). A null id is linked with nothing: component_id is null, kept is
true. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.blocks import BLOCK_BYTES, SpanHash, blocks, fold_case, mix, signed, white_cuts, word_spans
from assaylake.llm.frames import written
from assaylake.llm.graph import components

PERMUTATIONS, SHINGLE, MISS = 60, 5, 1e-6


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text of a block, sorted inside each text, and the texts' bounds.

    A text of fewer than ``size`` words has its whole sequence as one shingle,
    one without words has none.
    """
    if len(offsets) == 2 and len(data) > 2 * BLOCK_BYTES:
        return _long_set(data, size)
    data = fold_case(data)
    starts, ends = word_spans(data, offsets)
    words = SpanHash(data, seed=3)(starts, ends)
    bounds = np.searchsorted(starts, offsets, "left")
    n_words = np.diff(bounds)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    out = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    first = bounds[:-1][doc] + np.arange(len(doc)) - out[:-1][doc]
    length = np.minimum(n_words, size)[doc]
    h = length.astype(np.uint64)
    for k in range(size):
        inside = k < length
        step = words[np.minimum(first + k, max(len(words) - 1, 0))] if len(words) else np.zeros(len(first), np.uint64)
        h = np.where(inside, mix(h * np.uint64(0x9E3779B97F4A7C15) + step), h)
    for a, b in zip(out[:-1].tolist(), out[1:].tolist()):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.searchsorted(doc[fresh], np.arange(len(n) + 1))


def _long_set(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of one long text: word hashes piece by piece, then distinct shingles of runs of words."""
    parts = []
    for a, b in white_cuts(data):
        piece = fold_case(data[a:b])
        parts.append(SpanHash(piece, seed=3)(*word_spans(piece, np.array([0, b - a]))))
    words = np.concatenate(parts)
    step, found = 1 << 17, []
    for at in range(0, max(len(words) - size + 1, 1), step):
        run = words[at : at + step + size - 1]
        n = len(run) - size + 1 if len(run) >= size else min(len(run), 1)
        h = np.full(n, min(size, len(run)), np.uint64)
        for k in range(min(size, len(run))):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + run[k : k + n])
        found.append(np.unique(h))
    items = np.unique(np.concatenate(found))
    return items, np.array([0, len(items)])


def signatures(h: np.ndarray, bounds: np.ndarray, permutations: int, seed: int = 11) -> np.ndarray:
    """(texts, 2 * permutations): minima first, then maxima; rows of empty sets stay 0."""
    out = np.zeros((len(bounds) - 1, 2 * permutations), np.uint64)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some) == 0:
        return out
    at = bounds[:-1][some]
    rng = np.random.default_rng(seed)
    for p, (a, b) in enumerate(zip(rng.integers(0, 1 << 64, permutations, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, permutations, np.uint64))):
        v = h * a + b
        v ^= v >> np.uint64(29)
        out[some, p] = np.minimum.reduceat(v, at)
        out[some, permutations + p] = np.maximum.reduceat(v, at)
    return out


def rows_for(percent: int, permutations: int) -> int:
    """Longest band for which a pair at the threshold is missed with a probability below ``MISS``."""
    fit = [r for r in range(1, 13) if (1 - (percent / 100) ** r) ** (2 * permutations // r) < MISS]
    return max(fit, default=1)


def bands_of(signature: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands): one hash per band of ``rows`` values, different for every band."""
    count = signature.shape[1] // rows
    out = np.zeros((len(signature), count), np.uint64)
    for band in range(count):
        h = np.full(len(signature), band + 1, np.uint64)
        for k in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ signature[:, band * rows + k])
        out[:, band] = h
    return out


def signature_table(docs: DataFrame, *, permutations: int = PERMUTATIONS, rows: int, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands) from (doc_id, text): one pass, no set leaves the task.

    set_a and set_b are sums of two mixes of all distinct shingle hashes: equal sets agree in 128 bits.
    """
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                h, bounds = shingle_sets(data, offsets, size)
                total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (mix(h), mix(h ^ np.uint64(0x5851F42D4C957F2D)))]
                sums = [signed(t[bounds[1:]] - t[bounds[:-1]]) for t in total]
                bands = bands_of(signatures(h, bounds, permutations), rows)
                flat = pa.array(signed(np.ascontiguousarray(bands)).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands.shape[1]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(np.diff(bounds)), *[pa.array(x) for x in sums], lists], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key_type}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def set_table(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, items): the full set of every document, sorted hashes."""
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                h, bounds = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed(h)))], names=["node", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, f"node {key_type}, items array<bigint>")


def hub_pairs(nodes: DataFrame) -> DataFrame:
    """(hub, node) pairs to compare, from (node, bands)."""
    rows = nodes.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = written(rows.join(shared, "band"), "buckets")
    central = members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("central"))
    ranked = members.join(central, "node").select("band", "node", "central")
    hubs = ranked.groupBy("band").agg(F.max_by("node", F.struct("central", "node")).alias("hub"))
    return members.select("band", "node").join(hubs, "band").where("node != hub").select("hub", "node").distinct()


def linked(left: str, right: str, percent: int):
    common = F.size(F.array_intersect(left, right))
    return 100 * common >= percent * (F.size(left) + F.size(right) - common)


def _join_edges(x: list[np.ndarray], y: list[np.ndarray], same: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning edges (index in y, index in x) between linked sets; ``same`` marks the x known to be connected."""
    nx, ny = len(x), len(y)
    sizes_x, sizes_y = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    items, column, times = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(nx + ny), np.concatenate([sizes_x, sizes_y]))
    useful = times[column] > 1
    row, column = row[useful], column[useful]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    common = np.zeros((ny, nx), np.float32)
    width = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((nx + ny, width), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        common += part[nx:] @ part[:nx].T
    found = 100 * common >= percent * (sizes_x[None, :] + sizes_y[:, None] - common)
    parent = list(range(nx + ny))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    attached = np.flatnonzero(same)
    for k in attached[1:]:
        parent[k] = int(attached[0])
    edges = []
    for i, j in zip(*np.nonzero(found)):
        a, b = root(nx + int(i)), root(int(j))
        if a != b:
            parent[a] = b
            edges.append((int(i), int(j)))
    return edges


def _rest(star: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Edges (a, b) between members of a hub that are not linked to it and all members of that hub."""
    size = star.groupBy("hub").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("u")).where("u > 0 and n > 1")
    rows = star.join(size, "hub")
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    place = F.xxhash64("node")
    as_x = rows.select("hub", "node", "linked", F.lit(False).alias("is_y"), F.explode(F.sequence(F.lit(0), parts("u") - 1)).alias("i"), F.pmod(place, parts("n")).cast("int").alias("j"))
    as_y = rows.where(~F.col("linked")).select("hub", "node", "linked", F.lit(True).alias("is_y"), F.pmod(place, parts("u")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), parts("n") - 1)).alias("j"))
    key_type = star.schema["node"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node = group.column("node").to_pylist()
        items = group.column("items").combine_chunks()
        bounds, flat = items.offsets.to_numpy(), items.values.to_numpy()
        take = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        is_y = group.column("is_y").to_numpy(zero_copy_only=False)
        x, y = np.flatnonzero(~is_y), np.flatnonzero(is_y)
        edges = []
        if len(x) and len(y):
            same = group.column("linked").to_numpy(zero_copy_only=False)[x]
            edges = _join_edges([take[k] for k in x], [take[k] for k in y], same, percent)
        type_ = group.schema.field("node").type
        return pa.table([pa.array([node[y[i]] for i, _ in edges], type_), pa.array([node[x[j]] for _, j in edges], type_)], names=["a", "b"])

    return as_x.unionByName(as_y).join(sets, "node").groupBy("hub", "i", "j").applyInArrow(run, f"a {key_type}, b {key_type}")


def near_duplicates(
    docs: DataFrame, *, text: str = "text", key: str = "doc_id", percent: int = 85, permutations: int = PERMUTATIONS, size: int = SHINGLE, block: int = 1024
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = rows_for(percent, permutations)
    signed_docs = written(signature_table(docs, permutations=permutations, rows=rows, size=size), "signatures")
    filled = signed_docs.where("n_shingles > 0 and doc_id is not null")
    nodes = written(filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "nodes")
    pairs = written(hub_pairs(nodes.select("node", "bands")), "pairs")
    wanted = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
    # Sort-merge at every size: texts and sets are dealt by id, nothing that grows with the input is broadcast.
    texts = docs.join(wanted.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left_semi")
    sets = written(set_table(texts.dropDuplicates(["doc_id", "text"]), size), "sets")
    star = written(
        pairs.join(sets.hint("merge"), "node").join(sets.select(F.col("node").alias("hub"), F.col("items").alias("hub_items")).hint("merge"), "hub")
        .groupBy("hub", "node").agg(F.max(linked("items", "hub_items", percent)).alias("linked")),
        "star",
    )
    edges = star.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b")).unionByName(_rest(star, sets, percent, block))
    labels = components(edges)
    named = signed_docs.drop("bands").join(nodes.drop("bands"), ["set_a", "set_b"], "left")
    return (
        named.join(labels, "node", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.coalesce("label", "node")), "doc_id")))
        .select(F.col("doc_id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
