"""Best-fit packing with certificates: pieces of documents into sequences of a fixed capacity.

1. ``tokenise`` cuts every document (its ids and one closing id) into pieces of
   at most ``capacity``; only the first piece of a longer document is shorter.
2. ``pack`` deals the pieces (ids and lengths only, never tokens) to partitions
   of about ``per_partition`` and runs best-fit decreasing in each. The largest
   lower bound over families of dual-feasible functions certifies the number of
   bins of a partition: one that meets its bound leaves, all but its emptiest bin.
3. All other bins with any gap are opened: their pieces are exchanged between
   partitions and packed again with best-fit decreasing, until the total meets the
   bound of the whole table or stops falling.

Special cases: a null or empty text is one piece that holds the closing id. An
empty table gives an empty result. Repeated documents (also repeated ids) are
packed one by one. Ties of equal lengths go in the order of arrival; any of these
placements is a right result. Other columns
of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.blocks import give_back
from assaylake.llm.frames import written
from assaylake.llm.tokens import encoder


def tokenise(docs: DataFrame, path: str, *, capacity: int = 2048, closing: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32): one row per piece; the ids themselves do not leave the task."""
    key_type = docs.schema[key].dataType.simpleString()
    end = np.array([closing], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(encode(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    cut = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                    for p in range(len(cut) - 1):
                        row.append(k)
                        piece.append(p)
                        start.append(cut[p])
                        length.append(cut[p + 1] - cut[p])
                        crc.append(zlib.crc32(ids[4 * cut[p] : 4 * cut[p + 1]]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[key, "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {key_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Fewest bins any packing can have, by dual-feasible functions; ``histogram[w]`` counts pieces of length w.

    Two families: f(x) = 1 above 1 - t, x between t and 1 - t, 0 below t, for
    every threshold t; and the rounding functions u_k(x) = x where (k + 1) x is
    whole, else floor((k + 1) x) / k. Sums stay in whole numbers.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    count = histogram.astype(np.int64)
    weight = np.concatenate([[0], np.cumsum(count * size)])
    number = np.concatenate([[0], np.cumsum(count)])
    t = np.arange(0, capacity // 2 + 1)
    full = number[capacity + 1] - number[capacity - t + 1]
    middle = weight[capacity - t + 1] - weight[t]
    best = int((full + -(-middle // capacity)).max())
    for k in range(1, 51):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        value = np.where(whole, k * size, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece: longest first, each into the fullest bin that takes it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_gap: dict[int, list[int]] = {}
    gaps, n = 0, 0  # bit g of gaps: some bin has g free places
    for at in np.argsort(-lengths, kind="stable").tolist():
        w = int(lengths[at])
        fit = gaps >> w
        if fit:
            gap = w + (fit & -fit).bit_length() - 1
            stack = by_gap[gap]
            b = stack.pop()
            if not stack:
                gaps ^= 1 << gap
        else:
            gap, b, n = capacity, n, n + 1
        bins[at], offsets[at] = b, capacity - gap
        left = gap - w
        if left:
            by_gap.setdefault(left, []).append(b)
            gaps |= 1 << left
    return bins, offsets


def _round(pieces: DataFrame, key: str, capacity: int, parts: int, number: int) -> DataFrame:
    """One round of dealing and best-fit decreasing; adds sequence_id, offset and open.

    Rows are dealt by their place in the (written) table, so neither null ids nor
    copies of one id meet in one group. ``open`` marks the bins that take part in
    the next exchange: in a partition above its bound all bins with a gap, in a
    certified one only the emptiest, because no packing of its own pieces needs
    fewer bins and that one can only be saved with pieces from elsewhere.
    """
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(number)), F.lit(parts))
    columns = pieces.columns
    names = [*columns, "sequence_id", "offset", "open"]

    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        open_ = takes_part(lengths, bins, capacity)
        part = group.column("part")[0].as_py()
        ids = (np.int64(number) << np.int64(56)) + (np.int64(part) << np.int64(24)) + bins
        return pa.table([*[group.column(c) for c in columns], pa.array(ids), pa.array(offsets), pa.array(open_[bins])], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint, open boolean"
    return pieces.withColumn("part", deal).groupBy("part").applyInArrow(run, schema)


def takes_part(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Which bins of a partition go into the next exchange, by its certificate and their gaps."""
    gap = capacity - np.bincount(bins, weights=lengths).astype(np.int64)
    open_ = gap > 0
    if len(gap) <= lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity):
        open_ &= np.arange(len(gap)) == gap.argmax()
    return open_


def bound(pieces: DataFrame, capacity: int) -> int:
    """Lower bound for the whole table, from at most ``capacity`` counters."""
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    return lower_bound(histogram, capacity)


def pack(pieces: DataFrame, *, key: str = "doc_id", capacity: int = 2048, per_partition: int = 4000) -> DataFrame:
    """Adds sequence_id and offset to a written table with a ``length`` column.

    Rounds go on until the total meets the bound of the whole table or stops
    falling; a round whose result has no fewer bins than it opened is thrown away.
    """
    total = pieces.count()
    least = bound(pieces, capacity)
    columns = pieces.columns
    done: list[DataFrame] = []
    current = written(_round(pieces, key, capacity, max(1, -(-total // per_partition)), 0), "packed")
    closed, number = 0, 0
    while number < 127:  # the round's number has seven bits in a sequence id; every round saves a bin or ends the work
        number += 1
        size = current.agg(F.count_distinct(F.when(F.col("open"), F.col("sequence_id"))).alias("open"), F.count_distinct("sequence_id").alias("bins"), F.count(F.when(F.col("open"), 1)).alias("rows")).first()
        if size["open"] < 2 or closed + size["bins"] <= least:
            break
        again = written(_round(written(current.where("open").select(*columns), "opened"), key, capacity, max(1, -(-size["rows"] // per_partition)), number), "packed")
        if again.select("sequence_id").distinct().count() >= size["open"]:
            break
        done.append(current.where(~F.col("open")))
        closed += size["bins"] - size["open"]
        current = again
    out = current
    for part in done:
        out = out.unionByName(part)
    return out.drop("open")
