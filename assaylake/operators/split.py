"""Repeatable train/test splits and folds.

Random splits rank rows by ``md5(seed|key)``. The rank itself is never
computed: the hash at the cut is found by counting hash prefixes, and each row
then compares itself with the cut. That gives exact sizes with no shuffle of
rows, the same result on any cluster, and the same result in plain SQL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.operators.ordered import rank_in_group, with_global_index
from assaylake.operators.quantiles import _select, exact_quantiles
from assaylake.session import materialize

PREFIX = 3  # hex digits counted per pass: 4096 counters per stratum
HASH_DIGITS = 32
LEAVES = 4096  # hashes brought to the driver to end a search


def row_hash(key: Sequence[str], seed: int | str = 42) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


Sizes = dict[object, int]


def hash_at_ranks(
    df: DataFrame, h: Column, ranks: Callable[[Sizes], list[tuple[object, int]]], by: Column | None = None
) -> dict[tuple[object, int], str]:
    """The hash at 0-based ranks inside strata (one stratum ``None`` without ``by``).

    ``ranks`` names the (stratum, rank) pairs once the stratum sizes are known;
    they come from the first counting pass, so no separate count is needed.
    Raises if rows of one hash lie on both sides of a cut: the key is not unique.
    """
    data = df.select(h.alias("h"), (by if by is not None else F.lit(None).cast("int")).alias("g"))
    tag = lambda depth: F.concat_ws("|", F.col("g").cast("string"), F.substring("h", 1, depth))
    name = lambda g, p: p if g is None else f"{g}|{p}"
    state: dict[tuple, tuple[str, int]] | None = None
    found: dict[tuple, str] = {}
    depth = 0
    while state is None or state:
        scope = data if not depth else data.where(tag(depth).isin(*sorted({name(w[0], p) for w, (p, _) in state.items()})))
        depth += PREFIX
        counts = scope.groupBy("g", F.substring("h", 1, depth).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        if state is None:
            sizes: Sizes = {}
            for r in counts:
                sizes[r["g"]] = sizes.get(r["g"], 0) + r["n"]
            state = {w: ("", w[1]) for w in ranks(sizes)}
        table: dict[tuple, list] = {}
        for r in sorted(counts, key=lambda r: r["p"]):
            table.setdefault((r["g"], r["p"][: depth - PREFIX]), []).append((r["p"], r["n"]))
        leaves = {}
        for w, (p, k) in list(state.items()):
            for q, n in table[(w[0], p)]:
                if k < n:
                    state[w] = (q, k)
                    if n <= LEAVES:
                        leaves[w] = (q, k)
                    elif depth >= HASH_DIGITS:  # more equal hashes than leaves
                        if k < n - 1:
                            raise ValueError("the key of a split must be unique: equal keys lie on both sides of the cut")
                        found[w] = q
                        del state[w]
                    break
                k -= n
        if leaves:
            rows = data.where(tag(depth).isin(*sorted({name(w[0], q) for w, (q, _) in leaves.items()}))).collect()
            groups: dict[tuple, list[str]] = {}
            for r in rows:
                groups.setdefault((r["g"], r["h"][:depth]), []).append(r["h"])
            for w, (q, k) in leaves.items():
                hashes = sorted(groups[(w[0], q)])
                if k + 1 < len(hashes) and hashes[k + 1] == hashes[k]:
                    raise ValueError("the key of a split must be unique: equal keys lie on both sides of the cut")
                found[w] = hashes[k]
                del state[w]
    return found


def stratum_cuts(df: DataFrame, key: Sequence[str], by: str, wanted: Column, seed: int = 42) -> DataFrame:
    """(by, __cut): the hash of the last row taken in every stratum, for any number of strata.

    ``wanted`` says, from the column ``size``, how many rows of a stratum are
    taken; strata that give none are absent. Only hashes are sorted, in ranges,
    so a stratum may hold any share of the rows. Null is a stratum. Raises if
    equal keys lie on both sides of a cut.
    """
    hashes = df.select(F.col(by).alias(by), row_hash(key, seed).alias("__h"))
    placed = rank_in_group(hashes, [by], ["__h"]).withColumn("__take", wanted.cast("long"))
    edge = materialize(placed.where(F.col("rank").between(F.col("__take"), F.col("__take") + 1) & (F.col("__take") > 0)).select(by, "__h", "rank", "__take"), "cuts")
    if edge.groupBy(by, "__h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("the key of a split must be unique: equal keys lie on both sides of the cut")
    return edge.where(F.col("rank") == F.col("__take")).select(by, F.col("__h").alias("__cut"))


def random_split(df: DataFrame, key: Sequence[str], test_size: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """Exactly ceil(n * test_size) test rows."""
    h = row_hash(key, seed)

    def last_test(sizes: Sizes) -> list[tuple[object, int]]:
        n_test = math.ceil(sum(sizes.values()) * test_size - 1e-9)
        return [(None, n_test - 1)] if n_test else []

    cut = list(hash_at_ranks(df, h, last_test).values())
    return df.withColumn(out, F.when(h <= F.lit(cut[0]), "test").otherwise("train") if cut else F.lit("train"))


def quantile_bins(df: DataFrame, target: str, n_bins: int) -> Column:
    """Bin number by quantile edges; equal edges merge, as intervals open on the left."""
    q = exact_quantiles(df, [target], [i / n_bins for i in range(n_bins + 1)])[target]
    inner = sorted(set(q))[1:-1]
    out = F.lit(0)
    for e in inner:
        out = out + (F.col(target) > F.lit(e)).cast("int")
    return out


def stratified_split(
    df: DataFrame, key: Sequence[str], target: str, test_size: float = 0.2, n_bins: int = 5, seed: int = 42, out: str = "split"
) -> DataFrame:
    """Random split with ceil(n_bin * test_size) test rows in every quantile bin."""
    bins = quantile_bins(df, target, n_bins)
    h = row_hash(key, seed)

    def last_tests(sizes: Sizes) -> list[tuple[object, int]]:
        ends = [(b, math.ceil(n * test_size - 1e-9) - 1) for b, n in sizes.items()]
        return [(b, k) for b, k in ends if k >= 0]

    test = F.lit(False)
    for (b, _), cut in hash_at_ranks(df, h, last_tests, by=bins).items():
        test = test | ((F.col("bin") == F.lit(b)) & (h <= F.lit(cut)))
    return df.withColumn("bin", bins).withColumn(out, F.when(test, "test").otherwise("train"))


def kfold(df: DataFrame, key: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Shuffled folds: consecutive blocks of the hash order, sizes differing by at most one."""
    h = row_hash(key, seed)

    def block_ends(sizes: Sizes) -> list[tuple[object, int]]:
        n = sum(sizes.values())
        folds = max(1, min(k, n))
        ends = np.cumsum([n // folds + (1 if i < n % folds else 0) for i in range(folds)])[:-1]
        return [(None, int(e) - 1) for e in ends]

    fold = F.lit(0)
    for cut in hash_at_ranks(df, h, block_ends).values():
        fold = fold + (h > F.lit(cut)).cast("int")
    return df.withColumn(out, fold)


def ordered_kfold(df: DataFrame, order: Sequence[str], k: int = 5, out: str = "fold") -> DataFrame:
    """Unshuffled folds: consecutive blocks of the row order."""
    n = df.count()
    big, rest = n // k + 1, n % k
    pos = F.col("__pos")
    fold = F.when(pos < big * rest, F.floor(pos / F.lit(big))).otherwise(
        F.lit(rest) + F.floor((pos - F.lit(big * rest)) / F.lit(max(n // k, 1)))
    )
    return with_global_index(df, order, "__pos").withColumn(out, fold.cast("int")).drop("__pos")


def row_at_rank(df: DataFrame, order: Sequence[str], k: int) -> list:
    """Values of ``order`` in the row at 0-based global rank ``k``."""
    found = []
    for c in order:
        n = df.count()
        v = _select(df.select(F.col(c).alias("v")), k, n)
        k -= df.where(F.col(c) < F.lit(v)).count()
        df = df.where(F.col(c) == F.lit(v))
        found.append(v)
    return found


def time_split(df: DataFrame, time: str, key: Sequence[str], test_size: float = 0.2, out: str = "split") -> DataFrame:
    """The first int(n * (1 - test_size)) rows by time are the training set."""
    micros = df.withColumn("__t", F.unix_micros(F.col(time).cast("timestamp")))
    n_train = int(df.count() * (1 - test_size))
    if n_train == 0:
        return df.withColumn(out, F.lit("test"))
    order = ["__t", *key]
    last = row_at_rank(micros.select(*order), order, n_train - 1)
    train = F.lit(True)
    for c, v in reversed(list(zip(order, last))):
        train = (F.col(c) < F.lit(v)) | ((F.col(c) == F.lit(v)) & train)
    return micros.withColumn(out, F.when(train, "train").otherwise("test")).drop("__t")


def endpoints_split(df: DataFrame, target: str, key: Sequence[str], ratio: int = 3, out: str = "split") -> DataFrame:
    """Smallest and largest target in test; of the others every ``ratio``-th in sorted order."""
    n = df.count()
    top = df.agg(F.max(target).alias("y")).first()["y"]
    max_pos = n - df.where(F.col(target) == F.lit(top)).count()  # first row of the largest value
    pos = F.col("__pos")
    i = pos - 1 - (pos > F.lit(max_pos)).cast("long")
    forced = (pos == 0) | (pos == F.lit(max_pos))
    test = forced | (F.pmod(i, F.lit(ratio)) == ratio - 1)
    return (
        with_global_index(df, [target, *key], "__pos")
        .withColumn(out, F.when(test, "test").otherwise("train"))
        .drop("__pos")
    )


def systematic_split(
    df: DataFrame, target: str, key: Sequence[str], step: int = 3, start: int = 2, stop_before_last: bool = True,
    include_last: bool = True, out: str = "split",
) -> DataFrame:
    """Every ``step``-th row by target from ``start``; optionally the last row as well."""
    n = df.count()
    end = n - 1 if stop_before_last else n
    pos = F.col("__pos")
    test = (pos >= start) & (pos < end) & (F.pmod(pos - start, F.lit(step)) == 0)
    if include_last:
        test = test | (pos == n - 1)
    return (
        with_global_index(df, [target, *key], "__pos")
        .withColumn(out, F.when(test, "test").otherwise("train"))
        .drop("__pos")
    )


def sorted_folds(df: DataFrame, target: str, key: Sequence[str], step: int = 5, out: str = "fold") -> DataFrame:
    """Fold = rank by target modulo ``step``."""
    return (
        with_global_index(df, [target, *key], "__pos")
        .withColumn(out, F.pmod("__pos", F.lit(step)).cast("int"))
        .drop("__pos")
    )


def predefined_split(df: DataFrame, members: DataFrame, key: Sequence[str], out: str = "split") -> DataFrame:
    """Rows listed in ``members`` are training rows, all others test rows."""
    listed = members.select(*key).distinct().withColumn("__in", F.lit(True))
    return df.join(listed, list(key), "left").withColumn(out, F.when(F.col("__in"), "train").otherwise("test")).drop("__in")
