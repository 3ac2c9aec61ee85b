"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.frames import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Input edges go from the larger id ``a`` to the smaller ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest id each node can reach, for all nodes of ``edges`` (columns a, b).

    Every round is two joins on the node, which adaptive execution can split for
    a node with very many edges, and is written. A component becomes a star in
    few rounds (logarithmic in its longest path).
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    current = written(edges, "edges")
    print_of = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    seen = print_of(current)
    for _ in range(max_rounds):
        if seen["n"] == 0:
            break
        current = written(_small_star(_large_star(current).distinct()), "edges")
        now = print_of(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return leaves.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
