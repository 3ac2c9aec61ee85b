"""Merkle manifest of a table: one hash tree per source, and one over the sources.

1. ``leaves`` hashes every row, and the row as a tampered copy would hold it.
2. Rows get their place inside their source (``positions.ranked``; a source may
   hold any share of the rows).
3. Per level, lag and lead columns of the fixed offsets 1 to 15, masked by the
   node's slot in its run and by the length of the run, supply the siblings; the
   row in slot 0 hashes itself and its masked leads to the parent. A level has a
   sixteenth of the rows of the one below, so the number of levels is the
   logarithm of the largest source. The roots of the sources are the nodes of
   one more tree.
4. Paths come down from the root: a node's path is its own siblings and its
   parent's path. Only the hashes of a level are written; siblings are formed
   again where they are used, in the partitioning that the join with the parents
   needs anyway.

Special cases: a null value is hashed as ``-``, so null and empty text differ. A
null source is a source of its own and comes first. Rows of one source with the
same id (null first) go by their leaf hash; rows equal in all hashed columns
have equal leaves and share a proof as a set. A row with a null id is never
tampered with. One row alone is its own root with an empty proof. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.frames import fold, written
from assaylake.llm.positions import ranked

ARITY = 16


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[Column]) -> Column:
    return sha256(F.concat(*[encoded(c) for c in columns]))


def leaves(docs: DataFrame, tampered: Column, *, key: str = "doc_id", source: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text") -> DataFrame:
    """(key, source, leaf, altered): the leaf, and where ``tampered`` holds the leaf of the row with its text in lower case."""
    plain = [F.col(c) for c in columns]
    changed = [fold(c) if c == text else F.col(c) for c in columns]
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), leaf_of(plain).alias("leaf"), F.when(tampered, leaf_of(changed)).alias("altered"))


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """Adds ``run``, ``slot``, and the hashes of the run's other nodes as text, ``left`` and ``right`` of the node.

    ``nodes``: (tree, place, size, hash), ``size`` nodes of one level per tree.
    """
    slot = F.col("place") % arity
    length = F.least(F.lit(arity), F.col("size") - F.col("place") + slot)
    order = Window.partitionBy("tree", "run").orderBy("place")
    lags = [F.when(slot >= k, F.lag("hash", k).over(order)) for k in range(arity - 1, 0, -1)]
    leads = [F.when(slot + k < length, F.lead("hash", k).over(order)) for k in range(1, arity)]
    return nodes.withColumn("run", F.floor(F.col("place") / arity)).withColumns({"slot": slot, "left": F.concat_ws("", *lags), "right": F.concat_ws("", *leads)})


def parents(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    first = with_siblings(nodes, arity).where("slot = 0")
    return first.select("tree", F.col("run").alias("place"), F.ceil(F.col("size") / arity).alias("size"), sha256(F.concat("hash", "right")).alias("hash"))


def levels(nodes: DataFrame, largest: int, arity: int = ARITY) -> list[DataFrame]:
    """The levels of all trees from the leaves up, each written; trees end where their size is 1."""
    out = [nodes]
    while largest > 1:
        out.append(written(parents(out[-1].where("size > 1"), arity), "nodes"))
        largest = -(-largest // arity)
    return out


_PATH = "array<struct<left:string,right:string>>"


def paths(above: list[DataFrame], tops: DataFrame | None = None, arity: int = ARITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``path`` (siblings per level up to the root, left and right of the way) and the columns of ``tops`` to the nodes of the lowest level.

    ``tops``: (tree, path, further columns) for the only node of every tree's
    last level; without it paths end there.
    """
    down: DataFrame | None = None
    further = [c for c in tops.columns if c not in ("tree", "path")] if tops is not None else []
    for number in range(len(above) - 1, -1, -1):
        extra = list(keep) if number == 0 else []
        nodes = above[number]
        last = nodes.where("size = 1")
        last = last.join(tops, "tree") if tops is not None else last.withColumn("path", F.array().cast(_PATH))
        ends = last.select("tree", "place", "hash", *extra, "path", *further)
        if down is not None:
            up = down.select(F.col("tree").alias("up_tree"), F.col("place").alias("up_place"), F.col("path").alias("up_path"), *further)
            rows = with_siblings(nodes.where("size > 1"), arity).join(up, (F.col("tree") == F.col("up_tree")) & (F.col("run") == F.col("up_place")))
            path = F.concat(F.array(F.struct("left", "right")), F.col("up_path"))
            ends = rows.select("tree", "place", "hash", *extra, path.alias("path"), *further).unionByName(ends)
        down = ends
    return down


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda h, p: sha256(F.concat(p["left"], h, p["right"])))


def manifest(docs: DataFrame, tampered: Column, *, arity: int = ARITY, **names) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    ``proof_sha256`` hashes the siblings from the leaf to the root.
    ``folded_root`` is built from the altered leaf where ``tampered`` holds.
    """
    placed = written(
        ranked(written(leaves(docs, tampered, **names), "leaves"), "source", ["key", "leaf"])
        .select(F.col("start").alias("tree"), F.col("rank").alias("place"), "size", F.col("leaf").alias("hash"), "key", "altered"),
        "placed",
    )
    largest = placed.agg(F.max("size")).first()[0] or 0
    per_source = levels(placed, largest, arity)
    subroots = reduce(DataFrame.unionByName, [t.where("size = 1").select("tree", "hash") for t in per_source])
    numbered = written(ranked(written(subroots.withColumn("all", F.lit(0)), "subroots"), "all", ["tree"]).select(
        F.lit(0).cast("bigint").alias("tree"), F.col("rank").alias("place"), "size", "hash", F.col("tree").alias("source_tree")
    ), "subroots")
    over_sources = levels(numbered, numbered.count(), arity)
    root = over_sources[-1].where("size = 1").select("hash").first()
    tops = paths(over_sources, arity=arity, keep=("source_tree",)).select(F.col("source_tree").alias("tree"), "path", F.col("hash").alias("subroot"))
    found = paths(per_source, tops, arity, keep=("key", "altered"))
    total = F.lit(root["hash"] if root else None).cast("string")
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    out = found.select("key", F.col("hash").alias("leaf"), "subroot", total.alias("root"), sha256(siblings).alias("proof_sha256"), folded(F.coalesce("altered", "hash"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
