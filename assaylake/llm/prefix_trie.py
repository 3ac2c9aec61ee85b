"""Prefix trie of conversations by vertical bitmaps.

1. ``rebuilt`` orders the turns of every conversation, gives it the first turns
   of its donor, and numbers the conversations by id. Turns are carried as 128
   bits of their hash; texts are read once and never shuffled.
2. Conversations of 2048 consecutive numbers form a shard, and 64 positions of a
   shard a group. Per group the turns are indexed: for every
   (position, turn) the set of conversations that hold it there, one bit each.
   Depth first, a node's set is intersected with the posting of the next turn of
   its lowest member: that is a child, and the members left over give the next
   one. Set sizes, lowest members and the ids that end at a node are read off
   the sets.
3. A node is known by the xor of its turns' hashes with their positions (128
   bits), which needs no walk from the root: long conversations are cut into
   segments, and the hash in front of each segment is a running xor over
   segments. Nodes of all groups are added up by that key.
4. Sums over subtrees need no walk either. A node belongs to its smallest member.
   From the depth where a conversation first owns a node it owns all its deeper
   ones, so what a member adds to a node's sums follows from the words in front of
   that depth. Each group's rows add up by key.

A conversation, a first turn or a family of equal conversations may hold any
share of the rows: groups are bounded in conversations and positions, and what
crosses them is one row per node and group. Digests of end lists are built from
sorted rows as a stream, one list after the other, without holding a list.

Special cases: a null role or text is empty. A null turn comes before all
others; rows of one conversation with the same turn go by the hash of role and
text. Rows without a conversation id belong to no conversation. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.frames import WORD, written
from assaylake.llm.positions import ranked

SHARD, SEGMENT = 2048, 64
NOTHING = hashlib.sha256(b"").hexdigest()


def hashed_turns(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, a, b, words): two halves of the turn's hash, and the words of its text."""
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary"), 256)
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("bigint")
    rows = messages.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("bigint").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.regexp_count(said, F.lit(WORD)).cast("bigint").alias("words")
    )
    return rows.select("conv", "turn", half(1).alias("a"), half(17).alias("b"), "words")


def _segment(place: Column, size: int) -> Column:
    return F.floor(F.greatest(place - 1, F.lit(0)) / size)


def rebuilt(messages: DataFrame, donor: Column, given: Column, most: int, *, segment: int = SEGMENT, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows (conv, number, length, pos, a, b, words), and one row per conversation (conv, number, length).

    ``donor`` and ``given`` are expressions of ``conv``: whose first turns it
    gets, and how many (at most ``most``); as many of its own first turns go.
    Position 0 stands for the empty beginning, which every conversation has.
    """
    own = written(ranked(written(hashed_turns(messages, **columns), "turns"), "conv", ["turn", "a", "b"]).select("conv", "rank", "size", "a", "b", "words"), "turns")
    ids = written(own.groupBy("conv").agg(F.max("size").alias("size")).withColumn("all", F.lit(0)), "conversations")
    ids = ranked(ids.withColumnRenamed("size", "own"), "all", ["conv"]).select("conv", "own", F.col("rank").alias("number"), donor.alias("donor"), given.alias("given"))
    first = own.where(F.col("rank") < most).groupBy(F.col("conv").alias("donor")).agg(F.array_sort(F.collect_list(F.struct("rank", "a", "b", "words"))).alias("first"))
    got = F.when(F.col("given") > 0, F.slice(F.coalesce("first", F.array()), 1, F.col("given"))).otherwise(F.slice("first", 1, 0))
    convs = ids.join(first, "donor", "left").withColumn("got", F.coalesce(got, F.slice("first", 1, 0), F.array()))
    convs = written(convs.select("conv", "own", "number", "given", "got", (F.size("got") + F.greatest(F.col("own") - F.col("given"), F.lit(0))).cast("bigint").alias("length")), "conversations")
    begin = convs.select("conv", "number", "length", F.lit(0).cast("bigint").alias("pos"), *[F.lit(0).cast("bigint").alias(c) for c in ("a", "b", "words")])
    taken = convs.select("conv", "number", "length", F.posexplode("got").alias("i", "t")).select("conv", "number", "length", (F.col("i") + 1).cast("bigint").alias("pos"), "t.a", "t.b", "t.words")
    # One row per segment of a conversation, so that a long one does not meet in one task.
    parts = convs.select("conv", "number", "length", "given", F.size("got").alias("n_got"), F.explode(F.sequence(F.lit(0), F.floor((F.col("own") - 1) / segment))).alias("part"))
    kept = own.withColumn("part", F.floor(F.col("rank") / segment)).join(parts, ["conv", "part"]).where("rank >= given")
    kept = kept.select("conv", "number", "length", (F.col("n_got") + F.col("rank") - F.col("given") + 1).cast("bigint").alias("pos"), "a", "b", "words")
    return written(begin.unionByName(taken).unionByName(kept), "rebuilt"), convs.select("conv", "number", "length")


def _groups(rows: DataFrame, shard: int, segment: int) -> DataFrame:
    """Rows with shard, segment, the hashes of their turn and place, and the sums in front of their segment."""
    place = F.when(F.col("pos") == 0, F.lit(0).cast("bigint"))
    placed = rows.withColumns({
        "shard": F.floor(F.col("number") / shard), "segment": _segment(F.col("pos"), segment),
        "m1": F.coalesce(place, F.xxhash64("a", "b", "pos")), "m2": F.coalesce(place, F.xxhash64("pos", "b", "a")),
    })
    before = Window.partitionBy("conv").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.where(F.col("length") > segment).groupBy("conv", "segment").agg(F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"), F.sum("words").alias("w"))
    starts = sums.select("conv", "segment", F.bit_xor("x1").over(before).alias("s1"), F.bit_xor("x2").over(before).alias("s2"), F.sum("w").over(before).alias("w0")).where("segment > 0")
    zero = {c: F.lit(0).cast("bigint") for c in ("s1", "s2", "w0")}
    return placed.where("segment = 0").withColumns(zero).unionByName(placed.where("segment > 0").join(starts, ["conv", "segment"]))


LOCAL = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, words bigint, before bigint, n bigint, least bigint, shard bigint, members array<bigint>, ends string"


def _members(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def local_nodes(group: pa.Table, size: int) -> pa.Table:
    """The nodes of one shard and segment (of ``size`` positions), from bitmaps of its (position, turn) pairs."""
    col = {c: group.column(c).to_numpy() for c in group.column_names}
    order = np.lexsort((col["pos"], col["number"]))
    col = {c: v[order] for c, v in col.items()}
    shard, segment = int(col["shard"][0]), int(col["segment"][0])
    base = segment * size + 1 if segment else 0
    first = np.flatnonzero(np.diff(col["number"], prepend=-1))
    slots = np.repeat(np.arange(len(first)), np.diff(first, append=len(order))).tolist()
    conv = col["conv"][first].tolist()
    pos, words, m1, m2 = (col[c].tolist() for c in ("pos", "words", "m1", "m2"))
    ending = (col["pos"] == col["length"]).tolist()
    postings: dict[tuple[int, int, int], int] = {}
    alive: dict[int, int] = {}
    ended: dict[int, int] = {}
    turn = list(zip(pos, col["a"].tolist(), col["b"].tolist()))
    for i, s in enumerate(slots):
        bit = 1 << s
        postings[turn[i]] = postings.get(turn[i], 0) | bit
        alive[pos[i]] = alive.get(pos[i], 0) | bit
        if ending[i]:
            ended[pos[i]] = ended.get(pos[i], 0) | bit
    at = first.tolist()
    parents: dict[tuple[int, int, int], int] = {}
    if segment:
        for s, key in enumerate(zip(col["s1"][first].tolist(), col["s2"][first].tolist(), col["w0"][first].tolist())):
            parents[key] = parents.get(key, 0) | 1 << s
    # (members, position of the children, key, words up to here)
    stack = [(bits, base, k1, k2, w) for (k1, k2, w), bits in parents.items()] if segment else [((1 << len(at)) - 1, 0, 0, 0, 0)]
    out: list[list] = [[] for _ in range(11)]
    while stack:
        bits, p, k1, k2, before = stack.pop()
        rest = bits & alive.get(p, 0)
        while rest:
            s = (rest & -rest).bit_length() - 1
            i = at[s] + p - base
            child = bits & postings[turn[i]]
            rest &= ~child
            c1, c2 = k1 ^ m1[i], k2 ^ m2[i]
            held = [s] if child == 1 << s else _members(child)
            done = child & ended.get(p, 0)
            ends = ",".join([str(conv[e]) for e in _members(done)]) if done else None
            for column, value in zip(out, (c1, c2, k1, k2, p, words[i], before, len(held), conv[s], [conv[e] for e in held], ends)):
                column.append(value)
            stack.append((child, p + 1, c1, c2, before + words[i]))
    ints = [pa.array(v, pa.int64()) for v in out[:9]]
    names = [f.split()[0] for f in LOCAL.split(", ")]
    return pa.Table.from_arrays([*ints, pa.array(np.full(len(out[0]), shard), pa.int64()), pa.array(out[9], pa.list_(pa.int64())), pa.array(out[10], pa.string())], names=names)


def list_digests(lists: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """(key, digest): sha256 of a key's texts, joined by commas in ``order``.

    Rows are sorted inside their task and fed to the digest one by one; a digest
    runs from front to back by nature, so a key is one task, but no list is held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            keys, found = [], []
            for *k, part in zip(*[batch.column(i).to_pylist() for i in range(len(key) + 1)]):
                if k != current:
                    if state is not None:
                        keys.append(current)
                        found.append(state.hexdigest())
                    current, state = k, hashlib.sha256(part.encode())
                else:
                    state.update(b",")
                    state.update(part.encode())
            yield _digest_rows(keys, found)
        if state is not None:
            yield _digest_rows([current], [state.hexdigest()])

    def _digest_rows(keys: list, found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], pa.int64()) for i in range(len(key))], pa.array(found, pa.string())], names=[*key, "digest"])

    dealt = lists.repartition(*key).sortWithinPartitions(*key, order).select(*key, text)
    return dealt.mapInArrow(run, ", ".join(f"{k} bigint" for k in key) + ", digest string")


def trie(rows: DataFrame, convs: DataFrame, *, shard: int = SHARD, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for every node.

    ``rows`` and ``convs`` as ``rebuilt`` gives them; a group holds ``shard`` conversations and ``segment`` positions.
    """
    col = F.col
    columns = ["conv", "number", "length", "pos", "a", "b", "words", "m1", "m2", "shard", "segment", "s1", "s2", "w0"]
    local = written(_groups(rows, shard, segment).select(*columns).groupBy("shard", "segment").applyInArrow(lambda group: local_nodes(group, segment), LOCAL), "local")
    key = ["k1", "k2"]
    nodes = written(
        local.groupBy(*key).agg(*[F.min(c).alias(c) for c in ("p1", "p2", "depth", "words", "before")], F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.min("shard").alias("home")), "nodes"
    )
    below = nodes.where("depth > 0").groupBy(col("p1").alias("k1"), col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    full = written(nodes.join(below, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # What a conversation adds to a node: the words between the node and the first node of its own, and one leaf if it owns one.
    owned = full.groupBy(col("conv_id").alias("conv")).agg(F.min("before").alias("own_from"), F.max((col("n_children") == 0).cast("bigint")).alias("leaf"))
    whole = rows.groupBy("conv").agg(F.sum("words").alias("total"))
    gives = convs.join(whole, "conv").join(owned, "conv", "left").select(
        "conv", F.coalesce("own_from", "total").alias("own_from"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.explode(F.sequence(F.lit(0).cast("bigint"), _segment(col("length"), segment))).alias("segment")
    )
    held = local.select(*key, "before", _segment(col("depth"), segment).alias("segment"), F.explode("members").alias("conv")).join(gives, ["conv", "segment"])
    sums = held.groupBy(*key).agg(F.sum(F.greatest(col("own_from") - col("before"), F.lit(0))).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    # A parent's id, first for each shard that asks for it, so that the children of one node do not meet in one task.
    asked = full.where("depth > 0").select("p1", "p2", "home").distinct()
    told = asked.join(full.select(col("k1").alias("p1"), col("k2").alias("p2"), col("conv_id").alias("parent_conv_id")), ["p1", "p2"])
    ends = list_digests(local.where("ends is not null").select(*key, "shard", "ends"), key, "shard", "ends")
    out = full.join(told, ["p1", "p2", "home"], "left").join(sums, key).join(ends, key, "left")
    return out.select(
        "conv_id", "depth", F.when(col("depth") > 0, col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(NOTHING)).alias("ends_sha256")
    )
