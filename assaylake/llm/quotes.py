"""Quotation linking: messages with nested quotes become reply-ordered conversations without quotes.

Lines that begin with ``>`` marks are quotes, one mark per level. A run of lines
of one level is a passage. Passages, and their longer lines, are hashed after
white space is normalised, and joined to what messages of the same conversation
say themselves. A message answers the original that covers most characters of
its shallowest linked quotes. DataFrame expressions only.

Originals are reduced to the earliest message per hash before the join, so a
line that very many messages share meets each quote once.

Special cases: a null text is empty; a message without a linked quote starts a
thread of its own. A quote links only to an earlier message (smaller turn), so
there are no cycles; among equals the latest original wins. Rows with a null
conversation or turn keep their own text and link to nothing. Rows that repeat
conversation and turn are each linked; as originals they count as one message.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.frames import written

MARKS = r"^(?:[ \t]*>)+[ \t]?"
LINE_WORDS = 5


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def parsed(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, own, passages): own text without quotes, and the quoted passages as (level, lines)."""
    col = F.col
    df = messages.select(col(conversation).alias("conv"), col(turn).alias("turn"), col(role).alias("role"), F.split(F.coalesce(col(text), F.lit("")), "\n").alias("lines"))
    df = df.withColumn("levels", F.transform("lines", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))))
    df = df.withColumn("bare", F.transform("lines", lambda x: F.regexp_replace(x, MARKS, "")))
    df = df.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get("levels", i) != F.get("levels", F.greatest(i - 1, F.lit(0))))))
    runs = F.transform(
        "starts", lambda s, k: F.struct(F.get("levels", s).alias("level"), F.slice("bare", s + 1, F.coalesce(F.get("starts", k + 1), F.size("lines")) - s).alias("lines"))
    )
    df = df.withColumn("runs", runs)
    own = F.array_join(F.flatten(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["lines"])), "\n")
    return df.select("conv", "turn", "role", F.regexp_replace(own, r"^\s+|\s+$", "").alias("own"), F.filter("runs", lambda r: r["level"] > 0).alias("passages"))


def _keys(lines: Column) -> Column:
    """Hash and length of the whole passage, and of each of its lines of at least ``LINE_WORDS`` words."""
    whole = plain(F.array_join(lines, " "))
    entry = lambda kind, s: F.struct(F.lit(kind).alias("kind"), F.xxhash64(s).alias("hash"), F.length(s).alias("size"))
    long = F.filter(F.transform(lines, plain), lambda s: F.size(F.split(s, " ")) >= LINE_WORDS)
    return F.filter(F.concat(F.array(entry("whole", whole)), F.transform(long, lambda s: entry("line", s))), lambda e: e["size"] > 0)


def links(rows: DataFrame) -> DataFrame:
    """(conv, turn, level, original, size): characters of each quote level found in earlier messages, from ``parsed`` rows."""
    placed = rows.where("conv is not null and turn is not null")
    quoted = placed.select("conv", "turn", F.explode("passages").alias("p")).select("conv", "turn", "p.level", F.explode(_keys(F.col("p.lines"))).alias("k"))
    said = placed.select("conv", "turn", F.explode(_keys(F.split("own", "\n"))).alias("k")).select("conv", "turn", "k.kind", "k.hash")
    originals = said.groupBy("conv", "kind", "hash").agg(F.min("turn").alias("original"))
    found = quoted.select("conv", "turn", "level", "k.kind", "k.hash", "k.size").join(originals, ["conv", "kind", "hash"]).where("original < turn")
    return found.groupBy("conv", "turn", "level", "original").agg(F.sum("size").alias("size"))


def threads(parents: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(conv, turn, parent, thread, depth) from (conv, turn, parent): root and distance to it, by pointer jumping.

    Every round doubles the distance that a row has climbed, and only rows that
    have not arrived at a root take part in the next one. The number of rounds
    is the logarithm of the longest chain. One row per (conv, turn).
    """
    moving = F.col("parent").isNotNull()
    start = written(
        parents.select("conv", "turn", "parent", F.coalesce("parent", "turn").alias("thread"), moving.cast("bigint").alias("depth"), moving.alias("moving")), "threads"
    )
    arrived, active = start.where(~F.col("moving")), start.where("moving")
    for _ in range(max_rounds):
        if active.limit(1).count() == 0:
            return arrived.drop("moving")
        every = arrived.unionByName(active)
        up = every.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"), F.col("moving").alias("on"))
        climbed = active.join(up, ["conv", "thread"]).select(
            "conv", "turn", "parent", F.col("above").alias("thread"), (F.col("depth") + F.col("more")).alias("depth"), F.col("on").alias("moving")
        )
        climbed = written(climbed, "threads")
        arrived, active = arrived.unionByName(climbed.where(~F.col("moving"))), climbed.where("moving")
    raise RuntimeError(f"reply chains did not end in {max_rounds} rounds")


def linked_messages(messages: DataFrame, **columns: str) -> DataFrame:
    """(conv, turn, role, own, n_passages, n_linked, parent, thread, depth) for every message."""
    rows = written(parsed(messages, **columns), "messages")
    found = written(links(rows), "links")
    best = found.groupBy("conv", "turn").agg(
        F.max(F.struct(-F.col("level"), F.col("size"), F.col("original"))).alias("best"), F.count_distinct("level").alias("linked_levels")
    )
    places = rows.where("conv is not null and turn is not null").select("conv", "turn").distinct()
    tree = threads(places.join(best, ["conv", "turn"], "left").select("conv", "turn", F.col("best.original").alias("parent")))
    counted = best.select("conv", "turn", "linked_levels")
    return (
        rows.join(tree, ["conv", "turn"], "left").join(counted, ["conv", "turn"], "left")
        .select("conv", "turn", "role", "own", F.size("passages").cast("bigint").alias("n_passages"), F.coalesce("linked_levels", F.lit(0)).cast("bigint").alias("n_linked"),
                "parent", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))
    )


def conversations(linked: DataFrame, part_size: int = 256) -> DataFrame:
    """(conv, thread, part, messages): replies of every thread in order, as (role, content), in parts of bounded length."""
    order = Window.partitionBy("conv", "thread").orderBy("turn", "role", "own")
    placed = linked.withColumn("place", F.row_number().over(order) - 1).withColumn("part", F.floor(F.col("place") / part_size))
    return placed.groupBy("conv", "thread", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "role", F.col("own").alias("content")))), lambda m: F.struct(m["role"], m["content"])).alias("messages")
    )


def as_mailbox(messages: DataFrame) -> DataFrame:
    """The table as an exchange of mails: every turn quotes the one before it (``> ``) and that one's predecessor (``>> ``) in front of its own text."""
    col = F.col
    base = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    at = lambda back, name: base.groupBy("conv_id", (col("turn") + back).cast("int").alias("turn")).agg(F.min("text").alias(name))
    quote = lambda name, mark: F.concat(F.lit(mark), F.regexp_replace(col(name), "\n", "\n" + mark), F.lit("\n"))
    both = base.join(at(1, "one"), ["conv_id", "turn"], "left").join(at(2, "two"), ["conv_id", "turn"], "left")
    return both.select(
        "conv_id", "turn", "role",
        F.concat(F.coalesce(quote("two", ">> "), F.lit("")), F.coalesce(quote("one", "> "), F.lit("")), F.when(col("one").isNotNull(), "\n").otherwise(""), col("text")).alias("text"),
    )
