"""Document fingerprints from spot signatures, with DataFrame expressions only.

Common words (anchors) are scattered over running text and rare in page
furniture. Every run of anchors starts a chain: the run's last anchor and the
next ``chain`` content words form one signature. The distinct signatures of a
text are its fingerprint; two texts are compared by the Jaccard similarity of
these sets. ``similar_pairs`` deals documents to partitions by set length, so
that only neighbouring lengths meet, and prunes by length and by the rarest
signatures before any set is compared.

Special cases: a null text is empty. A text without an anchor is fingerprinted
by the chains of its own words; one with fewer words than a chain by its whole
normalised text, and one without any letter or digit by the text itself, so
that equal texts always have equal fingerprints and an empty text has the empty
fingerprint. The similarity of two empty fingerprints is 1, of an empty and a
filled one 0. Repeated rows are fingerprinted alike; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.frames import written

# Frequent function words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were which with you "
    "auch auf das dem den der des die ein eine einen einer für im ist mit nicht sich und von wird zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il la le les par pas plus pour que qui se sur un une "
    "al como con del el en es esta este las lo los más no para pero por que se su sus un una y"
).split()
ANCHOR_SET = sorted(set(ANCHORS))
CHAIN = 2
ROWS_PER_RANGE = 2000
CUTS = 256
LARGEST = 2**63 - 1  # of a bigint
_MARK, _END = "\u0001", "\u0002"


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Adds ``out``: the distinct signature hashes of column ``text``, sorted.

    Arrays that a lambda looks into are columns of their own, so that they are
    computed once per row and not once per element.
    """
    words_, runs, shifted, anchored, plain = (f"__{out}_{x}" for x in ("words", "runs", "shifted", "anchored", "plain"))
    col = F.col
    content = lambda piece: F.substring_index(piece, _MARK, -1)
    tail = lambda name, k: [F.coalesce(F.get(col(name), k), F.lit(""))]
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda h: h.isNotNull())))

    # Lower-case words: runs of letters, marks and digits.
    df = df.withColumn(words_, F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"))
    # Words joined so that every piece between end marks is a run of anchors and one content word.
    marked = F.transform(F.filter(col(words_), lambda w: w != ""), lambda w: F.concat(w, F.when(w.isin(ANCHOR_SET), F.lit(_MARK)).otherwise(F.lit(_END))))
    df = df.withColumn(runs, F.split(F.array_join(marked, ""), _END))
    df = df.withColumn(shifted, F.transform(col(runs), content))
    following = lambda i: [x for k in range(1, chain) for x in tail(shifted, i + k)]
    df = df.withColumn(anchored, clean(F.transform(col(runs), lambda p, i: F.when(F.contains(p, F.lit(_MARK)), F.xxhash64(F.substring_index(p, _MARK, -2), *following(i))))))
    other = F.when(F.array_join(col(words_), "") != "", clean(F.transform(col(shifted), lambda p, i: F.xxhash64(p, *following(i))))).otherwise(
        F.when(F.coalesce(F.char_length(col(text)), F.lit(0)) > 0, F.array(F.xxhash64(col(text)))).otherwise(F.array().cast("array<bigint>"))
    )
    df = df.withColumn(plain, F.when(F.size(anchored) == 0, other))
    return df.withColumn(out, F.coalesce(plain, anchored)).drop(words_, runs, shifted, anchored, plain)


def fingerprint(signature: Column) -> Column:
    """The set as text: 16 hex digits per signature, in order."""
    return F.array_join(F.transform(signature, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Jaccard similarity of two signature sets, 1 for two empty ones."""
    common = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def _cut(quantiles: list[int]) -> tuple[list[int], list[int]]:
    """Cuts at the quantiles, and the slices of each range between them.

    A range has one slice; an id that fills several ranges stands alone between two
    cuts, and its range has as many slices as it fills.
    """
    times = Counter(quantiles)
    cuts = sorted({*times, *(c + 1 for c, n in times.items() if n > 1 and c < LARGEST)})
    return cuts, [1, *(times[c] + 1 if times[c] > 1 else 1 for c in cuts)]


def _quantiles(ranges: int) -> Column:
    return F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10_000) if ranges > 1 else F.array().cast("array<bigint>")


def _ranged(rows: DataFrame, order: Column, rows_per_range: int, cuts: int) -> DataFrame:
    """Adds ``bucket``, which ascends with (doc_id, null last; ``order``) and holds about ``rows_per_range`` rows.

    Ids are cut at approximate quantiles, and where one list of cuts does not do,
    every range once more by a list of its own. Null ids, and ids that fill ranges
    alone, are sliced by ``order``, a 64-bit hash. There are at most about
    7 * cuts ** 2 buckets; beyond cuts ** 2 * rows_per_range rows they grow.
    """
    total, filled = rows.agg(F.count("*"), F.count("doc_id")).first()
    wanted = max(1, -(-filled // rows_per_range))
    listed = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    passed = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.when(F.col("doc_id") >= x, 1).otherwise(0))

    coarse, slices = _cut(rows.agg(_quantiles(min(wanted, cuts))).first()[0] or [])
    place = passed(listed(coarse, "array<bigint>"))
    fine = {c: ([], [1]) for c in range(len(coarse) + 1)}
    if wanted > cuts:  # one row per range, with at most ``cuts`` numbers
        again = rows.where("doc_id is not null").groupBy(place.alias("place")).agg(_quantiles(min(cuts, -(-wanted // cuts))).alias("q"))
        fine |= {r["place"]: _cut(r["q"]) for r in again.collect()}
    width = max(len(f) for f, _ in fine.values()) + 1
    parts = [[slices[c] * n for n in fine[c][1]] for c in sorted(fine)]
    nulls = min(cuts**2, -(-(total - filled) // rows_per_range))
    most = max(nulls, *(max(p) for p in parts)) + 2
    inner = passed(F.get(listed([fine[c][0] for c in sorted(fine)], "array<array<bigint>>"), place))
    slice_of = lambda n: F.when(n > 1, F.floor((order.cast("double") / 2.0**64 + 0.5) * n)).otherwise(0)
    own = F.get(F.get(listed(parts, "array<array<bigint>>"), F.col("__place").cast("int")), F.col("__inner"))
    return (
        rows.withColumn("__place", place).withColumn("__inner", inner)
        .withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(fine) * width * most) + slice_of(F.lit(nulls))).otherwise((F.col("__place").cast("long") * width + F.col("__inner")) * most + slice_of(own)))
        .drop("__place", "__inner")
    )


def with_next(docs: DataFrame, *, rows_per_range: int = ROWS_PER_RANGE, cuts: int = CUTS) -> DataFrame:
    """(doc_id, text, items: its signatures) and next_text, next_items: those of the next document in ascending id, after the last the first.

    Rows are cut into ranges of the order, as many as their number asks for, and
    the first document of every range also goes to the range before it. So each
    text moves once, and no range needs another one. Null ids come last; equal
    ids go by the hash of their text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = F.xxhash64("text")
    ranged = _ranged(rows, order, rows_per_range, cuts)
    every = Window.orderBy("bucket")  # one row per range, a number bounded by ``cuts``
    firsts = ranged.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id"), order.alias("order"))).alias("first"))
    firsts = firsts.select("bucket", "first", F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    heads = ranged.join(F.broadcast(firsts), "bucket").where((F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (order == F.col("first.order")))
    heads = heads.groupBy("before").agg(F.first("text").alias("text")).select(F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "text", F.col("before").alias("bucket"), F.lit(True).alias("ghost"))
    both = with_signatures(ranged.withColumn("ghost", F.lit(False)).unionByName(heads), "text", "items")
    window = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_last(), order)
    ahead = F.lead(F.struct("text", "items")).over(window)
    return both.withColumn("next", ahead).where(~F.col("ghost")).select("doc_id", "text", "items", F.col("next.text").alias("next_text"), F.col("next.items").alias("next_items"))


def similar_pairs(docs: DataFrame, *, threshold: float = 0.8, text: str = "text", key: str = "doc_id", chain: int = CHAIN) -> DataFrame:
    """(a, b, likeness) between fingerprint classes of at least ``threshold``; a and b are the smallest ids of their classes.

    Equal fingerprints are one class. A class is dealt to the partition of its
    set length (partitions grow by 1 / threshold, so a partner is in the same
    or the next one). Inside a partition two classes meet if their prefixes, the
    rarest signatures of each set, share one; then lengths and sets are compared.
    """
    sets = with_signatures(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "text", "items", chain).drop("text").where(F.col("id").isNotNull() & (F.size("items") > 0))
    classes = written(sets.groupBy("items").agg(F.min("id").alias("id")).withColumn("n", F.size("items")), "classes")
    rare = classes.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("df"))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    ranked = (
        classes.select("id", "n", F.explode("items").alias("item")).join(rare, "item")
        .groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("by_df"))
        .select("id", "n", F.explode(F.slice("by_df", 1, prefix.cast("int"))).alias("entry")).select("id", "n", F.col("entry.item").alias("item"), F.col("entry.df").alias("df")).where("df > 1")
    )
    part = F.floor(F.log(F.col("n")) / -F.log(F.lit(threshold)))
    left = ranked.select("item", F.col("id").alias("a"), F.col("n").alias("na"), part.alias("part"))
    right = ranked.select("item", F.col("id").alias("b"), F.col("n").alias("nb"), F.explode(F.array(part, part + 1, part - 1)).alias("part"))
    near = left.join(right, ["item", "part"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("a", "b").distinct()
    return (
        near.join(classes.select(F.col("id").alias("a"), F.col("items").alias("left_items")), "a").join(classes.select(F.col("id").alias("b"), F.col("items").alias("right_items")), "b")
        .select("a", "b", likeness(F.col("left_items"), F.col("right_items")).alias("likeness")).where(F.col("likeness") >= threshold)
    )


def edited_and_next(docs: DataFrame, *, text: str = "text", key: str = "doc_id", share: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited text loses its last floor(n / share) code points and gains as many
    (or all) from the start of the next document.
    """
    rows = with_next(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    moved = f"cast(floor(char_length(text) / {share}) as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, char_length(text) - {moved}), substring(next_text, 1, {moved}))"))
    sets = with_signatures(rows, "edited", "edit")
    return sets.select(
        F.col("doc_id").alias(key), F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("items")).alias("fingerprint"), fingerprint(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("items"), F.col("edit")).alias("near_edited"), likeness(F.col("items"), F.col("next_items")).alias("near_next"),
    )
