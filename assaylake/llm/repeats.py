"""Exact removal of repeated byte strings: prefix doubling over sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier
(in a document of a smaller id, or before it in the same document). Textbook
prefix doubling sorts a rank pair for every byte position in every round; that
is many times the input per round. Here the positions are sampled first, and a
position leaves as soon as its rank is unique or its string has grown past the
threshold:

* Round 1. Every window of ``length`` bytes names one place inside itself, the
  smallest of its grams of 32 bytes, so equal windows name equal places and about 3 % of
  all positions are named. The windows that name one position are neighbours.
  Spark ranks the pairs (gram at the position, string of all its windows). A
  string seen before decides all its windows at once; a position whose gram is
  unique has no repeated window and leaves.
* Round 2. What is left is cut into groups of eight windows, with the 93 bytes
  common to them as the shorter string and their whole extent as the longer one.
  Again a repeated extent decides, a unique core leaves.
* Round 3. Single windows of ``length`` bytes are ranked.

The rank of a string is its earliest occurrence, found with grouped minima that
are combined before the shuffle, so a passage of very many documents is no hot
key. Strings are compared by two independent 64-bit hashes of all their bytes.

Special cases: null texts are empty; texts shorter than ``length`` lose nothing.
Rows that share an id count as one place: they are not removed against each
other. Rows with a null id lose nothing and are no earlier occurrence for
others. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.blocks import SpanHash, blocks, mix, signed
from assaylake.llm.frames import discard, written

GRAM, GROUP = 32, 8
PLACE = np.uint64((1 << 24) - 1)  # low bits of a sort value hold the place inside a segment
SEGMENT = 1 << 22


def _extent_key(hashed: SpanHash, start: np.ndarray, stop: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Key of the string from window ``start`` to the end of window ``stop``, with the place named in it."""
    return mix(hashed(start, stop + length) + ((place - start) * (1 << 20) + (stop - start)).astype(np.uint64))


def _sample(data: np.ndarray, offsets: np.ndarray, length: int) -> list[np.ndarray]:
    hashed = SpanHash(data, seed=5)
    value = (hashed.rolling(GRAM) & ~PLACE) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while 2 * size <= width:
        value = np.minimum(value[: len(value) - size], value[size:])
        size *= 2
    if size < width:
        value = np.minimum(value[: len(value) - (width - size)], value[width - size :])
    named = (value & PLACE).astype(np.int64)
    last = np.repeat(offsets[1:], np.diff(offsets))[: len(named)]
    window = np.flatnonzero(np.arange(len(named)) + length <= last)
    named = named[window]
    first = np.ones(len(window), bool)
    first[1:] = (named[1:] != named[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(window))[: len(begin)] - 1
    place, start, stop = named[begin], window[begin], window[end]
    return [np.searchsorted(offsets, place, "right") - 1, place, start, stop, _extent_key(hashed, start, stop, place, length), hashed(place, place + GRAM)]


def sampled(data: np.ndarray, offsets: np.ndarray, length: int) -> list[np.ndarray]:
    """(document, place, first window, last window, extent key, gram key) of a block; long texts go by segments."""
    if len(data) < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if len(data) <= SEGMENT:
        return _sample(data, offsets, length)
    parts = []
    for at in range(0, len(data) - length + 1, SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        inner = np.clip(offsets - at, 0, len(part))
        found = _sample(part, inner, length)
        parts.append([found[0], found[1] + at, found[2] + at, found[3] + at, found[4], found[5]])
    return [np.concatenate(x) for x in zip(*parts)]


def _places(docs: DataFrame, length: int) -> DataFrame:
    """Round 1 rows (extent, gram, doc_id), one per distinct string of a document."""
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in blocks(batch.column(1)):
                doc, _, _, _, extent, gram = sampled(data, offsets, length)
                _, once = np.unique(mix(extent ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(extent[once])), pa.array(signed(gram[once])), batch.column(0).take(pa.array(doc[once] + i))], names=["extent", "gram", "doc_id"]
                )

    return docs.mapInArrow(run, f"extent bigint, gram bigint, doc_id {key_type}")


def _first_with(extent: np.ndarray, doc: np.ndarray, wanted: np.ndarray, wanted_doc: np.ndarray) -> np.ndarray:
    """Index of the first position of every document's wanted extent keys; positions are in text order."""
    salt = np.uint64(0x9E3779B97F4A7C15)
    own, asked = mix(extent ^ (doc.astype(np.uint64) * salt)), mix(wanted ^ (wanted_doc.astype(np.uint64) * salt))
    distinct, once = np.unique(own, return_index=True)
    return np.sort(once[np.isin(distinct, asked)])


def _listed(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of list rows i..j and the row (from 0) of each; null lists are empty."""
    part = column.slice(i, j - i)
    size = part.value_lengths().fill_null(0).to_numpy()
    return part.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(j - i), size)


def _open_places(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, place, start, stop, bytes) of the positions listed in ``extents``."""
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                doc, place, start, stop, extent, _ = sampled(data, offsets, length)
                wanted, wanted_doc = _listed(batch.column(2), i, j)
                k = _first_with(extent, doc, wanted.astype(np.int64).view(np.uint64), wanted_doc)
                doc, place, start, stop = doc[k], place[k], start[k], stop[k]
                raw = data.tobytes()
                base = offsets[:-1][doc]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc + i)), *[pa.array(x - base) for x in (place, start, stop)], pa.array([raw[a : b + length] for a, b in zip(start.tolist(), stop.tolist())], pa.binary())],
                    names=["doc_id", "place", "start", "stop", "bytes"],
                )

    return docs.mapInArrow(run, f"doc_id {key_type}, place bigint, start bigint, stop bigint, bytes binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends[:-1] - ends[0]


def _groups(places: DataFrame, length: int) -> DataFrame:
    """Round 2 rows: groups of windows with the key of their common core and of their extent."""
    key_type = places.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                data, base = _flat(part.column(4))
                place, start, stop = (part.column(k).to_numpy() for k in (1, 2, 3))
                hashed, shift = SpanHash(data, seed=5), base - start
                rows = []
                for g in range(-(-(length - GRAM + 1) // GROUP)):
                    a, b = np.maximum(start, place - g * GROUP - GROUP + 1), np.minimum(stop, place - g * GROUP)
                    k = np.flatnonzero(a <= b)
                    x, y, c = a[k] + shift[k], b[k] + shift[k], place[k] + shift[k]
                    core = hashed(c - g * GROUP, c - g * GROUP - GROUP + 1 + length) + np.uint64(g)
                    rows.append((k, a[k], b[k], _extent_key(hashed, x, y, c, length), mix(core)))
                k, a, b, extent, core = (np.concatenate(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(k)), pa.array(place[k]), pa.array(a), pa.array(b), pa.array(signed(extent)), pa.array(signed(core))],
                    names=["doc_id", "place", "start", "stop", "extent", "core"],
                )

    return places.mapInArrow(run, f"doc_id {key_type}, place bigint, start bigint, stop bigint, extent bigint, core bigint")


def _windows(groups: DataFrame, length: int) -> DataFrame:
    """Round 3 rows: (doc_id, start, extent, core), two independent hashes of every single window.

    Input: doc_id, start, stop of a group and ``first``, ``bytes`` of its place.
    """
    key_type = groups.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                data, base = _flat(part.column(4))
                start, stop, first = (part.column(k).to_numpy() for k in (1, 2, 3))
                row = np.repeat(np.arange(len(start)), stop - start + 1)
                window = start[row] + np.arange(len(row)) - np.searchsorted(row, np.arange(len(start)))[row]
                x = base[row] + window - first[row]
                keys = [pa.array(signed(SpanHash(data, seed=s)(x, x + length))) for s in (5, 7)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(window), *keys], names=["doc_id", "start", "extent", "core"])

    return groups.select("doc_id", "start", "stop", "first", "bytes").mapInArrow(run, f"doc_id {key_type}, start bigint, extent bigint, core bigint")


def _ranked(rows: DataFrame) -> DataFrame:
    """Marks rows whose (core, extent) pair has an earlier occurrence: repeated."""
    first = rows.groupBy("core", "extent").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    return rows.join(first, ["core", "extent"]).withColumn("repeated", F.struct("doc_id", "start") != F.col("first")).drop("first")


def repeated_windows(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, text): the first occurrences of round 1, and explicit window ranges (doc_id, start, stop) of later rounds."""
    firsts = written(_places(docs, length).groupBy("extent", "gram").agg(F.min("doc_id").alias("doc_id")), "round1")
    several = firsts.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    # Written on its own, so that the shuffles by gram are gone before the texts are dealt.
    undecided = written(firsts.join(several, "gram").select("doc_id", "extent"), "undecided")
    open_ = undecided.groupBy("doc_id").agg(F.collect_list("extent").alias("extents"))
    places = written(_open_places(docs.join(open_, "doc_id").select("doc_id", "text", "extents"), length), "places")
    groups = written(_groups(places, length), "groups")
    second = written(_ranked(groups), "round2")
    discard(groups)
    fresh = second.where(~F.col("repeated"))
    shared = fresh.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    open_ = fresh.join(shared, "core").select("doc_id", "place", "start", "stop")
    sources = places.select("doc_id", "place", F.col("start").alias("first"), F.col("stop").alias("last"), "bytes")
    third = written(_windows(open_.join(sources, ["doc_id", "place"]).where("first <= start and stop <= last"), length), "windows")
    ranges = second.where("repeated").select("doc_id", "start", "stop").unionByName(
        _ranked(third).where("repeated").select("doc_id", "start", F.col("start").alias("stop"))
    )
    ranges = written(ranges, "ranges")
    discard(undecided, places, second, third)
    return firsts.select("doc_id", "extent"), ranges


def remove_repeats(docs: DataFrame, *, length: int = 100, text: str = "text", key: str = "doc_id", with_kept: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row; on demand ``kept``, the bytes that stay, and the columns ``carry``."""
    if length <= GRAM + GROUP:
        raise ValueError(f"length must exceed {GRAM + GROUP}")
    extra = [docs.schema[c] for c in carry]
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    firsts, ranges = repeated_windows(docs.select("doc_id", "text").where("doc_id is not null and text is not null"), length)
    lists = firsts.groupBy("doc_id").agg(F.collect_list("extent").alias("extents"))
    spans = ranges.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    joined = docs.join(lists, "doc_id", "left").join(spans, "doc_id", "left").select("doc_id", "text", "extents", "starts", "stops", *docs.columns[2:])
    key_type = docs.schema["doc_id"].dataType.simpleString()
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                doc, _, start, stop, extent, _ = sampled(data, offsets, length)
                wanted, wanted_doc = _listed(batch.column(2), i, j)
                later = np.ones(len(doc), bool)
                later[_first_with(extent, doc, wanted.astype(np.int64).view(np.uint64), wanted_doc)] = False
                later &= batch.column(0).slice(i, j - i).is_valid().to_numpy(zero_copy_only=False)[doc]
                (a, of), (b, _) = _listed(batch.column(3), i, j), _listed(batch.column(4), i, j)
                base = offsets[:-1][of]
                begin = np.concatenate([start[later], a.astype(np.int64) + base])
                end = np.concatenate([stop[later], b.astype(np.int64) + base]) + length
                size = len(data)
                gone = np.cumsum(np.bincount(begin, minlength=size + 1)[: size + 1] - np.bincount(end, minlength=size + 1)[: size + 1])[:-1] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[offsets[1:]] - total[offsets[:-1]]
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                inner = offsets[:-1][offsets[:-1] < size]
                edge[inner] = gone[inner]
                runs = np.concatenate([[0], np.cumsum(edge)])
                kept = [data[s:e] if not r else data[s:e][~gone[s:e]] for s, e, r in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist())]
                columns = [pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs[offsets[1:]] - runs[offsets[:-1]]), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                if with_kept:
                    columns.append(pa.array([k.tobytes() for k in kept], pa.binary()))
                columns += [batch.column(5 + c)[i:j] for c in range(len(extra))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *columns], names=names)

    added = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)
    return joined.mapInArrow(run, f"`{key}` {key_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept + added)
