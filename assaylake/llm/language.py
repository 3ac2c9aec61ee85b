"""Language identification with a bit-sliced Bloom filter over byte n-grams.

One Bloom filter per language would need one lookup per language and n-gram.
Here all filters share their hash functions and are stored slice by slice: a
slot holds a word whose bit l belongs to language l. The bitwise AND of the
slots of an n-gram is the set of all languages whose filter contains it. The
per-language counts of these bits, corrected for each filter's rate of false
positives, decide.

Results for special cases: a text that is null, or has no letter, is ``und``
with score 0; a text whose letters match no language takes the language with
the largest share of training documents (ties: alphabetical) with score 0.
Equal counts: the alphabetically first language. Without training rows every
text is ``und``. Columns other than id and text are ignored, so clashing names
do no harm; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.blocks import BLOCK_BYTES, batch_of, blocks, mix, sums

GRAM = 4  # bytes


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    slots: np.ndarray  # (words, 2**bits) of uint64: bit l of word l // 64 belongs to language l
    false_positive: np.ndarray  # one rate per language
    default: int
    hashes: int

    @property
    def bits(self) -> int:
        return int(self.slots.shape[1]).bit_length() - 1


def normalised(text: str | Column = "text") -> Column:
    """Lower case, every run of characters that are no letters is one space; a space at both ends."""
    c = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}]+", " "), F.lit(" "))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of a block, and each document's offsets into them."""
    lengths = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    if len(data) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    wide = data.astype(np.uint32)
    codes = wide[: len(data) - GRAM + 1].copy()
    for k in range(1, GRAM):
        codes = (codes << np.uint32(8)) | wide[k : len(data) - GRAM + 1 + k]
    inside = np.ones(len(codes), bool)
    for k in range(1, GRAM):  # windows over the end of a document
        cut = offsets[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(codes))]] = False
    bounds = np.zeros(len(offsets), np.int64)
    np.cumsum(lengths, out=bounds[1:])
    short = np.flatnonzero((np.diff(offsets) < GRAM) & (np.diff(offsets) > 0))
    if len(short):  # windows which begin in a text shorter than a gram never count
        for i in short:
            inside[offsets[i] : min(offsets[i + 1], len(codes))] = False
    return codes[inside], bounds


def _slots(codes: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    h = mix(codes.astype(np.uint64) + np.uint64(0x51ED270B))
    step = (h >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64((1 << bits) - 1)
    return [((h + np.uint64(k) * step) & mask).astype(np.int64) for k in range(hashes)]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        lang = batch.column(1).to_pylist()
        found: dict[str, list[np.ndarray]] = {}
        for i, j, data, offsets in blocks(batch.column(0)):
            codes, bounds = grams(data, offsets)
            for k in range(i, j):
                found.setdefault(lang[k], []).append(codes[bounds[k - i] : bounds[k - i + 1]])
        for name, parts in found.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            yield batch_of(schema, [[name] * len(codes), codes.astype(np.int64), n.astype(np.int64)])


def fit(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 1500,
    min_count: int = 3, dominance: float = 0.3, bits: int = 19, hashes: int = 2,
) -> LanguageModel:
    """Fit the filters on a bounded sample of labelled rows: about ``per_language`` documents of each language.

    Documents are picked by a hash of their id, with the share that gives the
    expected number, so the sample is spread over the whole table. An n-gram
    enters a language's filter if it occurs ``min_count`` times there and its
    relative frequency is at least ``dominance`` times the largest of all
    languages. The model has 2**bits slots whatever the input.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).cast("string").alias("key")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros((1, 2), np.uint64), np.zeros(0), 0, hashes)
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, per_language / sizes[name]))])
    chance = F.pmod(F.xxhash64(F.coalesce("key", F.lit("")), F.lit(17)), F.lit(1_000_000)) / F.lit(1e6)
    sample = rows.where(chance < share[F.col("lang")]).select(normalised("text").alias("text"), "lang")
    counted = (
        sample.mapInArrow(_count_grams, "lang string, code bigint, n bigint")
        .groupBy("lang", "code").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).collect()
    )
    totals = {name: 0 for name in languages}
    for r in counted:
        totals[r["lang"]] += r["n"]
    best: dict[int, float] = {}
    for r in counted:
        best[r["code"]] = max(best.get(r["code"], 0.0), r["n"] / totals[r["lang"]])
    words = (len(languages) + 63) // 64
    slots = np.zeros((words, 1 << bits), np.uint64)
    fill = np.zeros(len(languages))
    for index, name in enumerate(languages):
        kept = np.array([r["code"] for r in counted if r["lang"] == name and r["n"] / totals[name] >= dominance * best[r["code"]]], np.int64)
        for slot in _slots(kept, bits, hashes) if len(kept) else []:
            slots[index // 64, slot] |= np.uint64(1 << (index % 64))
        fill[index] = np.mean((slots[index // 64] >> np.uint64(index % 64)) & np.uint64(1))
    default = max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k))
    return LanguageModel(languages, slots, fill**hashes, default, hashes)


def counts(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: number of n-grams, and how many of them each language's filter contains; a long text is counted piece by piece."""
    if len(offsets) == 2 and len(data) > 2 * BLOCK_BYTES:
        total, hits = np.zeros(1, np.int64), np.zeros((1, len(model.languages)))
        for at in range(0, len(data) - GRAM + 1, BLOCK_BYTES):
            part = data[at : at + BLOCK_BYTES + GRAM - 1]  # pieces share what a gram needs
            more = counts(model, part, np.array([0, len(part)]))
            total, hits = total + more[0], hits + more[1]
        return total, hits
    codes, bounds = grams(data, offsets)
    slots = _slots(codes, model.bits, model.hashes)
    hits = np.zeros((len(offsets) - 1, len(model.languages)))
    for word in range(model.slots.shape[0]):
        mask = model.slots[word][slots[0]]
        for slot in slots[1:]:
            mask &= model.slots[word][slot]
        for index in range(64 * word, min(len(model.languages), 64 * word + 64)):
            hits[:, index] = sums(((mask >> np.uint64(index % 64)) & np.uint64(1)).astype(np.int8), bounds)
    return np.diff(bounds), hits


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, n_grams) for every row; the model is broadcast, its size is fixed by ``bits``.

    The score is the decided language's share of the corrected counts of all languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key_type = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                n = j - i
                winner, score = np.full(n, len(m.languages)), np.zeros(n)
                total = np.zeros(n, np.int64)
                if m.languages:
                    total, hits = counts(m, data, offsets)
                    share = hits / np.maximum(total, 1)[:, None]
                    true = np.clip((share - m.false_positive) / np.maximum(1 - m.false_positive, 1e-9), 0, 1)
                    mass = true.sum(axis=1)
                    winner = np.where(mass > 0, true.argmax(axis=1), m.default)
                    score = np.where(mass > 0, true.max(axis=1) / np.where(mass > 0, mass, 1), 0.0)
                    lettered = np.array(batch.column(2)[i:j], dtype=bool)
                    winner, score = np.where(lettered, winner, len(m.languages)), np.where(lettered, score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(names[winner], pa.string()), pa.array(score, pa.float64()), pa.array(total, pa.int64())],
                    names=[key, "lang_pred", "score", "n_grams"],
                )

    c = F.col(text)
    return docs.select(
        F.col(key), F.coalesce(normalised(c), F.lit("")).alias("text"), F.coalesce(c.rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    ).mapInArrow(run, f"`{key}` {key_type.simpleString()}, lang_pred string, score double, n_grams bigint")
