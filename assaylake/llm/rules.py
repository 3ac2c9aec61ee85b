"""Quality rules: counts per text, and a linear-chain CRF that labels each line content or boilerplate.

The lines of a document form a sequence. A conditional random field with two
states scores each line by its features (symbols, digits, case, punctuation,
lengths, repeats) and each pair of neighbours by a transition weight; the
Viterbi path labels all lines at once. A document is kept if content lines hold
at least ``min_share`` of its word characters.

The weights are fitted on a bounded sample of ``labels.quality``: every line of
a labelled document carries the document's label. Without usable labels the
prior weights below apply.

Memory is that of the words and lines of a text (about 20 bytes per byte), not of
running sums over its bytes.

Special cases: a null or empty text has no words, fails the base rules and is
not kept. Lines without a word belong to the sequence but hold no characters.
Ties of the Viterbi path go to content. Repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.blocks import WHITE, before, blocks, give_back, long_spans, mix, sums, word_spans
from assaylake.llm.frames import SAMPLE_BYTES, labelled_sample
from assaylake.llm.tokens import forget

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True  # fixed value: the symbol rule
WINDOW = 8  # fixed value: words in a repeated window
FEATURES = ("bias", "symbols", "digits", "upper", "ends", "short", "long_words", "repeated_line", "repeated_words", "no_word", "many_symbols", "stutter")


@dataclass(frozen=True)
class LineModel:
    emission: np.ndarray  # (features,), score of content minus boilerplate
    transition: np.ndarray  # (2, 2), rows: state before; state 1 is content


PRIOR = LineModel(
    np.array([2.0, -8.0, -2.0, -3.0, 0.5, -0.3, -0.5, -2.0, -3.0, 0.0, -2.0, -4.0]), np.array([[0.7, -0.7], [-0.7, 0.7]])
)


@dataclass
class Lines:
    """Counts per document and line features of one block."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_bounds: np.ndarray  # per document, offsets into lines
    features: np.ndarray  # (lines, features)
    line_chars: np.ndarray  # word characters per line


def measure(data: np.ndarray, offsets: np.ndarray) -> Lines:
    n = len(offsets) - 1
    starts, ends = word_spans(data, offsets)
    word_bounds = np.searchsorted(starts, offsets, "left")
    chars = ~WHITE[data] & ((data & 0xC0) != 0x80)
    symbols = SYMBOLS[data]
    doc_of_word = np.repeat(np.arange(n), np.diff(word_bounds))

    # Windows of eight words found twice or more in their document.
    words = long_spans(data, starts, ends)
    covered = np.zeros(len(words) + 1, np.int32)
    if len(words) >= WINDOW:
        first = np.arange(len(words) - WINDOW + 1)
        first = first[doc_of_word[first] == doc_of_word[first + WINDOW - 1]]
        key = doc_of_word[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(WINDOW):
            key = mix(key ^ words[first + k])
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        again = first[times[inverse] > 1]
        covered[again] += 1
        covered[again + WINDOW] -= 1
    repeated = np.cumsum(covered)[:-1] > 0

    stutter = np.zeros(len(words), bool)
    stutter[1:] = (words[1:] == words[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])

    # Lines: documents are cut at every \n, an empty document is one empty line.
    breaks = np.flatnonzero(data == 0x0A)
    per_doc = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    line_bounds = np.zeros(n + 1, np.int64)
    np.cumsum(per_doc, out=line_bounds[1:])
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    # A break in the last place of a document starts an empty line at the next one's offset; sorting keeps the counts right.
    first_word, last_word = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    with_word = last_word > first_word
    doc_of_line = np.repeat(np.arange(n), per_doc)
    key = mix(long_spans(data, line_start, line_end) ^ (doc_of_line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.lexsort((np.arange(len(key)), key))
    same = np.zeros(len(key), bool)
    same[order[1:]] = key[order[1:]] == key[order[:-1]]
    dup = same & with_word

    total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    over = lambda mask: (before(mask, line_end) - before(mask, line_start)).astype(np.float64)
    line_chars, line_symbols = over(chars), over(symbols)
    size = np.maximum(line_chars, 1)
    n_line_words = (last_word - first_word).astype(np.float64)
    tail = np.where(with_word, data[np.maximum(ends[np.maximum(last_word - 1, 0)] - 1, 0)] if len(ends) else 0, 0) if len(data) else np.zeros(len(key))
    features = np.stack([
        np.ones(len(key)),
        np.minimum(line_symbols / size, 1.0),
        over((data >= 0x30) & (data <= 0x39)) / size,
        over((data >= 0x41) & (data <= 0x5A)) / size,
        np.isin(tail, [ord("."), ord("?"), ord("!"), ord(",")]).astype(float),
        (n_line_words < 4).astype(float),
        (line_chars / np.maximum(n_line_words, 1) > 12).astype(float),
        dup.astype(float),
        (total(repeated)[last_word] - total(repeated)[first_word]) / np.maximum(n_line_words, 1),
        (~with_word).astype(float),
        (line_symbols > 0.04 * size).astype(float),
        (total(stutter)[last_word] - total(stutter)[first_word]) / np.maximum(n_line_words, 1),
    ], axis=1)
    return Lines(
        np.diff(word_bounds), np.diff(before(chars, offsets)), np.diff(before(symbols, offsets)), sums(dup, line_bounds), sums(repeated, word_bounds),
        line_bounds, features, line_chars,
    )


def _padded(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents from most to fewest lines, and their line counts."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    return order, length[order]


def viterbi(model: LineModel, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Best label (1: content) of every line, all documents side by side."""
    score = features @ model.emission
    order, length = _padded(bounds)
    begin = bounds[:-1][order]
    labels = np.zeros(len(score), np.int8)
    steps = int(length[0]) if len(length) else 0
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]  # documents with more than t lines
    best = np.zeros((len(order), 2))
    back = []
    for t in range(steps):
        k = active[t]
        emit = np.stack([np.zeros(k), score[begin[:k] + t]], axis=1)
        if t == 0:
            best[:k] = emit
            continue
        paths = best[:k, :, None] + model.transition[None]
        to = np.where(paths[:, 1] >= paths[:, 0], 1, 0)  # ties to content
        back.append(to.astype(np.int8))
        best[:k] = np.take_along_axis(paths, to[:, None, :], axis=1)[:, 0] + emit
    state = np.where(best[:, 1] >= best[:, 0], 1, 0)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        labels[begin[:k] + t] = state[:k]
        if t > 0:
            state[:k] = np.take_along_axis(back[t - 1], state[:k, None], axis=1)[:, 0]
    return labels


def _gradient(model: LineModel, features: np.ndarray, bounds: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean conditional log-likelihood per line (forward-backward)."""
    score = features @ model.emission
    order, length = _padded(bounds)
    begin, steps = bounds[:-1][order], int(length[0])
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]
    emit = np.stack([np.zeros(len(score)), score], axis=1)
    move = np.exp(model.transition)
    forward, scale = np.zeros((len(score), 2)), np.zeros(len(score))
    shift = emit.max(axis=1, keepdims=True)
    local = np.exp(emit - shift)
    for t in range(steps):
        at = begin[: active[t]] + t
        a = local[at] if t == 0 else local[at] * (forward[at - 1] @ move)
        scale[at] = a.sum(axis=1)
        forward[at] = a / scale[at][:, None]
    backward = np.ones((len(score), 2))
    pair = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        ahead = local[at + 1] * backward[at + 1] / scale[at + 1][:, None]
        backward[at] = ahead @ move.T
        pair += np.einsum("ni,ij,nj->ij", forward[at], move, ahead)
    p = forward * backward
    p /= p.sum(axis=1, keepdims=True)
    n = len(score)
    inner = np.ones(n, bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[at - 1], gold[at]), 1)
    return features.T @ (gold - p[:, 1]) / n, (seen - pair) / n


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 3000, max_bytes: int = SAMPLE_BYTES, rounds: int = 200, ridge: float = 1e-3, transition_ridge: float = 1e-2) -> LineModel:
    """Fit on at most ``max_rows`` labelled documents of ``max_bytes`` together (Adam on the log-likelihood)."""
    rows = labelled_sample(docs, labels, ["quality"], max_rows, max_bytes, F.col("quality").isin(0, 1))
    good, bad = [r["text"] for r in rows if r["quality"] == 1], [r["text"] for r in rows if r["quality"] == 0]
    if len(good) < 10 or len(bad) < 10:
        return PRIOR
    texts, gold_of = good + bad, [1] * len(good) + [0] * len(bad)
    parts, golds, sizes = [], [], []
    for i, j, data, offsets in blocks(pa.array(texts, pa.string())):
        m = measure(data, offsets)
        parts.append(m.features)
        sizes.append(np.diff(m.line_bounds))
        golds.append(np.repeat(np.array(gold_of[i:j]), np.diff(m.line_bounds)))
    features, gold = np.concatenate(parts), np.concatenate(golds)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    emission, transition = PRIOR.emission.copy(), PRIOR.transition.copy()
    state = [np.zeros_like(emission), np.zeros_like(emission), np.zeros_like(transition), np.zeros_like(transition)]
    for step in range(1, rounds + 1):
        g, h = _gradient(LineModel(emission, transition), features, bounds, gold)
        for k, (w, d) in enumerate(((emission, g - ridge * emission), (transition, h - transition_ridge * transition))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            w += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return LineModel(emission, transition)


def _decide(model: LineModel, data: np.ndarray, offsets: np.ndarray, min_words: int, max_repeat: int, min_share: float) -> tuple:
    d = measure(data, offsets)
    content = viterbi(model, d.features, d.line_bounds)
    share = sums(d.line_chars * content, d.line_bounds) / np.maximum(d.word_chars, 1)
    failed = (d.n_words < min_words) | (100 * d.n_repeat_words > max_repeat * d.n_words)
    return d, failed, ~failed & (share >= min_share), content, share


def apply(docs: DataFrame, model: LineModel, *, text: str = "text", key: str = "doc_id", min_words: int = 20, max_repeat: int = 30, min_share: float = 0.5) -> DataFrame:
    """Counts, content share and decision for every document; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key_type = docs.schema[key].dataType.simpleString()
    names = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_content_lines", "content_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        give_back()
        m = shared.value
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                d, failed, kept, content, share = _decide(m, data, offsets, min_words, max_repeat, min_share)
                columns = [d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, kept,
                           np.diff(d.line_bounds), sums(content, d.line_bounds), share]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *[pa.array(c) for c in columns]], names=names)

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(
        run,
        f"`{key}` {key_type}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, kept boolean, n_lines bigint, n_content_lines bigint, content_share double",
    )


def keep(docs: DataFrame, model: LineModel, *, text: str = "text", min_words: int = 20, max_repeat: int = 30, min_share: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that ``apply`` would keep, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        give_back()
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(_decide(shared.value, data, offsets, min_words, max_repeat, min_share)[2]))

    return docs.mapInArrow(run, docs.schema)
