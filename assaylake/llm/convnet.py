"""Quality classifier: a convolutional network over the bytes of a whole document, in numpy.

A document is covered by overlapping chunks of ``WIDTH`` bytes, ``STRIDE``
apart. Every byte has a learned vector, every filter is a learned weight over
the vectors of one chunk. Filter responses are max-pooled over segments of
``SEGMENT`` chunks; the mean and the maximum over all segments enter one
logistic unit. Prediction goes through a long text ``GROUP`` segments at a time and
keeps only the running sum and maximum, so memory does not follow its length. The network is fitted by gradient descent on a bounded sample of
labelled rows; prediction is one pass without a shuffle.

Special cases: a null or empty text is one chunk of zero bytes and gets a score
like any other; repeated rows get equal scores; other columns are ignored.
Without at least ten rows of both labels the score is 0.5 for every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.blocks import blocks
from assaylake.llm.frames import SAMPLE_BYTES, labelled_sample

WIDTH, STRIDE, SEGMENT = 12, 4, 32
GROUP = 2048  # segments of a long text that are worked on together (256 kB)


@dataclass
class ByteNet:
    vectors: np.ndarray  # (256, size) per byte
    filters: np.ndarray  # (WIDTH * size, filters)
    bias: np.ndarray
    mean_weight: np.ndarray
    max_weight: np.ndarray
    offset: np.ndarray  # (1,)

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.mean_weight, self.max_weight, self.offset]


def start(seed: int = 5, size: int = 6, filters: int = 24) -> ByteNet:
    rng = np.random.default_rng(seed)
    f = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    return ByteNet(f(256, size, s=0.5), f(WIDTH * size, filters, s=0.25), np.zeros(filters, np.float32), f(filters, s=0.1), f(filters, s=0.1), np.zeros(1, np.float32))


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all chunks (chunks, WIDTH), grouped by document and padded to whole segments, and segment bounds.

    Padding repeats a document's last chunk, which changes no maximum.
    """
    size = np.diff(offsets)
    per_doc = np.maximum(-(-(size - WIDTH) // STRIDE), 0) + 1
    segments = -(-per_doc // SEGMENT)
    bounds = np.concatenate([[0], np.cumsum(segments)])
    doc = np.repeat(np.arange(len(size)), segments * SEGMENT)
    inside = np.arange(len(doc)) - np.repeat(bounds[:-1] * SEGMENT, segments * SEGMENT)
    at = np.minimum(inside, per_doc[doc] - 1) * STRIDE
    place = at[:, None] + np.arange(WIDTH)
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    where = np.where(place < size[doc][:, None], offsets[:-1][doc][:, None] + place, len(data))
    return padded[where], bounds


def forward(net: ByteNet, window: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits per document and what the gradient needs."""
    vec = net.vectors[window].reshape(len(window), -1)
    z = (vec @ net.filters).reshape(-1, SEGMENT, net.filters.shape[1])
    top = z.max(axis=1) + net.bias
    act = np.maximum(top, 0)
    count = np.diff(bounds)
    total = np.concatenate([np.zeros((1, act.shape[1])), np.cumsum(act, axis=0, dtype=np.float64)])
    mean = ((total[bounds[1:]] - total[bounds[:-1]]) / count[:, None]).astype(np.float32)
    most = np.maximum.reduceat(act, bounds[:-1], axis=0)
    return mean @ net.mean_weight + most @ net.max_weight + net.offset[0], (vec, z, top, act, mean, most)


def logits(net: ByteNet, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``forward`` without what the gradient needs, in bounded memory for one long text."""
    step = GROUP * SEGMENT * STRIDE
    if len(offsets) != 2 or len(data) <= step:
        return forward(net, *chunks(data, offsets))[0].astype(np.float64)
    total, most, count = np.zeros(net.filters.shape[1]), np.zeros(net.filters.shape[1], np.float32), 0
    for at in range(0, len(data), step):
        if at and len(data) - at <= WIDTH - STRIDE:
            break  # these bytes belong to the last chunk of the group before
        part = data[at : at + step + WIDTH - STRIDE]
        act = forward(net, *chunks(part, np.array([0, len(part)])))[1][3]
        total, most, count = total + act.sum(axis=0, dtype=np.float64), np.maximum(most, act.max(axis=0)), count + len(act)
    return np.array([(total / count).astype(np.float32) @ net.mean_weight + most @ net.max_weight + net.offset[0]], np.float64)


def _gradients(net: ByteNet, window: np.ndarray, bounds: np.ndarray, gold: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    logit, (vec, z, top, act, mean, most) = forward(net, window, bounds)
    d = ((1 / (1 + np.exp(-logit)) - gold) * weight / weight.sum()).astype(np.float32)
    doc = np.repeat(np.arange(len(gold)), np.diff(bounds))
    d_act = (d / np.diff(bounds))[doc][:, None] * net.mean_weight
    hit = act == most[doc]
    d_act += np.where(hit, d[doc][:, None] * net.max_weight, 0)
    d_top = np.where(top > 0, d_act, 0).astype(np.float32)
    arg = z.argmax(axis=1)
    rows = (np.arange(len(arg)) * SEGMENT)[:, None] + arg  # (segments, filters): winning chunk
    d_filters = np.zeros_like(net.filters)
    d_vec = np.zeros((256, net.vectors.shape[1]), np.float32)
    for f in range(net.filters.shape[1]):
        g = d_top[:, f]
        live = np.flatnonzero(g)
        r = rows[live, f]
        d_filters[:, f] = g[live] @ vec[r]
        spread = (g[live][:, None] * net.filters[:, f][None]).reshape(-1, net.vectors.shape[1])
        codes = window[r].reshape(-1)
        for k in range(net.vectors.shape[1]):
            d_vec[:, k] += np.bincount(codes, weights=spread[:, k], minlength=256)
    return [d_vec, d_filters, d_top.sum(axis=0), mean.T @ d, most.T @ d, np.array([d.sum()], np.float32)]


def batches_of(order: np.ndarray, sizes: list[int], most: int, most_bytes: int = 1 << 19) -> Iterator[np.ndarray]:
    """Rows in order, at most ``most`` and about ``most_bytes`` at a time; a longer text is a batch of its own."""
    taken, total = [], 0
    for k in order.tolist():
        if taken and (len(taken) == most or total + sizes[k] > most_bytes):
            yield np.array(taken)
            taken, total = [], 0
        taken.append(k)
        total += sizes[k]
    if taken:
        yield np.array(taken)


def fit(
    docs: DataFrame, labels: DataFrame, *, label: str = "quality", only: Column | None = None, max_rows: int = 2400, max_bytes: int = SAMPLE_BYTES,
    epochs: int = 14, batch: int = 48, rate: float = 0.01, seed: int = 5,
) -> ByteNet | None:
    """Fit on at most ``max_rows`` labelled documents of ``max_bytes`` together; both classes weigh the same."""
    rows = labelled_sample(docs, labels, [label], max_rows, max_bytes, F.col(label).isin(0, 1) if only is None else only & F.col(label).isin(0, 1))
    gold = np.array([r[label] for r in rows], np.float32)
    if len(gold) == 0 or min(gold.sum(), (1 - gold).sum()) < 10:
        return None
    weight = np.where(gold == 1, 0.5 / gold.mean(), 0.5 / (1 - gold.mean())).astype(np.float32)
    raw = [np.frombuffer(r["text"].encode(), np.uint8) for r in rows]
    net, rng, step = start(seed), np.random.default_rng(seed), 0
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for epoch in range(epochs):
        order = rng.permutation(len(raw))
        for pick in batches_of(order, [len(r) for r in raw], batch):
            data = np.concatenate([raw[k] for k in pick])
            offsets = np.concatenate([[0], np.cumsum([len(raw[k]) for k in pick])])
            window, bounds = chunks(data, offsets)
            step += 1
            lr = rate * (1 - epoch / epochs)
            for p, g, (m, v) in zip(net.parameters(), _gradients(net, window, bounds, gold[pick], weight[pick]), state):
                g = g + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.002 * (g * g - v)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)
    return net


def score(docs: DataFrame, net: ByteNet | None, *, text: str = "text", key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """(key, score, predicted) for every whole text; the network is broadcast, its size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1), 1 << 18):
                p = np.full(j - i, 0.5)
                if shared.value is not None:
                    logit = logits(shared.value, data, offsets)
                    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[key, "score", "predicted"]
                )

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {key_type}, score double, predicted int")
