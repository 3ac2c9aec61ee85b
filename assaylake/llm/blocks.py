"""Text columns of Arrow batches as flat byte blocks, and vectorised hashing of spans in them.

Operators that need Python work on whole Arrow batches: the UTF-8 bytes of all
texts of a batch lie in one buffer, so words, lines, shingles and windows of
every text are found with a few numpy calls, without a Python object per word.
Blocks are cut at document borders to about ``BLOCK_BYTES`` so that memory does
not follow the batch size; one document longer than that forms its own block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

# ASCII white space of the word rule [^\x20\x09-\x0D]+.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def pieces(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets inside the block) for a text column."""
    data, offsets = utf8(column)
    for i, j in pieces(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def white_cuts(data: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``size`` that end in front of white space, so no word is cut; a longer word is one range."""
    at = 0
    while at < len(data):
        to = min(at + size, len(data))
        while to < len(data) and not WHITE[data[to]]:
            ahead = np.flatnonzero(WHITE[data[to : to + size]])
            to = min(to + (int(ahead[0]) if len(ahead) else size), len(data))
        yield at, to
        at = to


@lru_cache(maxsize=8)
def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(n + 1, 2 * BLOCK_BYTES)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, xor, multiply), so that all bits of a sum count."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class SpanHash:
    """64-bit hashes of any spans of a block, from one running sum.

    The sum of ``table[byte] * base**position`` up to both ends gives the hash
    of a span after division by ``base**start``; equal bytes give equal hashes
    at any place.
    """

    def __init__(self, data: np.ndarray, seed: int = 1):
        up, self._down = _powers(len(data))
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_table(seed)[data] * up[: len(data)], out=self._sum[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sum[ends] - self._sum[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))

    def rolling(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` bytes, in order of their start."""
        n = len(self._sum) - width
        return mix((self._sum[width:] - self._sum[:n]) * self._down[:n] + np.uint64(width))


def before(mask: np.ndarray, points: np.ndarray, step: int = BLOCK_BYTES) -> np.ndarray:
    """How many entries of ``mask`` are true in front of each of the ascending ``points``, without a running sum over all entries."""
    out, carry = np.zeros(len(points), np.int64), 0
    for a in range(0, len(mask), step):
        part = np.cumsum(mask[a : a + step])
        lo, hi = np.searchsorted(points, [a + 1, a + len(part)], "left")[0], np.searchsorted(points, a + len(part), "right")
        out[lo:hi] = carry + part[points[lo:hi] - a - 1]
        carry += int(part[-1])
    return out


def long_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, step: int = BLOCK_BYTES) -> np.ndarray:
    """Hashes of ascending spans of any length, equal for equal bytes, with memory for one step of the data."""
    if len(data) <= 2 * step:
        return SpanHash(data, seed)(starts, ends)
    points = np.unique(np.concatenate([starts, ends]))
    total, unit = np.zeros(len(points), np.uint64), np.ones(len(points), np.uint64)
    carry, up, down = 0, 1, 1
    powers_up, powers_down = _powers(min(step, len(data)))
    table, every = _table(seed), 1 << 64
    for a in range(0, len(data) + 1, step):
        part = np.concatenate([[np.uint64(0)], np.cumsum(table[data[a : a + step]] * powers_up[: len(data[a : a + step])], dtype=np.uint64)])
        lo, hi = np.searchsorted(points, a, "left"), np.searchsorted(points, a + step, "left")
        here = points[lo:hi] - a
        total[lo:hi] = part[here] * np.uint64(up) + np.uint64(carry)
        unit[lo:hi] = powers_down[here] * np.uint64(down)
        carry = (carry + int(part[-1]) * up) % every
        up, down = up * pow(_BASE, step, every) % every, down * pow(_INVERSE, step, every) % every
    first, last = np.searchsorted(points, starts), np.searchsorted(points, ends)
    return mix((total[last] - total[first]) * unit[first] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words of a block; words end at document borders."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~WHITE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner], after[inner - 1] = False, False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def counts_at(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets into ``positions`` (sorted): where each document's entries begin and end."""
    return np.searchsorted(positions, offsets, "left")


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per document, empty documents give 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    upper = (data >= 0x41) & (data <= 0x5A)
    return np.where(upper, data | 0x20, data).astype(np.uint8)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def give_back() -> None:
    """Return freed memory to the system: Python workers are used again, and what an earlier stage held would count against the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
