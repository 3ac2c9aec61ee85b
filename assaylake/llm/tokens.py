"""Token ids of whole texts with a given tokenizer file, one pass over Arrow batches.

A byte-level pre-tokenizer joins at most one blank to the letters behind it and
never letters to punctuation, so a text may be cut at such places and the parts
encoded one by one. Parts repeat a lot; each worker keeps the ids of parts it
has met in a cache of bounded size, and encodes new words many at a time. A text
with any other white space or control character is encoded in one piece.
"""

from __future__ import annotations

import os
import re

import numpy as np

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_STOPS = ".,;:!?|#*$%&"
_PARTS = re.compile(
    rf"\n(?=[^ \n])| ?[{_LETTERS}]+(?=[ \n{_STOPS}]|\Z)|[{_STOPS}]+(?=[ \n]|\Z)|[ \n]*[^ \n]+|[ \n]+"
)
_WORD = re.compile(rf" [{_LETTERS}]+\Z")
_ODD = re.compile("[\\x00-\\x09\\x0b-\\x1f\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff]")
CACHED_PARTS, CACHED_LENGTH, TOGETHER = 600_000, 48, 512

_LOADED: dict = {}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._cache: dict[str, bytes] = {}

    def _whole(self, parts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with a blank, encoded as running text and cut at its words."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        out = []
        for group, e in zip(groups, self._tokenizer.encode_batch(["".join(g) for g in groups], add_special_tokens=False)):
            raw = np.array(e.ids, "<u4").tobytes()
            cuts = [0, *(4 * (np.flatnonzero(np.diff(e.word_ids)) + 1)).tolist(), len(raw)]
            if len(cuts) != len(group) + 1:
                raise RuntimeError("the tokenizer does not cut words at blanks")
            out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        parts = [None if not t or _ODD.search(t) else _PARTS.findall(t) for t in texts]
        new = set().union(*[p for p in parts if p]).difference(self._cache)
        if len(self._cache) + len(new) > CACHED_PARTS:
            self._cache.clear()
            new = set().union(*[p for p in parts if p])
        words = [p for p in new if _WORD.match(p)]
        others = [p for p in new if not _WORD.match(p)]
        fresh = dict(zip(words, self._words(words))) | dict(zip(others, self._whole(others)))
        long = {p: ids for p, ids in fresh.items() if len(p) > CACHED_LENGTH}
        self._cache.update(fresh)
        cache = self._cache
        out = [b"".join([cache[p] for p in row]) if row else self._whole([t])[0] if t else b"" for t, row in zip(texts, parts)]
        for p in long:
            del cache[p]
        return out


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def forget() -> None:
    """Drop the cached parts of a worker that is used again by a stage which encodes nothing."""
    for e in _LOADED.values():
        e._cache.clear()
