"""Token counts by a whole-token shortcut: pre-tokens that are one token are counted, only the rest is merged.

``proven`` encodes every string of the vocabulary alone and keeps those that come
back as one token. What a byte-level BPE makes of a pre-token depends on nothing
but the pre-token, so such a string counts 1 wherever the pre-tokenizer cuts it
out. In a text, pre-tokens are found by the tokenizer's own rule, proven ones add
1 each, and the distinct others are encoded by the library, with a cache of
bounded size per worker.

The rule sees letters, numbers and white space. ``safe_classes`` checks that the
regular expression module sorts a code point the way the tokenizer does; a piece
of text with any other code point is encoded by the library instead.

Texts are worked on in pieces of about ``PIECE`` characters. They are cut in front
of white space that follows something else, where a pre-token ends in any case,
so the counts are those of the whole text. Memory follows the longest stretch
without white space, and the longest text only by the text itself.

Special cases: a null or empty text has no bytes and no tokens. Strings of special
tokens inside a text count as the special token, which is the library's default.
Repeated rows are counted one by one; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the byte-level pre-tokenizer's rule.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 16
CACHED, CACHED_LENGTH = 500_000, 64


def byte_letters() -> dict[str, int]:
    """The byte that each letter of the vocabulary stands for: printable bytes stand for themselves, the rest follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _checked(path: str) -> tuple[list[str], list[str]]:
    """Vocabulary strings and special strings of a byte-level BPE file; other kinds are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model, added = spec["pre_tokenizer"] or {}, spec["model"], spec["added_tokens"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model["type"] == "BPE"
    if not plain or spec["normalizer"] or spec["post_processor"] or model.get("dropout") or any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("the shortcut is proven for plain byte-level BPE files only")
    letters = byte_letters()
    words = []
    for v in model["vocab"]:
        try:
            words.append(bytes(letters[c] for c in v).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character, or a special token
    return words, [a["content"] for a in added]


def proven(path: str) -> frozenset[str]:
    """Vocabulary strings which alone are one token; at most as many as the vocabulary."""
    words, special = _checked(path)
    words = [w for w in words if not any(s in w for s in special)]
    found = _load(path).encode_batch_fast(words, add_special_tokens=False)
    return frozenset(w for w, e in zip(words, found) if len(e.ids) == 1)


def safe_classes(path: str, last: int = 0xFFFF) -> str:
    """Code points up to ``last`` which the tokenizer and the module sort alike, as the inside of a character class.

    Next to letters, digits, marks, blanks and itself, a code point either joins or
    begins a new pre-token, which tells its class; the cuts of both are compared.
    """
    cut = _load(path).pre_tokenizer.pre_tokenize_str
    rule = regex.compile(RULE)
    points = [c for c in range(1, last + 1) if not 0xD800 <= c <= 0xDFFF]
    good = []
    for at in range(0, len(points), 256):
        part = points[at : at + 256]
        ok = _same(cut, rule, part) or [_same(cut, rule, [c]) for c in part]
        good += part if ok is True else [c for c, o in zip(part, ok) if o]
    runs: list[list[int]] = []
    for c in good:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in runs)


def _same(cut, rule, part: list[int]) -> bool:
    probe = "".join(f"a{chr(c)}a 1{chr(c)}1 !{chr(c)}! {chr(c)}  {chr(c)}{chr(c)}b\n" for c in part)
    return [probe[a:b] for _, (a, b) in cut(probe)] == rule.findall(probe)


def cuts(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut in front of white space that follows something else."""
    at = 0
    while len(text) - at > size:
        found = _SEAM.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:] if at else text


_SEAM = regex.compile(r"\S(?=\s)")


class Counter:
    """Number of tokens of a text; one per worker and tokenizer file."""

    def __init__(self, path: str, one: frozenset[str], safe: str):
        self._encode = _load(path)
        _, special = _checked(path)
        self._special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._rule = regex.compile(RULE)
        self._unsafe = regex.compile(f"[^{safe}]")
        self._one = one
        self._known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        return sum(self._piece(p) for p in cuts(text))

    def _piece(self, piece: str) -> int:
        if not piece.isascii() and self._unsafe.search(piece):
            return len(self._encode.encode(piece, add_special_tokens=False).ids)
        if self._special is None or not self._special.search(piece):
            return self._plain(piece)
        parts = self._special.split(piece)
        return len(parts) - 1 + sum(self._plain(p) for p in parts)

    def _plain(self, piece: str) -> int:
        found = self._rule.findall(piece)
        rest = [w for w in found if w not in self._one]
        if not rest:
            return len(found)
        new = list(set(rest).difference(self._known))
        if new:
            if len(self._known) + len(new) > CACHED:
                self._known.clear()
                new = list(set(rest))
            self._known.update(zip(new, (len(e.ids) for e in self._encode.encode_batch_fast(new, add_special_tokens=False))))
        known = self._known
        total = len(found) - len(rest) + sum(map(known.__getitem__, rest))
        for w in new:
            if len(w) > CACHED_LENGTH:
                del known[w]
        return total


@lru_cache(maxsize=2)
def _counter(path: str, one: frozenset[str], safe: str) -> Counter:
    return Counter(path, one, safe)


def count(docs: DataFrame, path: str, *, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row; the proven strings (about 1 MB) travel with the task."""
    one, safe = proven(path), safe_classes(path)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _counter(path, one, safe)
        for batch in batches:
            texts = batch.column(2)
            found = [tokens(t.as_py()) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["__key", "n_bytes", "n_tokens"])

    bytes_of = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    counted = docs.select(F.col(key).alias("__key"), bytes_of.alias("n_bytes"), F.col(text).alias("__text")).mapInArrow(run, f"__key {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("__key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
