"""Similarity sketches of sets, for many sets at once.

A sketch has ``t`` coordinates. In round ``i`` every element of a set is placed in a hashed bin with a hashed value, and a
bin keeps the least ``(round, value)`` it sees; rounds go on until every bin is full, and the rounds from ``t``
on place all elements in one bin each, so at most ``2 t`` rounds fill any set that is not empty. Two sets agree in a coordinate with a probability equal to
their Jaccard similarity, with concentration as if the coordinates were independent.
"""

from __future__ import annotations

import re

import numpy as np
from xxhash import xxh3_64_intdigest

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15
_WORD = re.compile(r"[^\W_]+")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def seed(i: int) -> np.uint64:
    return np.uint64((i + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF)


class WordCodes(dict):
    """64-bit codes of words; a code depends on the word only, the table is a memo of bounded size."""

    MOST = 1_000_000

    def __missing__(self, word: str) -> int:
        code = xxh3_64_intdigest(word)
        if len(self) < self.MOST:
            self[word] = code
        return code

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[str]:
    """The runs of letters and digits of the lower-cased text."""
    return _WORD.findall(text.lower()) if text else []


def sorted_within(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by owner, then value. Few owners fit 16 bits, whose stable sort takes linear time."""
    if len(owner) and int(owner.max()) < 65536:
        order = np.argsort(values)
        return order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    return np.lexsort((values, owner))


def shingle_sets(texts: list[str | None], size: int, codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, one after another and sorted within a text; and where each text begins."""
    words: list[str] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        words += words_of(t)
        ends[i + 1] = len(words)
    c = codes.of(words)
    n = len(c) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = mix(h ^ c[k : k + n]) + seed(k)
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))[:n]
    inside = np.arange(n) + size <= ends[doc + 1]
    h, doc = h[inside], doc[inside]
    order = sorted_within(doc, h)
    h, doc = h[order], doc[order]
    if len(h):
        first = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def sketches(elements: np.ndarray, starts: np.ndarray, t: int) -> np.ndarray:
    """``(sets, t)`` coordinates; a row of an empty set is all ones."""
    sets = len(starts) - 1
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(sets * t, none, np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(starts))
    low = np.uint64((1 << 44) - 1)
    el = elements
    for i in range(2 * t):
        if not len(el):
            break
        x = mix(el ^ seed(100 + i))
        bins = ((x >> np.uint64(44)) * np.uint64(t) >> np.uint64(20)).astype(np.int64) if i < t else np.full(len(el), i - t)
        np.minimum.at(out, owner * t + bins, np.uint64(i) << np.uint64(44) | x & low)
        if i >= 3:
            open_ = (out.reshape(sets, t) == none).any(1)
            keep = open_[owner]
            if not keep.all():
                el, owner = el[keep], owner[keep]
    return out.reshape(sets, t)


def band_keys(sketch: np.ndarray, rows: int, salt: int = 0) -> np.ndarray:
    """``(sets, t // rows)`` 64-bit keys, one per band of ``rows`` coordinates."""
    n, t = sketch.shape
    parts = sketch[:, : t // rows * rows].reshape(n, -1, rows)
    bands = parts.shape[1]
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + seed(salt)), (n, bands))
    for k in range(rows):
        key = mix(key ^ parts[:, :, k]) + seed(k)
    return key


def check_words(sketch: np.ndarray, words: int) -> np.ndarray:
    """``(sets, words)`` 64-bit words, each with four bits of the last 16 coordinates not yet used."""
    n, t = sketch.shape
    out = np.zeros((n, words), np.uint64)
    for w in range(words):
        for k in range(16):
            out[:, w] |= (mix(sketch[:, t - 1 - w * 16 - k]) & np.uint64(15)) << np.uint64(4 * k)
    return out
