"""Passages of evaluation items in corpus documents.

Items and documents are cut into windows of as many words as a passage must share. A window is embedded by a random walk that maps edit distance to
Hamming distance: at step ``j`` the walk puts out the word it stands on and, by a random bit that the step and the word fix, stays or moves on.
Sampled positions of the output are a key of the window. Windows a few edits apart agree in a key with a probability that ``repeats_for`` measures on
random windows; it gives the number of keys that finds them with the recall asked for. A document window that meets a key of an item is compared
with the item's window word by word, with at most ``edits`` edits. Equal windows have equal walks, so with no edits
allowed one key finds all of them.

The items' keys are sent to the tasks behind a check of their number. Beyond ``MAX_WINDOWS`` the keys of both sides are joined instead, of the documents only
those that a Bloom filter of the items' keys lets pass; its size is bounded. Documents are read once and never shuffled in the first form.

Defined cases
* Words are runs of letters and digits after compatibility decomposition, without case, accents and invisible format characters.
* Null, empty and shorter texts than a window, of items and documents, leak nothing.
* A window that several items share counts for each of them; repeated documents and repeated items give distinct pairs once.
* Two windows are ``n`` edits apart if so many words put in, left out or replaced make one of them the beginning of the other.
* Documents are read whole, however long. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.sketching import WordCodes, mix, seed
from corvane.session import spread, stage

#: Words of a passage.
WORDS = 12
#: Items' windows that are sent to tasks, at most.
MAX_WINDOWS = 2_000_000
#: Positions sampled for a key where windows must be equal, and where edits are allowed.
SAMPLED, SAMPLED_EDITED = 8, 3
#: Share of the windows within the edits allowed that are to be found, and keys of a window at most.
RECALL, MAX_REPEATS = 0.95, 128
#: Bits of the filter of item keys: so many for each key, and at least and at most so many.
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 16, 1 << 16, 1 << 29

_MARKS = regex.compile(r"[\p{M}\p{Cf}]+")
_RUNS = regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str) -> list[str]:
    """The words that are compared."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        text = text.casefold()
        if not text.isascii():  # folding may bring back marks
            text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    else:
        text = text.lower()
    return _RUNS.findall(text)


def windows(texts: list[str | None], size: int, codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """The word codes of all texts in one array, and where a window begins; also its text, as ``(start, text)`` rows."""
    words: list[str] = []
    ends = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            words += words_of(t)
        ends[i] = len(words)
    at = np.arange(max(0, len(words) - size + 1))
    owner = np.searchsorted(ends, at, "right")
    inside = at + size <= ends[owner] if len(at) else np.zeros(0, bool)
    return codes.of(words), np.stack([at[inside], owner[inside]], 1) if len(at) else np.empty((0, 2), np.int64)


def walk_keys(codes: np.ndarray, starts: np.ndarray, size: int, repeat: int, sampled: int = SAMPLED) -> np.ndarray:
    """The key of each window: the walk's output at sampled positions, hashed.

    The walk runs over all windows at once, a step at a time. It has ``3 * size`` steps; past the window's end it puts
    out nothing more.
    """
    steps = 3 * size
    rng = np.random.default_rng(1000 + repeat)
    chosen = set(rng.choice(2 * size, min(sampled, 2 * size), replace=False).tolist())
    place = np.zeros(len(starts), np.int64)
    key = np.full(len(starts), seed(repeat), np.uint64)
    for j in range(min(steps, max(chosen) + 1)):
        live = place < size
        word = np.where(live, codes[np.minimum(starts + place, len(codes) - 1)], np.uint64(0))
        if j in chosen:
            key = mix(key ^ word) + seed(j)
        place += (mix(word ^ seed(5000 + repeat * steps + j)) & np.uint64(1)).astype(np.int64) & live
    return key


def repeats_for(size: int, edits: int, recall: float = RECALL) -> int:
    """How many keys find windows of a size that are so many edits apart, as often as asked.

    Measured on random windows, always the same ones, with words left out, replaced or put in; the kind found least often counts.
    """
    if edits == 0:
        return 1
    rng = np.random.default_rng(17)
    n = 600
    a = rng.integers(0, 2**63, (3 * n, size)).astype(np.uint64)
    b = np.empty_like(a)
    for i, row in enumerate(a):
        words, kind = row.tolist(), i // n
        for _ in range(edits):
            at = int(rng.integers(0, len(words)))
            words[at : at + (kind != 2)] = [int(rng.integers(0, 2**63))] * (kind != 0)
        b[i] = (words + rng.integers(0, 2**63, edits).tolist())[:size]
    starts = np.arange(3 * n) * size
    met = np.zeros(3 * n, bool)
    for r in range(MAX_REPEATS):
        met |= walk_keys(a.ravel(), starts, size, r, SAMPLED_EDITED) == walk_keys(b.ravel(), starts, size, r, SAMPLED_EDITED)
        if met.reshape(3, n).mean(1).min() >= recall:
            return r + 1
    raise ValueError(f"{MAX_REPEATS} keys don't find windows of {size} words with {edits} edits as often as {recall}: use longer windows")


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which windows, row by row, are at most so many word edits apart; the end of either may be left over."""
    if most == 0:
        return (a == b).all(1)
    n, size = a.shape
    row = np.broadcast_to(np.arange(size + 1), (n, size + 1)).astype(np.int16)
    best = row[:, size].copy()
    for i in range(1, size + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        step = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i - 1, None] != b))
        for j in range(1, size + 1):
            new[:, j] = np.minimum(step[:, j - 1], new[:, j - 1] + 1)
        row = new
        best = np.minimum(best, row[:, size])
    return np.minimum(best, row.min(1)) <= most


def _met(keys: np.ndarray, item_keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of windows, of a text and of an item, that meet in a key."""
    sorted_keys = item_keys[order]
    lo, hi = np.searchsorted(sorted_keys, keys), np.searchsorted(sorted_keys, keys, "right")
    hit = np.flatnonzero(hi > lo)
    n = hi[hit] - lo[hit]
    left = np.repeat(hit, n)
    right = order[np.repeat(lo[hit] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(hit) else np.empty(0, np.int64)
    return left, right


def leaks(
    documents: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text",
    size: int = WORDS, edits: int = 0, recall: float = RECALL, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """``doc_key, item_key``: the documents and the items of which they hold a passage, with at most so many edits.

    With edits a passage of one window is found with at least the recall; longer ones have several windows.
    """
    docs = documents.select(F.col(doc_key), F.col(text).cast("string").alias("__text")).where("__text is not null")
    asked = items.select(F.col(item_key), F.col(text).cast("string").alias("__text")).where("__text is not null")
    schema = T.StructType([docs.schema[doc_key], asked.schema[item_key]])
    repeats, sampled = repeats_for(size, edits, recall), SAMPLED_EDITED if edits else SAMPLED
    # a window begins at a word, so half the characters bound the windows from above
    bound = asked.agg(F.sum(F.length("__text") / 2)).first()[0] or 0
    if bound * repeats > max_windows:
        return _joined(docs, asked, doc_key, item_key, size, edits, repeats, sampled, bound)
    table = asked.toArrow()
    ids = table.column(0).combine_chunks()
    item_codes, item_where = windows(table.column(1).to_pylist(), size, WordCodes())
    item_keys = [walk_keys(item_codes, item_where[:, 0], size, r, sampled) for r in range(repeats)]
    orders = [np.argsort(k, kind="stable") for k in item_keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        span = np.arange(size)
        for batch in batches:
            flat, where = windows(batch.column(1).to_pylist(), size, codes)
            found = np.empty(0, np.int64)
            for r in range(repeats):
                left, right = _met(walk_keys(flat, where[:, 0], size, r, sampled), item_keys[r], orders[r])
                pair = where[left, 1] * len(ids) + item_where[right, 1]
                new = ~np.isin(pair, found)  # a document and an item that are found aren't compared again
                left, right, pair = left[new], right[new], pair[new]
                for i in range(0, len(left), 100_000):
                    j = slice(i, i + 100_000)
                    good = edits_within(flat[where[left[j], 0][:, None] + span], item_codes[item_where[right[j], 0][:, None] + span], edits)
                    found = np.union1d(found, pair[j][good])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found // len(ids))), ids.take(pa.array(found % len(ids)))], schema.names)

    return spread(docs).mapInArrow(run, schema).distinct()


def _key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the ``key`` column with two bits a key, as bytes: tasks fill parts, which are put together part by part."""
    part = FILTER_LEAST // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _bits(np.asarray(batch.column(0)).view(np.uint64), bits):
                np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = own.reshape(-1, part)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["part", "bytes"])

    def unite(table: pa.Table) -> pa.Table:
        own = np.zeros(part, np.uint8)
        for b in table.column("bytes"):
            own |= np.frombuffer(b.as_py(), np.uint8)
        return pa.table({"part": table.column("part")[:1], "bytes": pa.array([own.tobytes()], pa.binary())})

    out = np.zeros((bits // 8 // part, part), np.uint8)
    for r in keys.select("key").mapInArrow(fill, "part int, bytes binary").groupBy("part").applyInArrow(unite, "part int, bytes binary").collect():
        out[r["part"]] = np.frombuffer(r["bytes"], np.uint8)  # no more than FILTER_MOST bits in all
    return out.reshape(-1)


def _bits(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(keys ^ seed(90 + k)) & np.uint64(bits - 1)).astype(np.int64) for k in (0, 1)]


def _joined(docs, asked, doc_key, item_key, size, edits, repeats, sampled, bound) -> DataFrame:
    """For items too many to send: windows of both sides meet by key in a shuffle, with their words, of the documents those the filter lets pass."""

    def rows(df: DataFrame, key: str, name: str, sieve=None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = WordCodes()
            held = None if sieve is None else sieve.value
            for batch in batches:
                flat, where = windows(batch.column(1).to_pylist(), size, codes)
                for r in range(repeats):
                    keys = walk_keys(flat, where[:, 0], size, r, sampled)
                    at = where
                    if held is not None:
                        one, two = _bits(keys, len(held) * 8)
                        let = (held[one >> 3] >> (one & 7).astype(np.uint8)) & (held[two >> 3] >> (two & 7).astype(np.uint8)) & 1 == 1
                        keys, at = keys[let], where[let]
                    span = flat[at[:, 0][:, None] + np.arange(size)].view(np.int64)
                    words = pa.FixedSizeListArray.from_arrays(pa.array(span.reshape(-1)), size).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(at[:, 1])), words], ["key", name, f"{name}_words"])

        kind = df.schema[key].dataType.simpleString()
        return spread(df).mapInArrow(run, f"key bigint, {name} {kind}, {name}_words array<bigint>")

    right = stage(rows(asked, item_key, "__item").dropDuplicates(["key", "__item", "__item_words"]), "items")
    bits = 1 << min(FILTER_MOST, max(FILTER_LEAST, int(bound * repeats * FILTER_BITS))).bit_length() - 1
    sieve = docs.sparkSession.sparkContext.broadcast(_key_filter(right, bits))
    met = rows(docs, doc_key, "__doc", sieve).join(right, "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(c).flatten()).reshape(-1, size) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(edits_within(a, b, edits)))

    kinds = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in ("__doc", "__item"))
    agreed = met.select("__doc", "__item", "__doc_words", "__item_words").mapInArrow(verify, kinds)
    return agreed.select(F.col("__doc").alias(doc_key), F.col("__item").alias(item_key)).distinct()
