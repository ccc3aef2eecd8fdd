"""Encoding of a corpus by a public byte-level vocabulary, with reuse of content-defined chunks.

A rolling hash over characters cuts texts where its value says so, so the same passage is cut the same way in every text that
holds it. The inside of a chunk lies between two safe places, where the vocabulary's word pattern always begins a new piece: a blank between a
character that isn't white space and another that isn't. It is encoded once and remembered; what lies between the insides of
neighbouring chunks is encoded anew, and a join grows until it begins and ends at safe places, so that the ids agree exactly with those of the whole
text.

Chunks are remembered by task. Sharing them across tasks would move every text through the network to save
encoding, which costs less than the move.

Defined cases
* A null or empty text has an empty list of ids; special tokens' strings are ordinary text.
* Texts are encoded whole, however long; a text without safe places is one join.
* Repeated texts come out once per row with equal ids; null keys keep their row.
* An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import process_cache, spread

#: Fixed value: how the vocabulary's text is cut into pieces before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters the rolling hash sees, and one cut in so many places on average.
WINDOW, SPACING = 16, 256
#: Characters of chunks a task remembers, about.
MEMO_CHARS = 64_000_000


def encoder(path: str):
    """The vocabulary of a rank file, read once a process."""
    kept = process_cache()
    if ("vocabulary", path) not in kept:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        kept["vocabulary", path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept["vocabulary", path]


def cuts(points: np.ndarray, window: int = WINDOW, spacing: int = SPACING) -> np.ndarray:
    """Places after which a chunk ends, from the code points of a text or of many."""
    n = len(points)
    if n < window:
        return np.empty(0, np.int64)
    x = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    # a buzhash by doubling: the hash of 2k characters from two of k
    h, width = x, 1
    while width < window:
        h = (h[:-width] << np.uint64(width % 64) | h[:-width] >> np.uint64(64 - width)) ^ h[width:] * np.uint64(0xBF58476D1CE4E5B9)
        width *= 2
    return np.flatnonzero((h >> np.uint64(20)) % np.uint64(spacing) == 0) + width


def safe_places(points: np.ndarray) -> np.ndarray:
    """Places of a single blank between two characters that aren't white space."""
    if len(points) < 3:
        return np.empty(0, np.int64)
    # every white-space character, and all below the blank, count as white space: a safe place missed costs nothing
    white = (points <= 0x20) | (points == 0x85) | (points == 0xA0) | (points == 0x1680) | (points == 0x3000)
    white |= ((points >= 0x2000) & (points <= 0x200A)) | ((points >= 0x2028) & (points <= 0x202F)) | (points == 0x205F)
    return np.flatnonzero((points[1:-1] == 0x20) & ~white[:-2] & ~white[2:]) + 1


class ChunkEncoder:
    """Encodes texts by remembered chunks; ``reused`` and ``made`` count the insides of chunks."""

    def __init__(self, encode, memo_chars: int = MEMO_CHARS):
        self.encode = encode
        self.memo: dict[str, list[int]] = {}
        self.room = self.memo_chars = memo_chars
        self.reused = self.made = 0

    def inside(self, chunk: str) -> list[int]:
        got = self.memo.get(chunk)
        if got is not None:
            self.reused += 1
            return got
        self.made += 1
        got = self.encode(chunk)
        self.room -= len(chunk)
        if self.room < 0:
            self.memo.clear()
            self.room = self.memo_chars - len(chunk)
        self.memo[chunk] = got
        return got

    def texts(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; hashes and safe places of all are found together."""
        whole = "".join(t for t in texts if t)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        end = np.cumsum([len(t) if t else 0 for t in texts])
        begin = np.r_[0, end[:-1]] if len(end) else end
        cut = cuts(points)
        if len(cut):  # a window lies within one text, so that a text is cut alike wherever it stands
            cut = cut[cut - WINDOW >= begin[np.searchsorted(end, cut - 1, "right")]]
        safe = safe_places(points)
        if len(safe):
            owner = np.searchsorted(end, safe, "right")
            safe = safe[(safe > begin[owner]) & (safe + 1 < end[owner])]
        bounds = np.unique(np.r_[begin, cut, end])
        lo, hi = np.searchsorted(safe, bounds[:-1]), np.searchsorted(safe, bounds[1:])
        # insides of chunks: between the first and the last safe place
        have = np.flatnonzero(hi - lo >= 2)
        first, last = safe[lo[have]], safe[hi[have] - 1]
        a = np.searchsorted(first, begin).tolist()
        b = np.searchsorted(first, end).tolist()
        first, last = first.tolist(), last.tolist()
        out = []
        for x, y, i, j in zip(begin.tolist(), end.tolist(), a, b):
            ids: list[int] = []
            for f, g in zip(first[i:j], last[i:j]):
                if x < f:
                    ids += self.encode(whole[x:f])
                ids += self.inside(whole[f:g])
                x = g
            if x < y:
                ids += self.encode(whole[x:y])
            out.append(ids)
        return out


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``key, ids`` of every row; ``vocabulary`` is the path of a rank file that every executor can read."""
    src = spread(df.select(F.col(key), F.col(text).cast("string").alias("__text")))
    schema = T.StructType([src.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ChunkEncoder(encoder(vocabulary).encode_ordinary)
        for batch in batches:
            ids = machine.texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], schema.names)

    return src.mapInArrow(run, schema)
