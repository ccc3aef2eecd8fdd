"""Near-duplicate texts: similarity sketches, banding, exact verification.

One pass over the texts makes shingle sets and their sketches. Texts of equal shingle sets are one class, known by
a 128-bit signature of the set and its size; only classes are banded, so a group of copies costs a class however large it is.
Classes that share a band are candidates; four-bit check coordinates outside the bands thin them out, and the rest are compared exactly
on their whole shingle sets, for which the texts of candidate classes, and no others, are read again.

The result has two forms. ``classes`` gives a row per text with its class and the class's number of links: its size grows with the texts. ``expand`` gives
every pair of ids, copies too, whatever the size of a group: it grows with the square of a group of copies, in blocks that no task holds more than two of.

With ``rows`` 5 and ``bands`` 64 the bands find a pair of similarity 0.6 with probability 0.994, one of 0.65 with 0.9996 and one of
0.7 or more with 0.99999; no bucket, partner or candidate is capped.

Defined cases
* Null, empty and short texts (fewer words than a shingle) have no shingles and are similar to nothing.
* Rows with a null id are left out; rows repeated under one id count once; an id with several texts has the pairs of each of them,
  never one with itself.
* Texts that differ only outside words, or in the order of shingles, are copies (similarity 1).
* Very long texts are processed whole. An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.sketching import WordCodes, band_keys, check_words, mix, seed, shingle_sets, sketches, sorted_within
from corvane.session import spread, stage, unstage

#: Words of check coordinates.
CHECKS = 2
#: Of the 32 check coordinates so many agree at least; at similarity 0.6 fewer do with probability 0.001.
AGREE = 12
#: A key with more classes is paired in blocks of about as many instead of in one task.
HOT = 2000
#: Members of a block of copies.
BLOCK = 1000


def _signatures(elements: np.ndarray, starts: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit signatures of each set and its size."""
    n = len(starts) - 1
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(n), sizes)
    out = []
    for k in (0, 1):
        total = np.zeros(n, np.uint64)
        np.add.at(total, owner, mix(elements ^ seed(7 + salt + 1000 * k)))
        out.append(mix(total ^ sizes.astype(np.uint64) ^ seed(salt + 1000 * k)).view(np.int64))
    return out[0], out[1]


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, tkey, text``: a text is found again by its id and its hash."""
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    return rows.select("id", F.xxhash64("text").alias("tkey"), "text")


def fingerprints(df: DataFrame, name: str, key: str, text: str, *, size: int, rows: int, bands: int, salt: int) -> DataFrame:
    """``tbl, id, tkey, sig, sig2, c0, c1, keys`` of every text with a shingle; check words and keys only at the first text of a class in a task."""
    src = spread(_texts(df, key, text))
    t = rows * bands + 16 * CHECKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        seen: set[int] = set()
        for batch in batches:
            elements, starts = shingle_sets(batch.column(2).to_pylist(), size, codes)
            have = np.flatnonzero(np.diff(starts))
            starts = np.r_[starts[have], starts[-1]] if len(have) else np.zeros(1, np.int64)
            sig, sig2 = _signatures(elements, starts, salt)
            first = np.zeros(len(sig), bool)
            for i, (s, s2) in enumerate(zip(sig.tolist(), sig2.tolist())):
                whole = s << 64 ^ s2
                if whole not in seen:
                    seen.add(whole)
                    first[i] = True
            new = np.flatnonzero(first)
            sizes = np.diff(starts)
            part = np.concatenate([elements[starts[i] : starts[i + 1]] for i in new]) if len(new) else elements[:0]
            sketch = sketches(part, np.r_[0, np.cumsum(sizes[new])], t)
            keys = band_keys(sketch, rows, salt)[:, :bands].view(np.int64)
            check = check_words(sketch, CHECKS).view(np.int64)
            place = np.where(first, np.cumsum(first) - 1, -1)
            take = pa.array(place, mask=place < 0)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), bands) if len(new) else pa.array([], pa.list_(pa.int64(), bands))
            lists = flat.cast(pa.list_(pa.int64())).take(take) if len(new) else pa.nulls(len(sig), pa.list_(pa.int64()))
            pick = pa.array(have)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(sig), pa.string()),
                    batch.column(0).take(pick),
                    batch.column(1).take(pick),
                    pa.array(sig),
                    pa.array(sig2),
                    *[pa.array(check[:, c]).take(take) if len(new) else pa.nulls(len(sig), pa.int64()) for c in range(CHECKS)],
                    lists,
                ],
                ["tbl", "id", "tkey", "sig", "sig2", "c0", "c1", "keys"],
            )

    return src.mapInArrow(run, "tbl string, id string, tkey bigint, sig bigint, sig2 bigint, c0 bigint, c1 bigint, keys array<bigint>")


def _agreeing(a: Column, b: Column) -> Column:
    """In how many of 16 four-bit fields two words agree."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return 16 - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes of one key, from rows sorted by key; rows of a hot key come back as they are."""
    keys, sigs = np.empty(0, np.int64), np.empty(0, np.int64)
    hot_key = None

    def rows(k: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(s), pa.nulls(len(s), pa.int64()), pa.array(k)], ["a", "b", "key"])

    def pairs(k: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = np.r_[False, k[1:] == k[:-1], False]
        met = same[1:] | same[:-1]  # most keys have one row: only the others are sorted by class
        k, s = k[met[: len(k)]], s[met[: len(s)]]
        if len(k):  # copies met in several tasks
            order = np.lexsort((s, k))
            k, s = k[order], s[order]
            new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
            k, s = k[new], s[new]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
        size = np.diff(np.r_[start, len(k)])
        hot = np.repeat(size > HOT, size)
        if hot.any():
            yield rows(k[hot], s[hot])
            k, s = k[~hot], s[~hot]
        at = np.arange(len(k))
        step = 1
        while len(at):
            at = at[at + step < len(k)]
            at = at[k[at] == k[at + step]]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(s[at]), pa.array(s[at + step]), pa.nulls(len(at), pa.int64())], ["a", "b", "key"])
            step += 1

    for batch in batches:
        k, s = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if hot_key is not None:
            n = int(np.searchsorted(k, hot_key, "right"))
            if n:
                yield rows(k[:n], s[:n])
            k, s = k[n:], s[n:]
            if not len(k):
                continue
            hot_key = None
        keys, sigs = np.r_[keys, k], np.r_[sigs, s]
        # the last key may go on in the next batch
        cut = int(np.searchsorted(keys, keys[-1]))
        yield from pairs(keys[:cut], sigs[:cut])
        keys, sigs = keys[cut:], sigs[cut:]
        if len(keys) > 4 * HOT:
            hot_key = keys[-1]
            yield rows(keys, sigs)
            keys, sigs = keys[:0], sigs[:0]
    yield from pairs(keys, sigs)


def block_pairs(df: DataFrame, group: list[str], item: str, most: int) -> DataFrame:
    """``group, x, y`` of all pairs of different items of a group, x < y. A group is dealt to blocks of about ``most`` items,
    and each pair of blocks meets under a key of its own, so no task holds more than two blocks of a group."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("__n")).where("__n > 1")
    blocks = F.ceil(F.col("__n") / most).cast("int")
    rows = df.join(sizes, group).select(*group, item, blocks.alias("__b"), F.pmod(F.xxhash64(item), blocks).cast("int").alias("__at"))
    left = rows.select(*group, F.col(item).alias("x"), F.col("__at").alias("__i"), F.explode(F.sequence(F.col("__at"), F.col("__b") - 1)).alias("__j"))
    right = rows.select(*group, F.col(item).alias("y"), F.col("__at").alias("__j"), F.explode(F.sequence(F.lit(0), F.col("__at"))).alias("__i"))
    met = left.join(right, [*group, "__i", "__j"]).where("x <> y and (__i < __j or x < y)")
    return met.select(*group, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def candidates(prints: DataFrame) -> DataFrame:
    """``a, a2, b, b2``: classes that share a band and enough check coordinates, a < b.

    The rows of a key lie together (sorted by one integer, which takes linear time), so its pairs are read off the stream; a key of more than ``HOT`` classes isn't held but paired in blocks.
    Keys meet by the first half of a class's signature; the second tells classes apart that share it.
    """
    banded = prints.where("keys is not null").select(F.explode("keys").alias("key"), "sig").repartition("key").sortWithinPartitions("key")
    met = stage(banded.mapInArrow(_met, "a bigint, b bigint, key bigint"), "met")
    hot = met.where("key is not null").select("key", F.col("a").alias("sig")).distinct()
    joined = block_pairs(hot, ["key"], "sig", HOT).select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = met.where("key is null").select("a", "b").union(joined).distinct()
    words = prints.where("c0 is not null").groupBy("sig", "sig2").agg(F.first("c0").alias("c0"), F.first("c1").alias("c1"))
    for side in "ab":
        pairs = pairs.join(words.select(F.col("sig").alias(side), F.col("sig2").alias(f"{side}2"), F.col("c0").alias(f"{side}0"), F.col("c1").alias(f"{side}1")), side)
    found = stage(pairs.where(_agreeing(F.col("a0"), F.col("b0")) + _agreeing(F.col("a1"), F.col("b1")) >= AGREE).select("a", "a2", "b", "b2"), "candidates")
    unstage(met)
    return found


def verified(pairs: DataFrame, prints: DataFrame, texts: DataFrame, *, size: int, least: float) -> DataFrame:
    """Of the candidate classes those whose shingle sets have at least the similarity: ``a, a2, b, b2, jaccard``.

    ``texts`` are all texts: ``tbl, id, tkey, text``; one of each candidate class is picked out of the scan.
    """
    wanted = pairs.select(F.col("a").alias("sig"), F.col("a2").alias("sig2")).union(pairs.select("b", "b2")).distinct()
    holders = prints.where("keys is not null").select("tbl", "id", "tkey", "sig", "sig2").join(wanted, ["sig", "sig2"], "left_semi")
    holders = holders.groupBy("sig", "sig2").agg(F.min(F.struct("tbl", "id", "tkey")).alias("r")).select("sig", "sig2", "r.*")
    held = texts.join(holders, ["tbl", "id", "tkey"]).groupBy("sig", "sig2").agg(F.max("text").alias("text"))
    side = lambda s: held.select(F.col("sig").alias(s), F.col("sig2").alias(f"{s}2"), F.col("text").alias(f"text_{s}"))
    # a text moves once for each of its partners, to where the partner's lies
    both = pairs.join(side("a"), ["a", "a2"]).join(side("b"), ["b", "b2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            elements, starts = shingle_sets(batch.column(4).to_pylist() + batch.column(5).to_pylist(), size, codes)
            sizes = np.diff(starts)
            pair = np.repeat(np.r_[np.arange(n), np.arange(n)], sizes)
            order = sorted_within(pair, elements)
            e, p = elements[order], pair[order]
            shared = np.bincount(p[1:][(e[1:] == e[:-1]) & (p[1:] == p[:-1])], minlength=n)
            either = sizes[:n] + sizes[n:] - shared
            # least is a decimal fraction: compare in integers of a thousandth
            keep = np.flatnonzero(shared * 1000 >= either * round(least * 1000))
            pick = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pick) for c in range(4)), pa.array(shared[keep] / either[keep])], ["a", "a2", "b", "b2", "jaccard"]
            )

    return both.select("a", "a2", "b", "b2", "text_a", "text_b").mapInArrow(run, "a bigint, a2 bigint, b bigint, b2 bigint, jaccard double")


def near_duplicates(
    tables: list[tuple[DataFrame, str, str, str]], *, size: int = 5, least: float = 0.8, rows: int = 5, bands: int = 64
) -> tuple[DataFrame, DataFrame]:
    """The members of classes (``tbl, id, sig, sig2``) and the links between classes (``a, a2, b, b2, jaccard``).

    ``tables`` holds a table, its name, id column and text column; ids of different tables are never linked.
    """
    prints = reduce(
        DataFrame.unionAll,
        [fingerprints(df, name, key, text, size=size, rows=rows, bands=bands, salt=k + 1) for k, (df, name, key, text) in enumerate(tables)],
    ).persist(StorageLevel.MEMORY_AND_DISK)  # ids and keys without the texts, kept with their lineage: what a lost executor held is made again
    prints.count()  # once, before several stages read it at the same time and each makes it
    texts = reduce(DataFrame.unionAll, [_texts(df, key, text).select(F.lit(name).alias("tbl"), "id", "tkey", "text") for df, name, key, text in tables])
    pairs = candidates(prints)
    links = stage(verified(pairs, prints, texts, size=size, least=least), "links")
    members = stage(prints.select("tbl", "id", "sig", "sig2").distinct(), "members")
    prints.unpersist()
    unstage(pairs)
    return members, links


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """``tbl, id, class_id, copies, links``: the class of each text by its smallest id, how many ids it has, and how many other classes are linked to it."""
    sizes = members.groupBy("tbl", "sig", "sig2").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    ends = links.select(F.col("a").alias("sig"), F.col("a2").alias("sig2")).unionAll(links.select("b", "b2"))
    linked = ends.groupBy("sig", "sig2").agg(F.count("*").alias("links"))
    named = sizes.join(linked, ["sig", "sig2"], "left")
    return members.join(named, ["tbl", "sig", "sig2"]).select("tbl", "id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """``tbl, id_a, id_b`` of all pairs of ids that are copies or linked."""
    within = block_pairs(members, ["tbl", "sig", "sig2"], "id", BLOCK).select("tbl", F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    side = lambda s, other: members.select(F.col("sig").alias(s), F.col("sig2").alias(f"{s}2"), *([F.col("tbl")] if s == "a" else []), F.col("id").alias(other))
    across = (
        links.select("a", "a2", "b", "b2")
        .join(side("a", "x"), ["a", "a2"])
        .join(side("b", "y"), ["b", "b2"])
        .where("x <> y")
        .select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    return within.unionAll(across).distinct()
