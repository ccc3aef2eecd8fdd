"""Changes between full deliveries of a table.

Keys get persistent ordinals, kept in a dictionary (``Ordinals``); each delivery is a compressed bitmap over them.
Additions and removals are AND-NOT of neighbouring bitmaps, changes are found by comparing ordinal-aligned
column vectors under the AND. Keys are dealt to buckets by hash, so a source that holds most rows is
split; rows and dictionary meet bucket by bucket, with one shuffle of the rows.

Defined cases
* Of several rows of one key in one delivery the latest load time counts; at a tie the row whose
  values come last in column order, null first, so repeated rows change nothing.
* Text values are compared without outer blanks, columns named as codes also without leading zeros;
  empty equals null, null differs from a value.
* Rows with a null source, delivery number or key belong to no delivery and are left out.
* The first delivery of a source, and a source with one delivery, gives no rows. A gap in the numbering
  is no delivery: neighbours are the deliveries present.
* An empty table gives an empty result; other columns are not read.
* A dictionary says how many buckets its ordinals were given in. It grows only to a multiple of that number: then keys
  of different buckets never meet in one, and every ordinal stays its key's. Another number of buckets is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.stores import SnapshotFolder
from corvane.session import stage

#: Rows of one bucket, about; a task holds one bucket at a time.
BUCKET_ROWS = 200_000
#: A table of deliveries is broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_DELIVERIES = 100_000


class Bitmap:
    """A compressed set of 32-bit ordinals: per 65 536 ordinals a sorted array, or a bit vector once that is smaller."""

    ARRAY_MAX = 4096

    def __init__(self, parts: dict[int, np.ndarray]):
        self.parts = parts

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        """From sorted, distinct ordinals."""
        parts = {}
        high = ordinals >> 16
        keys, starts = np.unique(high, return_index=True)
        for k, low in zip(keys.tolist(), np.split((ordinals & 0xFFFF).astype(np.uint16), starts[1:])):
            parts[k] = cls._pack(low)
        return cls(parts)

    @classmethod
    def _pack(cls, low: np.ndarray) -> np.ndarray:
        if len(low) <= cls.ARRAY_MAX:
            return low
        bits = np.zeros(65536, np.uint8)
        bits[low] = 1
        return np.packbits(bits)

    @staticmethod
    def _bits(part: np.ndarray) -> np.ndarray:
        if part.dtype == np.uint8:
            return part
        bits = np.zeros(65536, np.uint8)
        bits[part] = 1
        return np.packbits(bits)

    def _with(self, other: Bitmap, negate: bool) -> np.ndarray:
        out = []
        for k in sorted(self.parts):
            a, b = self.parts[k], other.parts.get(k)
            if b is None:
                if negate:
                    out.append((k, np.flatnonzero(np.unpackbits(a)) if a.dtype == np.uint8 else a))
                continue
            if a.dtype == np.uint16 and b.dtype == np.uint16:
                low = np.setdiff1d(a, b, assume_unique=True) if negate else np.intersect1d(a, b, assume_unique=True)
            else:
                x, y = self._bits(a), self._bits(b)
                low = np.flatnonzero(np.unpackbits(x & ~y if negate else x & y))
            out.append((k, low))
        return np.concatenate([low.astype(np.int64) + (k << 16) for k, low in out]) if out else np.empty(0, np.int64)

    def and_not(self, other: Bitmap) -> np.ndarray:
        """The ordinals of this set that are not in the other."""
        return self._with(other, True)

    def and_(self, other: Bitmap) -> np.ndarray:
        """The ordinals of both sets."""
        return self._with(other, False)


def _plain(c: Column, kind: str, code: bool) -> Column:
    if kind != "string":
        return c if kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp") else c.cast("string")
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    if code:
        t = F.regexp_replace(t, "^0+(?=.)", "")
    return F.when(t != "", t)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values to equal integers, null to -1."""
    return np.asarray(pc.fill_null(pc.dictionary_encode(column).combine_chunks().indices, -1)).astype(np.int64)


def _diff(table: pa.Table, columns: Sequence[str], names: tuple[str, str, str], known: pa.Table | None = None) -> pa.Table:
    source, number, key = names
    ids = pc.dictionary_encode(table.column(key)).combine_chunks()
    rank = np.empty(len(ids.dictionary), np.int64)
    rank[np.asarray(pc.sort_indices(ids.dictionary))] = np.arange(len(rank))
    # keys with an ordinal keep it; new ones follow in key order
    held = np.full(len(rank), -1, np.int64)
    if known is not None and known.num_rows and len(rank):
        at = pc.index_in(ids.dictionary, value_set=known.column("held_key").combine_chunks())
        held = np.asarray(pc.fill_null(known.column("held_ordinal").combine_chunks().take(at), -1)).astype(np.int64)
    fresh = np.flatnonzero(held < 0)
    top = max(held.max(initial=-1), -1 if known is None else pc.max(known.column("held_ordinal")).as_py())
    held[fresh[np.argsort(rank[fresh])]] = top + 1 + np.arange(len(fresh))
    persistent = held[np.asarray(ids.indices)]
    place = np.argsort(held)
    by_ordinal, ordinals_held = ids.dictionary.take(pa.array(place)), held[place]
    numbers = np.asarray(table.column(number)).astype(np.int64)
    vectors = [_codes(table.column(c)) for c in columns]
    at = np.asarray(pc.fill_null(table.column("__at"), -(2**62)))
    # the latest row of a key in a delivery comes last in this order
    tie = [np.asarray(pc.rank(table.column(c).combine_chunks(), null_placement="at_start", tiebreaker="dense")).astype(np.int64) for c in columns]
    order = np.lexsort([*reversed(tie), at, persistent, numbers])
    n, o = numbers[order], persistent[order]
    last = np.r_[(n[1:] != n[:-1]) | (o[1:] != o[:-1]), True] if len(n) else np.zeros(0, bool)
    pick = order[last]
    numbers, persistent, vectors = numbers[pick], persistent[pick], [v[pick] for v in vectors]
    prev = np.asarray(pc.fill_null(table.column("__prev"), -(2**62))).astype(np.int64)[pick]
    nxt = np.asarray(pc.fill_null(table.column("__next"), -(2**62))).astype(np.int64)[pick]
    deliveries, starts = np.unique(numbers, return_index=True)
    ends = np.r_[starts[1:], len(numbers)]
    bitmaps = {int(d): Bitmap.of(persistent[a:b]) for d, a, b in zip(deliveries, starts, ends)}
    span = {int(d): (int(a), int(b)) for d, a, b in zip(deliveries, starts, ends)}
    none = Bitmap({})
    found: list[tuple[int, str, np.ndarray]] = []
    for d, (a, b) in span.items():
        before, after = int(prev[a]), int(nxt[a])
        if before != -(2**62):
            old = bitmaps.get(before, none)
            found.append((d, "added", bitmaps[d].and_not(old)))
            both = bitmaps[d].and_(old)
            if len(both):
                # ordinals are sorted within a delivery, so a vector is aligned by search
                new_at = a + np.searchsorted(persistent[a:b], both)
                oa, ob = span[before]
                old_at = oa + np.searchsorted(persistent[oa:ob], both)
                differ = np.zeros(len(both), bool)
                for v in vectors:
                    differ |= v[new_at] != v[old_at]
                found.append((d, "changed", both[differ]))
        if after != -(2**62) and after not in span:
            found.append((after, "removed", bitmaps[d].and_not(none)))
        elif after != -(2**62):
            found.append((after, "removed", bitmaps[d].and_not(bitmaps[after])))
    counts = [len(x) for _, _, x in found]
    total = sum(counts)
    ordinals = np.concatenate([x for _, _, x in found]) if found else np.empty(0, np.int64)
    name = table.column(source)[0].as_py() if table.num_rows else None
    return pa.table(
        {
            source: pa.array([name] * total, pa.string()),
            number: pa.array(np.repeat([d for d, _, _ in found], counts).astype(np.int32) if found else [], pa.int32()),
            key: by_ordinal.take(pa.array(np.searchsorted(ordinals_held, ordinals))).cast(pa.string()),
            "change_kind": pa.array(np.repeat([k for _, k, _ in found], counts).tolist() if found else [], pa.string()),
        }
    )


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets))


def key_ordinals(
    df: DataFrame, buckets: int | None = None, known: DataFrame | None = None, *, source: str = "source", key: str = "id", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``source, key, ordinal, buckets``: the dictionary of keys to ordinals within their bucket, to be stored.

    Keys of ``known``, an earlier dictionary, keep their ordinals; new ones go on from the highest of their bucket. The number of buckets is the
    earlier one, doubled as often as the rows ask for, unless it is given; one that isn't a multiple of the earlier is an error.
    """
    keys = df.select(F.col(source).cast("string").alias(source), F.col(key).cast("string").alias(key)).where(F.col(source).isNotNull() & F.col(key).isNotNull()).distinct()
    before = buckets_of(known)
    if buckets is None:
        need = max(1, -(-df.count() // bucket_rows))
        buckets = before or need
        while buckets < need:
            buckets *= 2
    if before and buckets % before:
        raise ValueError(f"ordinals given in {before} buckets hold in a multiple of them, not in {buckets}")
    if known is None or not before:
        keys = keys.withColumn("held", F.lit(None).cast("bigint"))
    else:
        keys = keys.join(known.select(source, key, F.col("ordinal").alias("held")), [source, key], "full")
    keys = keys.withColumn("__bucket", _bucket(F.col(key), buckets))
    own = Window.partitionBy(source, "__bucket")
    top = F.coalesce(F.max("held").over(own), F.lit(-1))
    turn = F.row_number().over(own.orderBy(F.col("held").isNotNull(), key))
    return keys.select(source, key, F.coalesce("held", top + turn).cast("bigint").alias("ordinal"), F.lit(buckets).alias("buckets"))


def buckets_of(known: DataFrame | None) -> int | None:
    """The number of buckets a dictionary's ordinals were given in; None for none or an empty one."""
    row = None if known is None else known.select("buckets").first()
    return row and row[0]


class Ordinals(SnapshotFolder):
    """A stored dictionary of keys to ordinals, the same from run to run."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, "source string, id string, ordinal bigint, buckets int")

    def extend(self, df: DataFrame, *, source: str = "source", key: str = "id", buckets: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
        """The dictionary with the keys of ``df`` in it; it is written anew only where keys or buckets are."""
        named = df.select(F.col(source).cast("string").alias("source"), F.col(key).cast("string").alias("id"))
        known = self.rows() if self.info() is not None else None
        fresh = key_ordinals(named, buckets, known, bucket_rows=bucket_rows)
        if known is not None:
            same = buckets_of(known) == buckets_of(fresh.limit(1))
            wanted = named.where("source is not null and id is not null")
            if same and wanted.join(known, ["source", "id"], "left_anti").isEmpty():
                return known
        self.replace(fresh)
        return self.rows()


def snapshot_changes(
    df: DataFrame,
    columns: Sequence[str],
    *,
    source: str = "source",
    number: str = "snapshot_no",
    key: str = "id",
    loaded: str = "loaded_at",
    codes: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
    buckets: int | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """``source, number, key, change_kind`` of every key added, removed or changed against the delivery before.

    ``columns`` are compared; those in ``codes`` without leading zeros. ``known`` are stored ordinals (``source, id, ordinal, buckets``, see ``Ordinals``), which keys keep
    from run to run; they say the number of buckets. Without them it is given, or follows from ``bucket_rows``. Every bucket holds all deliveries of its keys.
    """
    kinds = dict(df.dtypes)
    src = df.where(F.col(source).isNotNull() & F.col(number).isNotNull() & F.col(key).isNotNull())
    # one small aggregate says the deliveries, their neighbours, and how many rows there are
    counted = stage(src.groupBy(F.col(source).alias("__s"), F.col(number).alias("__n")).agg(F.count("*").alias("rows")), "deliveries")
    totals = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    line = Window.partitionBy("__s").orderBy("__n")
    deliveries = counted.select(
        "__s", "__n", F.lag("__n").over(line).cast("bigint").alias("__prev"), F.lead("__n").over(line).cast("bigint").alias("__next")
    )
    if totals["n"] <= BROADCAST_DELIVERIES:
        deliveries = F.broadcast(deliveries)
    stored = buckets_of(known)
    if stored and buckets and stored != buckets:
        raise ValueError(f"the ordinals were given in {stored} buckets, not {buckets}")
    buckets = stored or buckets or max(1, -(-totals["rows"] // bucket_rows))
    rows = src.select(
        F.col(source).cast("string").alias(source),
        F.col(number).cast("int").alias(number),
        F.col(key).cast("string").alias(key),
        F.unix_micros(F.col(loaded).cast("timestamp")).alias("__at"),
        *[_plain(F.col(c), kinds[c], c in codes).alias(c) for c in columns],
        _bucket(F.col(key), buckets).alias("__bucket"),
    )
    rows = rows.join(deliveries, (F.col(source) == F.col("__s")) & (F.col(number) == F.col("__n"))).drop("__s", "__n")
    compared, names = list(columns), (source, number, key)
    out = f"{source} string, {number} int, {key} string, change_kind string"
    if not stored:
        return rows.groupBy(source, "__bucket").applyInArrow(lambda table: _diff(table, compared, names), schema=out)
    # names of its own: a dictionary made from the same table must not be taken for its columns
    held = known.select(F.col("source").alias("held_source"), F.col("id").alias("held_key"), F.col("ordinal").alias("held_ordinal"), _bucket(F.col("id"), buckets).alias("held_bucket"))

    empty = pa.schema([(source, pa.string()), (number, pa.int32()), (key, pa.string()), ("change_kind", pa.string())])

    def met(table: pa.Table, held: pa.Table) -> pa.Table:
        if not table.num_rows:  # a bucket of the dictionary without rows
            return empty.empty_table()
        return _diff(table, compared, names, held if held.num_rows else None)

    return rows.groupBy(source, "__bucket").cogroup(held.groupBy("held_source", "held_bucket")).applyInArrow(met, schema=out)
