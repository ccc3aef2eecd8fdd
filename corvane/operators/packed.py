"""Several values packed in one field: a quote-aware finite-state tokenizer.

The machine walks a field from one special character to the next. It is outside quotes, inside straight
quotes, where a doubled quote is an escaped one, or inside angle quotes, which nest and whose depth it counts.
Only separators outside quotes end a piece.

Defined cases
* Outer blanks and one pair of outer quotes are removed from a piece, and the blanks inside that pair; a
  doubled straight quote inside straight quotes becomes one.
* Empty pieces, also empty quoted ones, give no value and take no position; repeated values stay.
* A quote that is never closed is an ordinary character, and separators after it split.
* A null or empty field gives no values. Very long fields are walked once, whole.
* Repeated rows give repeated values; ``explode_values`` keeps one of each (key, position, value).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators between values.
SEPARATORS = "#|;,\t\n\r"


def _close_straight(text: str, start: int) -> int:
    """Place of the straight quote that ends a quoted run opened before ``start``, or -1."""
    at = text.find('"', start)
    while at >= 0 and text.startswith('""', at):
        at = text.find('"', at + 2)
    return at


def _close_angle(text: str, start: int, angle: re.Pattern) -> int:
    """Place of the angle quote that ends the run opened before ``start``, or -1."""
    depth = 1
    for m in angle.finditer(text, start):
        depth += 1 if m[0] == "«" else -1
        if depth == 0:
            return m.start()
    return -1


_ANGLE = re.compile("[«»]")


def _clean(piece: str) -> str:
    piece = piece.strip()
    if len(piece) >= 2:
        if piece[0] == '"' and _close_straight(piece, 1) == len(piece) - 1:
            return piece[1:-1].replace('""', '"').strip()
        if piece[0] == "«" and _close_angle(piece, 1, _ANGLE) == len(piece) - 1:
            return piece[1:-1].strip()
    return piece


class Tokenizer:
    """Splits fields at a set of separators; ``split`` gives the values in order."""

    def __init__(self, separators: str = SEPARATORS):
        self.separators = separators
        self.special = re.compile("[" + re.escape(separators) + '"«]')

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        out: list[str] = []
        start = at = 0
        # once no closing quote follows a place, none follows any later one: the walk stays linear
        open_straight = open_angle = True
        while m := self.special.search(text, at):
            c = m[0]
            at = m.end()
            if c == '"':
                if open_straight:
                    end = _close_straight(text, at)
                    if end >= 0:
                        at = end + 1
                    else:
                        open_straight = '""' in text[at:]
            elif c == "«":
                if open_angle:
                    end = _close_angle(text, at, _ANGLE)
                    if end >= 0:
                        at = end + 1
                    else:
                        open_angle = "»" in text[at:]
            else:
                if value := _clean(text[start : m.start()]):
                    out.append(value)
                start = at
        if value := _clean(text[start:]):
            out.append(value)
        return out


def explode_values(df: DataFrame, key: str, packed: str, *, separators: str = SEPARATORS) -> DataFrame:
    """``key, pos, val``: one row per value of the packed field, positions from 1, rows distinct.

    The one shuffle is by key. Rows of a key then lie together, equal fields beside one another, so that repeated rows are
    split once and repeated values of a key dropped as they come.
    """
    src = df.select(F.col(key), F.col(packed).cast("string").alias("__packed")).where(F.col("__packed").isNotNull())
    src = src.repartition(key).sortWithinPartitions(key, "__packed")
    schema = T.StructType([src.schema[key], T.StructField("pos", T.IntegerType()), T.StructField("val", T.StringType())])
    machine = Tokenizer(separators)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        given: set[tuple[int, str]] = set()
        for batch in batches:
            rows: list[int] = []
            pos: list[int] = []
            val: list[str] = []
            for i, row in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if row == last:
                    continue
                if last is None or row[0] != last[0]:
                    given = set()
                last = row
                values = [v for v in enumerate(machine.split(row[1]), 1) if v not in given]
                given.update(values)
                rows += [i] * len(values)
                for p, v in values:
                    pos.append(p)
                    val.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pos, pa.int32()), pa.array(val, pa.string())],
                schema.names,
            )

    return src.mapInArrow(run, schema)
