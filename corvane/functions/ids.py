"""Identifiers and hashes as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import strip

_HEX = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"


def content_hash(text: Column) -> Column:
    """SHA-256 of the whole text, in hex."""
    return F.sha2(text, 256)


def stable_uuid(key: Column) -> Column:
    """The first half of the key's SHA-256, laid out as a UUID."""
    return F.regexp_replace(F.substring(F.sha2(key, 256), 1, 32), _HEX, "$1-$2-$3-$4-$5")


def variant_uuid(key: Column, tag: str | None = None) -> Column:
    """The stable id of a tagged variant of a key; without a tag that of the key."""
    return stable_uuid(F.concat(key, F.lit(f"::{tag}")) if tag else key)


def path_uuid(path: Column, section: Column | None = None, chunk: Column | None = None) -> Column:
    """The stable id of a document, or of a chunk in a section of it."""
    parts = [path] + [c.cast("string") for c in (section, chunk) if c is not None]
    return stable_uuid(F.concat_ws("::", *parts))


def question_id(source: Column, legislature: Column, kind: Column, number: Column) -> Column:
    """``SOURCE-LEGISLATURE-KIND-NUMBER``; null where a part is."""
    parts = [c.cast("string") for c in (source, legislature, kind, number)]
    dash = F.lit("-")
    return F.concat(parts[0], dash, parts[1], dash, parts[2], dash, parts[3])


def id_part(ident: Column, part: str) -> Column:
    """One of ``source, legislature, kind, number`` of an id; null where the id hasn't the form."""
    place = {"source": 1, "legislature": 2, "kind": 3, "number": 4}[part]
    return F.nullif(F.upper(F.regexp_extract(ident, r"(?i)^(AN|SENAT)-(\d+)-([A-Z]+)-(\d+)$", place)), F.lit(""))


def reply_id(day: Column, text: Column, fallback: Column) -> Column:
    """``AN-yyyymmdd-`` and twelve hex digits of the text's SHA-1; without a day the fallback, without a text null."""
    digest = F.substring(F.sha1(text.cast("binary")), 1, 12)
    return F.when(text.isNull(), F.lit(None)).when(day.isNull(), fallback).otherwise(F.concat(F.lit("AN-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), digest))


def plain_number(text: Column) -> Column:
    """An integer typed with leading zeros; null where it isn't one."""
    return strip(text).try_cast("int")


def path_variants(path: str) -> list[str]:
    """The ways a folder may be written as a prefix of stored paths, each once."""
    from pathlib import Path

    p = Path(path)
    ways = [str(p), p.as_posix(), str(p.resolve()), p.resolve().as_posix()]
    return list(dict.fromkeys(w.rstrip("/") + "/" for w in ways))
