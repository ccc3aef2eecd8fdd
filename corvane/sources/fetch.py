"""Single questions from their web page, read through the table; addresses are parameters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corvane.sources.pages import parse_pages

_FETCHED = re.compile(r"^SENAT-(\d+)-QE-(\d+)$", re.I)
_BULK_ONLY = re.compile(r"^AN-", re.I)
#: Legislatures whose archive is named by a Roman numeral, and the heading of a printed question.
ROMAN = {14: "XIV", 15: "XV"}
HEADING = r"(?U)^\d+\.\s*[—\-–]\s*\d{1,2}\s+\w+\s+\d{4}\.\s*[—\-–]\s*"


def page_address(ident: str, template: str = "{legislature}/q{legislature}{number:05d}.html") -> str:
    """The page of a question; an id that can't be fetched alone, or of another form, is an error."""
    m = _FETCHED.match(ident.strip())
    if not m:
        raise ValueError(f"only in archives: {ident}" if _BULK_ONLY.match(ident.strip()) else f"no question id: {ident}")
    return template.format(legislature=int(m[1]), number=int(m[2]))


def archive_name(legislature: int, pattern: str = "Questions_ecrites_{n}.xml.zip") -> str:
    return pattern.format(n=ROMAN.get(legislature, legislature))


def without_heading(text):
    """A question's text without the number and date that print puts before it."""
    return F.regexp_replace(text, HEADING, "")


def fetch_question(spark: SparkSession, ident: str, get: Callable[[str], str | None]) -> DataFrame | None:
    """The parsed page of a question; None where the page isn't there or can't be read."""
    address = page_address(ident)
    try:
        html = get(address)
    except OSError:
        return None
    if html is None:
        return None
    found = parse_pages(spark.createDataFrame([(ident.upper(), html)], "id string, html string"), "id", "html")
    return found if found.count() else None


def read_through(table: DataFrame, ident: str, get: Callable[[str], str | None], upsert: Callable[[DataFrame], DataFrame]) -> tuple[Row, bool]:
    """The row of a question and whether it was fetched just now. ``KeyError`` where there is none, ``ValueError`` for a malformed id.

    On a miss the page is fetched, ``upsert`` writes it and gives the new table.
    """
    row = table.where(F.col("id") == ident).first()
    if row is not None:
        return row, False
    if _BULK_ONLY.match(ident):
        raise KeyError(ident)
    found = fetch_question(table.sparkSession, ident, get)
    if found is None:
        raise KeyError(ident)
    row = upsert(found).where(F.col("id") == ident.upper()).first()
    if row is None:
        raise KeyError(ident)
    return row, True


def scroll_pages(next_page: Callable[[object], tuple[list[dict], object]], start: object = None) -> Iterator[dict]:
    """The points of a paged service until it names no further page."""
    while True:
        points, start = next_page(start)
        yield from points
        if start is None:
            return


def points_of_pages(spark: SparkSession, pages: Iterable[dict], size: int = 10_000) -> DataFrame | None:
    """Scrolled points as a table, sent in bounded parts."""
    out, part = None, []

    def flush(rows, so_far):
        if not rows:
            return so_far
        df = spark.createDataFrame(rows, "id string, vector array<float>, payload string")
        return df if so_far is None else so_far.unionAll(df)

    for p in pages:
        part.append((str(p["id"]), p.get("vector"), p.get("payload")))
        if len(part) == size:
            out, part = flush(part, out), []
    return flush(part, out)


def reachable(spark: SparkSession) -> bool:
    """Whether the session answers."""
    try:
        return spark.sql("select 1").first()[0] == 1
    except Exception:
        return False


def check_search(collection: str, k: int, least: float | None, known: tuple[str, ...] = ("questions", "answers")) -> None:
    """The ranges of a search's arguments."""
    if collection not in known:
        raise ValueError(f"collection must be one of {known}")
    if not 1 <= k <= 50:
        raise ValueError("k must be between 1 and 50")
    if least is not None and not 0 <= least <= 1:
        raise ValueError("a threshold lies between 0 and 1")


def chosen(table: DataFrame, ids: list[str] | None = None, backfill: bool = False, limit: int | None = None) -> DataFrame:
    """Rows to work on: those named, those not worked on yet, or all; latest first where there is a limit."""
    rows = table
    if ids:
        rows = rows.where(F.col("id").isin(ids))
    elif backfill:
        rows = rows.where(F.col("analyzed_at").isNull() & F.col("texte_question").isNotNull())
    return rows.orderBy(F.desc_nulls_last("date_publication_jo"), "id").limit(limit) if limit else rows
