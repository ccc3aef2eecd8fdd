"""Plain files: vector dumps, group lists, documents, reports; downloads behind a small interface."""

from __future__ import annotations

import io
import os
import re
import time
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "collection string, id string, vector array<float>, payload string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it, which is taken as it is written, without the escapes of an address."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(/.*)$", path, re.S)
    if m is None or m[1] == "file":
        return fs.LocalFileSystem(), m[3] if m else path
    return fs.FileSystem.from_uri(f"{m[1]}:{m[2] or '//'}/")[0], m[3]


def open_path(path: str) -> BinaryIO:
    """A file of the cluster's store, as a stream that can be searched: nothing is read before it is asked for."""
    store, name = _store(path)
    return store.open_input_file(name)


def write_bytes(path: str, content: bytes) -> None:
    """A file of the cluster's store, with the folders above it."""
    store, name = _store(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(name) as out:
        out.write(content)


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the files below a path, dealt to tasks one by one; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.repartition(max(1, min(files.count(), 8 * spark.sparkContext.defaultParallelism)), "path")


def read_points(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """Points of a JSON-lines dump; blank lines are no points."""
    rows = spark.read.schema(POINTS).json(path).where("id is not null")
    return rows if collection is None else rows.where(F.col("collection") == collection)


def write_points(points: DataFrame, path: str) -> None:
    """Points as JSON lines."""
    points.write.mode("overwrite").json(path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """``group_id, question_id`` of a list with a header; the group's column is ``lot_id`` or ``group_id``, of two or more members."""
    raw = spark.read.csv(path, header=True)
    key = next((c for c in ("lot_id", "group_id") if c in raw.columns), None)
    if key is None:
        raise ValueError("the list has neither lot_id nor group_id")
    rows = raw.select(F.col(key).alias("group_id"), "question_id").where("group_id is not null and question_id is not null").distinct()
    return rows.join(rows.groupBy("group_id").count().where("count >= 2").drop("count"), "group_id", "left_semi")


def write_groups(groups: DataFrame, path: str, group: str = "group_id") -> None:
    """Groups of two or more as CSV, sorted by group."""
    kept = groups.join(groups.groupBy(group).count().where("count >= 2").drop("count"), group, "left_semi")
    kept.orderBy(group).write.mode("overwrite").csv(path, header=True)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of text, PDF and Word files below a folder, in order; temporary and hidden ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length").where(_document()).orderBy("path")


def _document() -> Column:
    name = F.element_at(F.split("path", "/"), -1)
    return F.lower(name).rlike(r"\.(txt|pdf|docx|doc)$") & ~name.rlike(r"^(~\$|\.)")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(data: bytes) -> str:
    """The paragraphs of a Word file's body, a line each; those in tables aren't of the body."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    signs = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "\n".join("".join(x.text or "" if x.tag == f"{_W}t" else signs.get(x.tag, "") for x in p.iter()) for p in body.findall(f"{_W}p"))


def sheet_rows(data: bytes) -> list[list[str | None]]:
    """The rows of a spreadsheet's first sheet as text, gaps as None."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_S}t"))
    shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
    first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    rows: list[list[str | None]] = []
    for e in ElementTree.fromstring(z.read(first)).iter(f"{_S}row"):
        number = int(e.get("r") or len(rows) + 1)
        rows += [[] for _ in range(number - len(rows))]
        row = rows[number - 1]
        for c in e.findall(f"{_S}c"):
            letters = re.match("[A-Z]*", c.get("r") or "")[0]
            at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else len(row)
            value, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
            cell = text(inline) if inline is not None else None if value is None or value.text is None else value.text
            row += [None] * (at + 1 - len(row))
            row[at] = shared[int(cell)] if c.get("t") == "s" and cell is not None else cell
    return rows


def document_text(path: str, data: bytes) -> tuple[str | None, str | None]:
    """A document's text, or why there is none."""
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        if kind == "txt":
            return data.decode("utf-8", "ignore"), None
        if kind == "docx":
            return docx_text(data), None
        if kind == "pdf":
            from pypdf import PdfReader

            return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages), None
        return None, f"no reader for {kind}"
    except ImportError as e:
        return None, f"{kind} needs {e.name}, which isn't installed"
    except Exception as e:
        return None, f"not readable: {type(e).__name__}"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text, error`` of the documents that ``list_documents`` lists: none is left out, one without a text says why."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(_document())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [document_text(p.as_py(), d.as_py()) for p, d in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], ["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def read_sheet(path: str, header_row: int, wanted: dict[str, str]) -> list[dict[str, str | None]]:
    """Rows of a spreadsheet's first sheet; a column is found by a part of its heading, one that isn't there is an error. Empty rows are left out."""
    rows = sheet_rows(Path(path).read_bytes())
    head = [str(c or "").lower() for c in rows[header_row - 1]]
    at = {}
    for name, part in wanted.items():
        if (i := next((i for i, h in enumerate(head) if part.lower() in h), None)) is None:
            raise ValueError(f"no heading with {part!r} in row {header_row}")
        at[name] = i
    return [{k: r[i] if i < len(r) else None for k, i in at.items()} for r in rows[header_row:] if any(c is not None for c in r)]


def download(fetch: Callable[[str], Iterable[bytes]], url: str, dest: str, *, retries: int = 3, backoff: float = 2.0, sleep=time.sleep) -> bool:
    """Fetches to a temporary file beside the target and renames it; whether it came through. Nothing is left of a failure."""
    target = Path(dest)
    part = target.with_suffix(target.suffix + ".part")
    for turn in range(retries):
        try:
            with open(part, "wb") as f:
                for chunk in fetch(url):
                    f.write(chunk)
            os.replace(part, target)
            return True
        except OSError:
            part.unlink(missing_ok=True)
            if turn + 1 < retries:
                sleep(backoff * 2**turn)
    return False


def highest_available(exists: Callable[[int], bool], floor: int) -> int:
    """The highest number from the floor on without a gap; the floor where asking fails."""
    n = floor
    try:
        while exists(n + 1):
            n += 1
    except OSError:
        return floor
    return n


def refresh_plan(have: set[str], static: list[str], live: list[str], force: bool = False) -> list[tuple[str, str]]:
    """``name, action`` of archives: those that never change are fetched once, live ones always."""
    return [(n, "skip" if n in have and not force else "fetch") for n in static] + [(n, "fetch") for n in live]
