"""Question XML: single files and bulk files, plain or inside zip archives, to one row per question."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.dates import parse_day
from corvane.functions.ids import question_id, reply_id
from corvane.functions.text import blank_to_null
from corvane.sources.files import file_list, open_path

_INFO = "struct<dateJO:string,pageJO:string>"
_TEXT = f"array<struct<infoJO:{_INFO},texte:string>>"
#: The parts of a question that are read; tags are matched without their namespace.
QUESTION_XML = (
    "identifiant struct<numero:string,legislature:string>, type string, "
    "indexationAN struct<rubrique:string,teteAnalyse:string,analyses:struct<analyse:array<string>>,ANALYSE:struct<ANA:array<string>>>, "
    "minInt struct<developpe:string>, minAttribs struct<minAttrib:array<struct<denomination:struct<developpe:string>>>>, "
    f"textesQuestion struct<texteQuestion:{_TEXT}>, textesReponse struct<texteReponse:{_TEXT}>, cloture struct<infoJO:{_INFO}>"
)


def zip_entries(spark: SparkSession, path: str, opened: Callable[[str], BinaryIO] = open_path) -> DataFrame:
    """``archive, name, content`` of the XML entries of zip archives; a broken archive has none.

    Entries below ``xml/`` are taken where there are any, else those of the root. An archive is opened where it lies and read an entry at a time, so it may
    be of any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                try:
                    with opened(archive) as f, zipfile.ZipFile(f) as z:
                        names = [n for n in z.namelist() if n.lower().endswith(".xml")]
                        nested = [n for n in names if n.startswith("xml/")]
                        for n in nested or [n for n in names if "/" not in n]:
                            yield pa.RecordBatch.from_pydict({"archive": [archive], "name": [n], "content": [z.read(n).decode("utf-8", "replace")]})
                except (zipfile.BadZipFile, zlib.error, EOFError, ValueError):  # a file too short to be one too
                    continue

    return file_list(spark, path).select("path").mapInArrow(run, "archive string, name string, content string")


def question_elements(df: DataFrame, content: str) -> DataFrame:
    """``element`` of every question of an XML text: the text itself, or each question below one root."""
    one = F.regexp_extract_all(F.col(content), F.lit(r"(?s)(<question[\s>].*?</question>)"), F.lit(1))
    return df.withColumn("element", F.explode(one)).drop(content)


def parse_questions(df: DataFrame, element: str = "element") -> DataFrame:
    """A row per readable question element: the last ministry it was attributed to, its first text, its first reply; malformed ones, and those without number or legislature, are dropped."""
    x = F.from_xml(F.col(element), QUESTION_XML, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    q = df.select(x.alias("x")).where("x is not null")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    first = lambda a: F.get(a, F.lit(0))
    number, leg = F.col("x.identifiant.numero").try_cast("int"), F.col("x.identifiant.legislature").try_cast("int")
    kind = F.lit("QE")
    ident = question_id(F.lit("AN"), leg, kind, number)
    asked, said = first(F.col("x.textesQuestion.texteQuestion")), first(F.col("x.textesReponse.texteReponse"))
    answered = F.coalesce(F.size("x.textesReponse.texteReponse") > 0, F.lit(False))
    text = blank_to_null(said["texte"])
    day = parse_day(said["infoJO"]["dateJO"])
    return q.select(
        ident.alias("id"),
        number.alias("numero_question"),
        kind.alias("type"),
        F.lit("AN").alias("source"),
        leg.alias("legislature"),
        F.when(answered, "REPONDU").otherwise("EN_COURS").alias("etat_question"),
        parse_day(asked["infoJO"]["dateJO"]).alias("date_publication_jo"),
        F.coalesce(blank_to_null(last(F.col("x.minAttribs.minAttrib"))["denomination"]["developpe"]), blank_to_null(F.col("x.minInt.developpe"))).alias("ministre_libelle"),
        title().alias("objet"),
        F.coalesce(blank_to_null(asked["texte"]), F.lit("")).alias("texte_question"),
        reply_id(day, text, ident).alias("reponse_id"),
        text.alias("texte_reponse"),
        day.alias("date_reponse_jo"),
        F.when(text.isNotNull(), F.when(day.isNotNull(), F.date_format(day, "yyyyMMdd")).otherwise("QE")).alias("no_publication"),
        F.col("x.cloture.infoJO.pageJO").try_cast("int").alias("page_reponse_jo"),
    ).where("id is not null")


def title() -> Column:
    """The first of the headings that isn't blank."""
    a = "x.indexationAN"
    ways = [F.col(f"{a}.teteAnalyse"), F.get(F.col(f"{a}.analyses.analyse"), F.lit(0)), F.get(F.col(f"{a}.ANALYSE.ANA"), F.lit(0)), F.col(f"{a}.rubrique")]
    return F.coalesce(*[blank_to_null(w) for w in ways])
