"""SQL dumps: the rows between ``COPY … FROM stdin`` and its end mark, columns by the header's names."""

from __future__ import annotations

import io
import itertools
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.dates import stamp_day
from corvane.functions.ids import plain_number, question_id
from corvane.functions.labels import state_of_label
from corvane.functions.text import strip
from corvane.operators.merge import first_per_key
from corvane.session import stage
from corvane.sources.files import file_list, open_path

#: Fixed value: the header of a block.
HEADER = re.compile(r"^COPY\s+(\S+)\s*\(([^)]+)\)\s+FROM\s+stdin", re.I)
FIRST_LEGISLATURE = 14
#: Rows of a dump that are given out at a time.
ROWS = 10_000


def blocks(text_lines: Iterator[str]) -> Iterator[tuple[str, int, dict[str, str | None]]]:
    """``table, row number, values`` of every row; the mark ``\\N`` and empty values are null, other escapes stay."""
    table, columns = None, []
    for no, line in enumerate(text_lines):
        line = line.rstrip("\r\n")
        if table is None:
            if m := HEADER.match(line):
                table = m[1].split(".")[-1].strip('"')
                columns = [c.strip().strip('"') for c in m[2].split(",")]
        elif line == "\\.":
            table = None
        else:
            yield table, no, {c: None if v in ("\\N", "") else v for c, v in zip(columns, line.split("\t"))}


def read_dump(spark: SparkSession, path: str, tables: list[str] | None = None, opened: Callable[[str], BinaryIO] = open_path) -> DataFrame:
    """``path, table, row_no, values`` of dump files, each read line by line by one task: a file may be of any size."""
    wanted = set(tables or ())
    schema = pa.schema([("path", pa.string()), ("table", pa.string()), ("row_no", pa.int64()), ("values", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as f, io.TextIOWrapper(f, encoding="utf-8", errors="replace", newline="\n") as lines:
                    rows = ((name, table, no, list(values.items())) for table, no, values in blocks(lines) if not wanted or table in wanted)
                    while part := list(itertools.islice(rows, ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)

    return file_list(spark, path).select("path").mapInArrow(run, "path string, table string, row_no bigint, values map<string,string>")


def table_of(rows: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One table of a dump with the given columns; one the dump hasn't is null."""
    return rows.where(F.col("table") == table).select("path", "row_no", *[F.try_element_at("values", F.lit(c)).alias(c) for c in columns])


def theme_labels(raw: DataFrame, key: str, codes: str, themes: DataFrame) -> DataFrame:
    """``key, themes``: the labels of ``#2#14#`` in order, white space around a code and unknown codes left out; no row where none is known."""
    coded = raw.select(F.col(key), F.posexplode(F.filter(F.transform(F.split(codes, "#"), strip), lambda x: x != "")).alias("pos", "code"))
    named = coded.join(themes.select(F.col("thecle").cast("string").alias("code"), "thelib"), "code")
    return named.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "thelib"))), lambda x: x["thelib"]).alias("themes"))


def latest_by(df: DataFrame, key: str, *row: str) -> DataFrame:
    """The last row of a repeated key, by the last file and the last place in it."""
    w = Window.partitionBy(key).orderBy(*[F.desc(r) for r in row or ("path", "row_no")])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def senate_questions(rows: DataFrame) -> DataFrame:
    """Parsed questions of a Senate dump: its four tables joined, written questions from legislature 14 on. The dump is read once for all of them."""
    rows = stage(rows.where(F.col("table").isin("tam_questions", "sortquestion", "tam_reponses", "the")), "dump")
    q = table_of(
        rows, "tam_questions",
        "id natquecod legislature numero sorquecod titre nom prenom codequalite circonscription groupe datejodepot mindepotlib minreplib1 datejorep1 txtque themes".split(),
    )
    states = latest_by(table_of(rows, "sortquestion", ["sorquecod", "sorquelib"]), "sorquecod").drop("path", "row_no")
    replies = latest_by(table_of(rows, "tam_reponses", ["idque", "txtrep", "datejorep", "minreplib"]), "idque").drop("path", "row_no")
    themes = latest_by(table_of(rows, "the", ["thecle", "thelib"]), "thecle").drop("path", "row_no")
    leg, number = plain_number(F.col("legislature")), plain_number(F.col("numero"))
    q = q.where(F.trim("natquecod") == "QE").withColumn("leg", leg).withColumn("number", number).withColumn("row", F.struct("path", "row_no")).where((F.col("leg") >= FIRST_LEGISLATURE) & F.col("number").isNotNull())
    q = q.join(states, "sorquecod", "left").join(replies, F.col("id") == F.col("idque"), "left").join(theme_labels(q, "row", "themes", themes).withColumnRenamed("themes", "theme_labels"), "row", "left")
    state = state_of_label(F.col("sorquelib"))
    settled, replied = state == "REPONDU", F.col("idque").isNotNull()
    ident = question_id(F.lit("SENAT"), F.col("leg"), F.lit("QE"), F.col("number"))
    out = q.select(
        "path",
        "row_no",
        ident.alias("id"),
        F.col("number").alias("numero_question"),
        F.lit("QE").alias("type"),
        F.lit("SENAT").alias("source"),
        F.col("leg").alias("legislature"),
        state.alias("etat_question"),
        stamp_day(F.col("datejodepot")).alias("date_publication_jo"),
        F.col("mindepotlib").alias("ministre_libelle"),
        F.col("nom").alias("auteur_nom"),
        F.col("prenom").alias("auteur_prenom"),
        F.col("groupe").alias("auteur_grp_pol"),
        F.col("circonscription").alias("auteur_circonscription"),
        F.col("titre").alias("titre_senat"),
        F.coalesce("txtque", F.lit("")).alias("texte_question"),
        F.when(settled, F.concat(F.lit("SENAT-DUMP-"), ident)).alias("reponse_id"),
        F.when(settled, F.lit("SENAT-DUMP")).alias("no_publication"),
        F.col("txtrep").alias("texte_reponse"),
        F.coalesce(stamp_day(F.col("datejorep")), stamp_day(F.col("datejorep1"))).alias("date_reponse_jo"),
        F.when(replied, F.coalesce("minreplib", "minreplib1")).when(settled, F.col("minreplib1")).alias("ministre_reponse_libelle"),
        F.col("theme_labels").alias("themes"),
    )
    return first_per_key(out, ["id", "path", "row_no"], [F.col("row_no")])
