"""Queries of the file formats: tables written in a format of the sources, read back by its reader, and compared with the table.

The files go to a folder of their own in the shared folder; each task writes files of its own, so no file is put together in one place.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import incremental, stores
from corvane.plans.catalog import _SPACE, _trimmed, query
from corvane.session import shared_dir, spread
from corvane.sources import archives, dump, files


def _folder(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    return f"{shared_dir(spark).rstrip('/')}/corvane-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _line(c: str) -> Column:
    """A value as a dump has it: one line without tabs, null as the mark."""
    return F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\n\r\\]", " "), F.lit("\\N"))


_FLAT = lambda c: f"nullif(regexp_replace(CAST({c} AS VARCHAR), '[\\t\\n\\r\\\\\\\\]', ' ', 'g'), '')"
_DUMPED = ("id", "natquecod", "legislature", "numero", "sorquecod", "titre", "nom", "prenom", "codequalite", "circonscription", "groupe", "datejodepot", "mindepotlib", "minreplib1", "datejorep1", "txtque")


def _dumped(rows: DataFrame, table: str, columns: dict[str, Column]) -> DataFrame:
    """The text lines of a dump's blocks, one block for each task's rows."""
    head = f"COPY questions.{table} ({', '.join(columns)}) FROM stdin;"

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [head]})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])
        yield pa.RecordBatch.from_pydict({"value": ["\\."]})

    return rows.select(F.concat_ws("\t", *columns.values()).alias("value")).mapInArrow(block, "value string")


@query(
    f"""WITH q AS (SELECT DISTINCT {", ".join(f"{_FLAT(c)} AS {c}" for c in _DUMPED)}, {_FLAT("themes_raw")} AS themes FROM tam_questions),
n AS (SELECT *, try_cast({_trimmed('legislature')} AS INTEGER) AS leg, try_cast({_trimmed('numero')} AS INTEGER) AS number FROM q WHERE trim(natquecod) = 'QE'),
k AS (SELECT id, list_filter(list_transform(string_split(themes, '#'), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '') AS codes FROM n),
u AS (SELECT id, unnest(codes) AS code, generate_subscripts(codes, 1) AS pos FROM k),
h AS (SELECT u.id, string_agg(thelib, '|' ORDER BY pos) AS themes FROM u JOIN the_themes t ON CAST(t.thecle AS VARCHAR) = u.code GROUP BY u.id)
SELECT 'SENAT-' || leg || '-QE-' || number AS id, number AS numero_question, leg AS legislature, CASE sorquecod WHEN '2' THEN 'REPONDU' WHEN '4' THEN 'RETIRE' WHEN '6' THEN 'CADUQUE' ELSE 'EN_COURS' END AS etat_question,
strftime(CASE WHEN regexp_full_match(substr({_trimmed('datejodepot')}, 1, 10), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_strptime(substr({_trimmed('datejodepot')}, 1, 10), '%Y-%m-%d') END, '%Y-%m-%d') AS date_publication_jo,
mindepotlib AS ministre_libelle, nom AS auteur_nom, prenom AS auteur_prenom, groupe AS auteur_grp_pol, circonscription AS auteur_circonscription, titre AS titre_senat, coalesce(txtque, '') AS texte_question,
CASE WHEN sorquecod = '2' THEN 'SENAT-DUMP-SENAT-' || leg || '-QE-' || number END AS reponse_id, h.themes FROM n LEFT JOIN h ON h.id = n.id WHERE leg >= 14 AND number IS NOT NULL"""
)
def dump_questions(t):
    """The questions of a dump of several files, joined with its states and themes."""
    raw = spread(t("tam_questions")).select(*_DUMPED, "themes_raw").distinct()
    folder = _folder(raw, "dump")
    spark = raw.sparkSession
    _dumped(raw, "tam_questions", {**{c: _line(c) for c in _DUMPED}, "themes": _line("themes_raw")}).write.mode("append").text(folder)
    states = spark.createDataFrame([("1", "En cours"), ("2", "Réponse publiée"), ("4", "Question retirée"), ("6", "Caduque")], "sorquecod string, sorquelib string").coalesce(1)
    _dumped(states, "sortquestion", {c: _line(c) for c in states.columns}).write.mode("append").text(folder)
    _dumped(t("the_themes"), "the", {c: _line(c) for c in ("thecle", "thelib")}).write.mode("append").text(folder)
    q = dump.senate_questions(dump.read_dump(spark, folder))
    return q.select(
        "id", "numero_question", "legislature", "etat_question", F.date_format("date_publication_jo", "yyyy-MM-dd").alias("date_publication_jo"), "ministre_libelle", "auteur_nom", "auteur_prenom", "auteur_grp_pol",
        "auteur_circonscription", "titre_senat", "texte_question", "reponse_id", F.array_join("themes", "|").alias("themes"),
    )


@query("SELECT DISTINCT id, numero_question, legislature, nullif(trim(objet), '') AS objet FROM parsed_questions WHERE source = 'AN'".replace("nullif(trim(objet), '')", _trimmed("objet")))
def zip_questions(t):
    """Questions as an archive has them, an XML entry each, some archives with a folder inside and some without."""
    q = spread(t("parsed_questions").where("source = 'AN'").select("id", "numero_question", "legislature", "objet")).distinct()
    esc = F.coalesce(F.replace(F.replace(F.col("objet"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(""))
    entry = F.concat(
        F.lit("<question><identifiant><numero>"), "numero_question", F.lit("</numero><legislature>"), "legislature", F.lit("</legislature></identifiant><type>QE</type><indexationAN><rubrique>"), esc,
        F.lit("</rubrique></indexationAN></question>"),
    )
    folder = _folder(q, "zip")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = BytesIO()
            below = "xml/" * (batch.num_rows % 2)
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    z.writestr(f"{below}{name}.xml", text)
                z.writestr("notes/readme.txt", "no question")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{uuid.uuid4().hex}.zip"], "content": [out.getvalue()]})

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files.write_bytes(path, content)
            yield batch.select(["path"])

    q.select("id", entry.alias("entry")).mapInArrow(pack, "path string, content binary").mapInArrow(put, "path string").count()
    read = archives.parse_questions(archives.question_elements(archives.zip_entries(q.sparkSession, folder), "content"))
    # a task that ran twice wrote its archive twice
    return read.select("id", "numero_question", "legislature", "objet").distinct()


@query("SELECT DISTINCT 'question' AS collection, id, len(vector) AS dims, round(list_sum(CAST(vector AS DOUBLE[])), 4) AS total, payload FROM vec_questions_opendata WHERE id IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0")
def points_exchanged(t):
    """The points written as JSON lines and read again; numbers that JSON hasn't are left out."""
    p = t("vec_questions_opendata").where("id is not null").where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    folder = _folder(p, "points")
    files.write_points(p.select(F.lit("question").alias("collection"), "id", "vector", "payload"), folder)
    read = files.read_points(p.sparkSession, folder, "question")
    total = F.when(F.size("vector") > 0, F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 4))
    return read.select("collection", "id", F.size("vector").cast("bigint").alias("dims"), total.alias("total"), "payload").distinct()


@query("SELECT reponse_id AS group_id, id AS question_id FROM (SELECT DISTINCT id, reponse_id FROM parsed_questions WHERE reponse_id IS NOT NULL) QUALIFY count(*) OVER (PARTITION BY reponse_id) >= 2")
def groups_exchanged(t):
    """Questions answered together written as CSV and read again."""
    q = t("parsed_questions").select(F.col("reponse_id").alias("lot_id"), F.col("id").alias("question_id")).where("lot_id is not null").distinct()
    folder = _folder(q, "groups")
    files.write_groups(q, folder, "lot_id")
    return files.read_groups(q.sparkSession, folder)


@query(
    """WITH f AS (SELECT source_file AS path, md5(coalesce(max(payload), '')) AS h FROM raw_an_questions WHERE source_file IS NOT NULL GROUP BY 1), m AS (SELECT path, CASE WHEN path LIKE 'lot_0%' THEN md5(h) ELSE h END AS h FROM f)
SELECT path, h AS document_hash, CAST(NULL AS VARCHAR) AS chunks FROM m WHERE path NOT LIKE 'lot_1%' UNION ALL SELECT NULL, h, '[' || path || ']' FROM m WHERE path NOT LIKE 'lot_1%'"""
)
def stores_kept(t):
    """Manifest and chunk cache: filled, some files delivered anew, and all below one folder forgotten."""
    found = t("raw_an_questions").where("source_file is not null").groupBy(F.col("source_file").alias("path")).agg(F.md5(F.coalesce(F.max("payload"), F.lit("")).cast("binary")).alias("document_hash"))
    spark = found.sparkSession
    manifest, cache = stores.manifest(spark, _folder(found, "manifest")), stores.chunk_cache(spark, _folder(found, "cache"))
    chunked = lambda df: df.select(F.lit("lines").alias("strategy"), "document_hash", F.format_string("[%s]", "path").alias("chunks"))
    manifest.upsert(found)
    cache.upsert(chunked(found.where(~F.col("path").startswith("lot_0"))))
    again = incremental.fresh_files(found.withColumn("document_hash", F.when(F.col("path").startswith("lot_0"), F.md5("document_hash")).otherwise(F.col("document_hash"))), manifest.rows())
    cache.upsert(chunked(again))
    manifest.upsert(again)
    gone = incremental.under_prefix(manifest.rows(), "lot_1")
    stores.forget(cache, gone)
    manifest.delete(F.col("path").startswith("lot_1"))
    return manifest.rows().select("path", "document_hash", F.lit(None).cast("string").alias("chunks")).unionAll(cache.rows().select(F.lit(None).cast("string"), "document_hash", "chunks"))
