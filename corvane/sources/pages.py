"""Web pages of questions to text and to records, as expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.dates import find_day
from corvane.functions.labels import author_parts, state_of_page
from corvane.functions.text import blank_to_null

#: Elements whose text isn't shown, and those that end a line.
HIDDEN = "script|style|noscript"
BLOCKS = "p|br|div|li|td|th|h1|h2|h3|h4|h5"
#: The form of a page's question id, and what names pages as the place of publication.
PAGE_ID, PAGE_SOURCE = r"(?i)^SENAT-(\d+)-QE-(\d+)$", "SENAT-WS"
# The labels of a page's fields.
FIELDS = {
    "titre": r"(?:Titre\s*:?|Question\s+(?:écrite|n[°º])\s*\d+\s*[-–]\s*)([^\n]+)",
    "auteur": r"(?:Auteur\s*:?\s*M(?:me|\.)?\.?\s*)([^\n,\(]+)",
    "ministre_libelle": r"(?:Minist[eè]re\s+(?:attributaire|int[eé]ress[eé]|de\s+d[eé]p[oô]t)\s*:?\s*)([^\n]+)",
    "date_publication_jo": r"(?:Publi[eé]e?\s+(?:au\s+JO\s+)?(?:le\s+)?|Date\s+de\s+publication\s*:?\s*)(\d{2}/\d{2}/\d{4})",
    "date_reponse_jo": r"(?:R[ée]ponse\s+publi[eé]e?\s+(?:au\s+JO\s+)?(?:le\s+)?|Date\s+de\s+r[eé]ponse\s*:?\s*)(\d{2}/\d{2}/\d{4})",
    "ministre_reponse_libelle": r"(?:Minist[eè]re\s+(?:charg[eé]\s+de\s+la\s+r[eé]ponse|ayant\s+r[eé]pondu)\s*:?\s*)([^\n]+)",
    "texte_question": r"(?:Texte\s+de\s+la\s+question\s*:?\s*\n+)((?s:.+?))(?=\n\s*(?:Texte\s+de\s+la\s+r[eé]ponse|R[eé]ponse|$))",
    "texte_reponse": r"(?:Texte\s+de\s+la\s+r[eé]ponse\s*:?\s*\n+)((?s:.+?))(?=\n\s*(?:R[eé]f[eé]rence|Source|$))",
}


@F.pandas_udf(T.StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    """Character references, named and numeric, as the characters they stand for."""
    return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)


def page_text(page: Column) -> Column:
    """The shown text of a page: a line break where a block ends, never more than one empty line. What is hidden and never closed hides the rest."""
    t = F.regexp_replace(page, rf"(?is)<({HIDDEN})\b.*?(?:</(?:{HIDDEN})\s*>|\z)", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?(?:-->|\z)", "")
    t = F.regexp_replace(t, rf"(?i)</(?:{BLOCKS})\b[^>]*>|<(?:{BLOCKS})(?:\s[^>]*)?/>", "\n")
    t = F.regexp_replace(t, "(?s)<[a-zA-Z/!?][^>]*>", "")
    return F.regexp_replace(_decoded(t), r"\n{3,}", "\n\n")


def page_field(text: Column, name: str) -> Column:
    """A labelled field of a page's text, or null."""
    return blank_to_null(F.regexp_extract(text, "(?iuU)" + FIELDS[name], 1))


def parse_pages(df: DataFrame, ident: str, page: str) -> DataFrame:
    """A row per page with a question text, of the question that the page's id names. The fields of a reply are read only on a page that speaks of one."""
    t = df.select(F.col(ident).alias("id"), page_text(F.col(page)).alias("t"))
    field = lambda name, most=None: F.substring(page_field(F.col("t"), name), 1, most) if most else page_field(F.col("t"), name)
    author = author_parts(field("auteur"))
    part = lambda k: F.regexp_extract("id", PAGE_ID, k).try_cast("int")
    answered = F.col("etat_question") == "REPONDU"
    reply = lambda c: F.when(answered, c)
    rows = t.withColumn("etat_question", state_of_page(F.col("t")))
    return rows.select(
        "id",
        part(2).alias("numero_question"),
        F.lit("QE").alias("type"),
        F.lit("SENAT").alias("source"),
        part(1).alias("legislature"),
        "etat_question",
        find_day(field("date_publication_jo")).alias("date_publication_jo"),
        field("ministre_libelle", 300).alias("ministre_libelle"),
        author["nom"].alias("auteur_nom"),
        author["prenom"].alias("auteur_prenom"),
        field("titre", 500).alias("titre_senat"),
        F.lit(None).cast("string").alias("objet"),
        field("texte_question").alias("texte_question"),
        reply(F.concat(F.lit(f"{PAGE_SOURCE}-"), "id")).alias("reponse_id"),
        reply(field("texte_reponse")).alias("texte_reponse"),
        reply(F.lit(PAGE_SOURCE)).alias("no_publication"),
        reply(find_day(field("date_reponse_jo"))).alias("date_reponse_jo"),
        reply(field("ministre_reponse_libelle", 300)).alias("ministre_reponse_libelle"),
    ).where("texte_question is not null")
