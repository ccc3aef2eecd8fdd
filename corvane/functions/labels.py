"""Labels, states and office keys as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import blank_to_null, strip

#: Key words of a state's label, in order of priority.
STATE_WORDS = (
    ("réponse", "REPONDU"),
    ("reçue", "REPONDU"),
    ("retirée", "RETIRE"),
    ("rappelée", "RETIRE"),
    ("caduque", "CADUQUE"),
    ("cours", "EN_COURS"),
)
#: First days of legislatures, latest first.
LEGISLATURES = (("2024-07-18", 17), ("2022-06-22", 16), ("2017-06-21", 15), ("2012-06-20", 14))
FIRST_LEGISLATURE = 13
#: Acronyms of the drafting directions.
DIRECTIONS = (
    "DGCS", "DGOS", "DSS", "DGS", "DGEFP", "DGT",
    "DFAS", "DGE", "DGCCRF", "DGALN", "DGPR", "DGAMPA",
    "DAJ", "DRH", "DNS", "DREES", "DIPLP", "DARES",
)
#: Kinds of workflow step that show the office.
SIGNAL_STEPS = ("Pour rédaction", "Pour rédaction interfacée", "Pour attribution")


def state_of_label(label: Column) -> Column:
    """The state of the first key word in a label; without one it is in progress."""
    low = F.lower(label)
    first = reduce(lambda acc, kv: acc.when(low.contains(kv[0]), kv[1]), STATE_WORDS[1:], F.when(low.contains(STATE_WORDS[0][0]), STATE_WORDS[0][1]))
    return first.otherwise("EN_COURS")


def state_of_page(text: Column) -> Column:
    """The state a page's text speaks of."""
    return F.when(text.rlike(r"(?iuU)r[eé]ponse\s+publi[eé]e"), "REPONDU").when(text.rlike(r"(?iuU)retir[eé]e|caduque"), "RETIRE").otherwise("EN_COURS")


def legislature_of(day: Column) -> Column:
    """The legislature a day lies in."""
    out = F.when(day.isNull(), F.lit(None).cast("int"))
    for first, number in LEGISLATURES:
        out = out.when(day >= F.lit(first).cast("date"), number)
    return out.otherwise(FIRST_LEGISLATURE)


def author_parts(raw: Column) -> Column:
    """``nom, prenom`` of "Prénom NOM"; else the text itself and null."""
    form = r"(?U)^([A-ZÀ-Ú][a-zà-ú\-]+)\s+([A-ZÀ-Ú\-]+)$"
    whole = strip(raw)
    fits = whole.rlike(form)
    return F.struct(
        F.when(fits, F.regexp_extract(whole, form, 2)).otherwise(whole).alias("nom"),
        F.when(fits, F.regexp_extract(whole, form, 1)).alias("prenom"),
    )


def source_of(cell: Column) -> Column:
    up = F.upper(strip(cell))
    return F.when(up.startswith("SENAT"), "SENAT").when(up.startswith("AN"), "AN")


def digits_of(cell: Column) -> Column:
    """The number a cell ends with, else the first in it."""
    text = strip(cell)
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\d{1,7})\s*$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(\d{1,7})", 1), F.lit("")))


def lot_of(text: Column) -> Column:
    """``LOT-SOURCE-n`` of a lot marker; null without one."""
    form = r"(?iuU)\bLot\s*(?:QE\s+)?(AN|S[EÉ]NAT|SEN)\.?\s*(\d{2,7})\b"
    source = F.when(F.upper(F.regexp_extract(text, form, 1)) == "AN", "AN").otherwise("SENAT")
    return F.when(text.rlike(form), F.concat(F.lit("LOT-"), source, F.lit("-"), F.regexp_extract(text, form, 2).try_cast("int").cast("string")))


def post_segments(post: Column) -> Column:
    """The parts of a workflow post between spaced hyphens, blank ones dropped."""
    return F.filter(F.transform(F.split(strip(post), r"(?U)\s+-\s+"), strip), lambda x: x != "")


def post_parts(post: Column) -> Column:
    """``direction, sous_direction, bureau, bureau_full`` of a post with three parts or more whose first is a known direction; else null."""
    seg = post_segments(post)
    known = (F.size(seg) >= 3) & F.get(seg, F.lit(0)).isin(*DIRECTIONS)
    return F.when(
        known,
        F.struct(
            F.get(seg, F.lit(0)).alias("direction"),
            F.get(seg, F.lit(1)).alias("sous_direction"),
            F.get(seg, F.lit(2)).alias("bureau"),
            F.array_join(F.slice(seg, 3, F.greatest(F.size(seg) - 2, F.lit(1))), " - ").alias("bureau_full"),
        ),
    )


def bracket_key(label: Column, sub_only: bool = False) -> Column:
    """The code in brackets before an office's name; with ``sub_only`` just those of the form ``SDn/x``."""
    form = r"(?iU)^\s*\[(SD\d+/\w+)\]" if sub_only else r"(?U)^\s*\[([^\]]+)\]"
    return F.nullif(F.upper(F.replace(F.regexp_extract(label, form, 1), F.lit(" "), F.lit(""))), F.lit(""))


def typed_key(sub: Column, office: Column) -> Column:
    """``SUB`` or ``SUB/CODE`` of an office as typed: the code after "Bureau", else the first word; null without a sub-direction."""
    place = F.upper(F.replace(strip(sub), F.lit(" "), F.lit("")))
    form = r"(?iU)^\s*Bureau\s+(\w+)"
    coded = F.nullif(F.upper(F.regexp_extract(office, form, 1)), F.lit(""))
    word = F.nullif(F.upper(F.get(F.split(strip(office), r"[\s/,-]+"), F.lit(0))), F.lit(""))
    key = F.when(blank_to_null(office).isNull(), place).otherwise(F.concat(place, F.coalesce(F.concat(F.lit("/"), F.coalesce(coded, word)), F.lit(""))))
    return F.when(blank_to_null(sub).isNotNull(), key)


def joined_label(*parts: Column, by: str = " — ") -> Column:
    """The parts that aren't blank, stripped and joined; null where none is left."""
    return F.nullif(F.concat_ws(by, *[blank_to_null(p) for p in parts]), F.lit(""))
