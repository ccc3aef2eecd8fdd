"""Splits an enquiry's text into context and request, as column expressions.

The opener is the first of the patterns, in their order, that matches in the text's head; the closer is the one that begins earliest in its
tail. Whether an opener matches is all that counts, so after its verb the first connecting word is kept for good and any later end of a sentence
will do: no pattern goes back over the text. A look for the verb comes before each pattern. All closers are one alternation, and what it
finds says which of them it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import squeeze, unescape

# The lengths of head and tail, and the patterns of reminders, openers and closers.
HEAD, TAIL = 1500, 900
REMINDER = r"\brappelle\s+à\s+.{1,300}?\bles\s+termes\s+de\s+sa\s+question\b"
END = r"(?:\.\s+[A-ZÀ-Ý]|\.\s*$)"
CONNECTORS = (
    r"(?:sur|concernant|au\s+sujet\s+d(?:e|u|es|['’])|à\s+propos\s+d(?:e|u|es|['’])|quant\s+(?:à|au|aux)"
    r"|relative(?:ment)?\s+(?:à|au|aux)|relatifs?\s+(?:à|au|aux))"
)
#: The label of an opener, its verb, what must follow in the same text, and the word that leads to the object.
OPENERS = (
    ("attire/appelle l'attention", r"(?:attire|appelle)\s+l['’]attention\s+d[e'’]", CONNECTORS),
    ("souhaite attirer/appeler l'attention", r"souhaite\s+(?:attirer|appeler)\s+l['’]attention\s+d[e'’]", CONNECTORS),
    ("interroge", r"\binterroge\s+", CONNECTORS),
    ("alerte", r"\balerte\s+", CONNECTORS),
    ("questionne", r"\bquestionne\s+", CONNECTORS),
    ("expose à … que", r"\bexpose\s+à\s+", "que"),
    ("demande à … de", r"\bdemande\s+à\s+", "de"),
    ("prie … de", r"\bprie\s+", "de"),
    ("aux fins de connaître", r"aux\s+fins\s+de\s+connaître\s+", None),
)
#: A word of each opener, in capitals, without which it can't match.
GATES = ("ATTENTION", "ATTENTION", "INTERROGE", "ALERTE", "QUESTIONNE", "EXPOSE", "DEMANDE", "PRIE", "FINS")
OBJECT = r"(?:(?:lui|se|le|la|leur|les)\s+|l['’])?"
CLOSERS = (
    ("il/elle demande", rf"\b(?:il|elle)\s+{OBJECT}demande(?:ra|rait)?\b"),
    ("il/elle souhaite", r"\b(?:il|elle)\s+souhait(?:e|erait|ait|erais)\b"),
    ("il/elle voudrait/aimerait/prie", rf"\b(?:il|elle)\s+{OBJECT}(?:voudrait|aimerait|prie|sollicite)\b"),
    ("il/elle interroge", rf"\b(?:il|elle)\s+{OBJECT}interroge\b"),
    ("il/elle remercie", rf"\b(?:il|elle)\s+{OBJECT}remercie\b"),
    ("il/elle propose/attend/invite/appelle/interpelle", rf"\b(?:il|elle)\s+{OBJECT}(?:propose|attend|invite|appelle|interpelle)\b"),
    ("il est demandé", r"\bil\s+(?:lui\s+|leur\s+)?est\s+(?:donc\s+)?demandé\b"),
    ("il/elle alerte", rf"\b(?:il|elle)\s+{OBJECT}alerte\b"),
    (
        "inversion souhaite/demande/pourrait -t-il/elle",
        r"\b(?:l['’]|le\s+|la\s+|les\s+|lui\s+|leur\s+)?"
        r"(?:demande|souhait(?:e|erait|ait)|voudrait|aimerait|pourrait|peut|prie|entend|envisage|compte|remercie|invite|appelle|interroge|interpelle)"
        r"[-\s](?:t[-\s])?(?:il|elle)\b",
    ),
    ("aussi/enfin, …", r"\b(?:aussi|enfin)[,\s]+(?:qu[ei]|comment|dans|il|elle|le\s+ministre|lui)\b"),
    ("que compte/comptent", r"\bqu[ei]\s+compt(?:e|ent)[-\s]t[-\s](?:il|elle|ils|elles)\b"),
)
_FLAGS = "(?iuUs)"
_FIRST_CLOSER = _FLAGS + "^(.*?)(" + "|".join(f"(?:{p})" for _, p in CLOSERS) + ")"


def is_reminder(text: Column) -> Column:
    """Whether the text repeats the terms of an earlier enquiry."""
    return F.coalesce(text.rlike(_FLAGS + REMINDER), F.lit(False))


def opener_pattern(verb: str, leads: str | None) -> str:
    return verb + ("" if leads is None else rf"(?>.+?\b{leads}\s+)") + ".+" + END


def _let(value: Column, build) -> Column:
    """An expression of a value that is evaluated once, however often the expression uses it."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def opener_label(text: Column) -> Column:
    def build(x: Column) -> Column:
        found = [(x["large"].contains(gate) & x["head"].rlike(_FLAGS + opener_pattern(verb, leads)), label) for (label, verb, leads), gate in zip(OPENERS, GATES)]
        return reduce(lambda acc, y: acc.when(*y), found[1:], F.when(*found[0]))

    head = F.substring(text, 1, HEAD)
    return _let(F.struct(head.alias("head"), F.upper(head).alias("large")), build)


def closer_label(found: Column) -> Column:
    """Which closer a piece of text is: the first whose pattern it begins with."""
    tests = [(found.rlike(_FLAGS + "^(?:" + p + ")"), label) for label, p in CLOSERS]
    return reduce(lambda acc, x: acc.when(*x), tests[1:], F.when(*tests[0]))


def split_text(text: Column) -> Column:
    """``is_reminder, context, request, opener_label, closer_label``; nulls and false for a blank text."""

    def build(t: Column) -> Column:
        tail = F.when(F.length(t) <= TAIL, t).otherwise(F.right(t, F.lit(TAIL)))
        parts = F.struct(
            # what stands before the first closer, counted in characters, whatever plane they are of; and the closer
            _let(tail, lambda x: F.struct(F.length(F.regexp_extract(x, _FIRST_CLOSER, 1)).alias("before"), F.regexp_extract(x, _FIRST_CLOSER, 2).alias("text"))).alias("closer"),
            opener_label(t).alias("opener"),
            (squeeze(t) == "").alias("blank"),
        )
        return _let(parts, lambda x: fields(t, x))

    def fields(t: Column, x: Column) -> Column:
        closer, closed = x["closer"]["text"], x["closer"]["text"] != ""
        start = F.greatest(F.length(t) - TAIL, F.lit(0)) + x["closer"]["before"] + 1
        context = F.nullif(squeeze(F.substring(t, F.lit(1), start - 1)), F.lit(""))
        request = F.when(closed, squeeze(F.substring(t, start, F.length(t)))).when(x["opener"].isNotNull(), squeeze(t))
        return F.struct(
            (~x["blank"] & is_reminder(t)).alias("is_reminder"),
            F.when(~x["blank"] & closed, context).alias("context"),
            F.when(~x["blank"], F.nullif(request, F.lit(""))).alias("request"),
            F.when(~x["blank"], x["opener"]).alias("opener_label"),
            F.when(~x["blank"] & closed, closer_label(closer)).alias("closer_label"),
        )

    return _let(unescape(F.coalesce(text, F.lit(""))), build)
