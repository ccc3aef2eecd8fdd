"""The queries of the general data problems over the project's tables."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.dates import parse_day
from corvane.functions.text import strip
from corvane.operators.instants import instant_us
from corvane.operators.nested import NodeKind, linked_table
from corvane.operators.packed import explode_values
from corvane.operators.snapshots import Ordinals, snapshot_changes
from corvane.session import load, shared_dir, spread

QUESTION = NodeKind("questionsEcrites", "question", {"numero": "identifiant.numero", "legislature": "identifiant.legislature"})
REPLY = NodeKind("textesReponse", "texteReponse", {"texte": "texte", "date_jo": "infoJO.dateJO"})
COMPARED = ("etat_question", "sorquecod", "ministre_libelle", "titre", "page_jo")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """One row per reply node with text, linked to its question and raw record."""
    nodes = linked_table(load(spark, root, "raw_an_questions"), "raw_id", "payload", REPLY, QUESTION)
    text, numero, leg = strip(F.col("texte")), strip(F.col("parent_numero")), strip(F.col("parent_legislature"))
    question = F.concat(F.lit("AN-"), leg, F.lit("-QE-"), numero)
    day = parse_day(F.col("date_jo"))
    reply = F.concat(F.lit("AN-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), F.substring(F.sha1(text.cast("binary")), 1, 12))
    return nodes.where((text != "") & (numero != "") & (leg != "")).select(
        "raw_id",
        F.col("parent_pos").cast("int").alias("question_pos"),
        F.col("pos").cast("int").alias("reponse_pos"),
        question.alias("question_id"),
        F.coalesce(reply, question).alias("reponse_id"),
    )


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Question ids added, removed or changed from each delivery of a source to the next.

    The ordinals of the ids stay in the shared folder, one dictionary for each table, and are taken up again by the next run.
    """
    snapshots = load(spark, root, "question_snapshots")
    name = hashlib.sha256(root.encode()).hexdigest()[:16]
    ordinals = Ordinals(spark, f"{shared_dir(spark).rstrip('/')}/corvane-ordinals/{name}")
    return snapshot_changes(snapshots, COMPARED, codes=("sorquecod",), known=ordinals.extend(snapshots))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The exact instant of every date text that names one."""
    parts = [("parsed_questions", ["date_publication_jo"]), ("tam_questions", ["datejodepot", "datejorep1"])]

    def moments(table: str, fields: list[str]) -> DataFrame:
        # generated rows, filtered after: each text is read once, and a table scanned once for all its fields
        found = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), instant_us(F.col(f)).alias("utc_us")) for f in fields]))
        rows = spread(load(spark, root, table).select("id", *fields)).select(F.col("id").cast("string").alias("rec_id"), found)
        return rows.where(F.col("utc_us").isNotNull()).select("field", "rec_id", "utc_us")

    return reduce(DataFrame.unionAll, [moments(*p) for p in parts]).distinct()


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """One theme per row with its place in the field."""
    return explode_values(load(spark, root, "tam_questions"), "id", "themes_raw")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found, "p6_found": p6_found}

_QUOTED = '"(?:[^"]|"")*"'
_ANGLED = "«(?:[^«»]|«(?:[^«»]|«[^«»]*»)*»)*»"
_BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIPPED = lambda c: f"regexp_replace({c}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"
_T2 = "nullif(regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), {z}, ''), '')"
SQL = {
    # angle quotes three deep, deeper than any in the tables
    "p6_found": f"""
WITH d AS (SELECT DISTINCT id, themes_raw AS x FROM tam_questions WHERE themes_raw IS NOT NULL),
u AS (SELECT id, x, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM (SELECT id, x, regexp_extract_all(x, '(?:{_QUOTED}|{_ANGLED}|[^#|;,\t\n\r])+') AS l FROM d)),
s AS (SELECT id, x, k, {_STRIPPED('p')} AS p FROM u),
v AS (SELECT id, x, k, CASE WHEN regexp_full_match(p, '(?s){_QUOTED}') THEN {_STRIPPED("replace(substr(p, 2, length(p) - 2), chr(34) || chr(34), chr(34))")}
  WHEN regexp_full_match(p, '(?s){_ANGLED}') THEN {_STRIPPED("substr(p, 2, length(p) - 2)")} ELSE p END AS val FROM s)
SELECT DISTINCT id, CAST(row_number() OVER (PARTITION BY id, x ORDER BY k) AS INTEGER) AS pos, val FROM v WHERE val <> ''""",
    "p1_found": r"""
WITH o AS (SELECT raw_id, CAST(payload AS JSON)->'$.archive.questionsEcrites.question' AS x FROM raw_an_questions WHERE json_valid(payload)),
q AS (SELECT raw_id, unnest(a) AS q, unnest(range(len(a)))::INTEGER AS question_pos FROM (SELECT raw_id, CASE WHEN json_type(x) = 'ARRAY' THEN CAST(x AS JSON[]) ELSE [x] END AS a FROM o WHERE x IS NOT NULL)),
r AS (SELECT raw_id, question_pos, trim(q->>'$.identifiant.numero') AS n, trim(q->>'$.identifiant.legislature') AS l, q->'$.textesReponse.texteReponse' AS x FROM q WHERE json_type(q) = 'OBJECT'),
s AS (SELECT * EXCLUDE (a), unnest(a) AS r, unnest(range(len(a)))::INTEGER AS reponse_pos FROM (SELECT raw_id, question_pos, n, l, CASE WHEN json_type(x) = 'ARRAY' THEN CAST(x AS JSON[]) ELSE [x] END AS a FROM r WHERE x IS NOT NULL AND n <> '' AND l <> '')),
t AS (SELECT *, regexp_replace(CASE WHEN json_type(r->'$.texte') = 'OBJECT' THEN r->>'$.texte."#text"' ELSE r->>'$.texte' END, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') AS txt, trim(r->>'$.infoJO.dateJO') AS d FROM s WHERE json_type(r) = 'OBJECT')
SELECT raw_id, question_pos, reponse_pos, 'AN-' || l || '-QE-' || n AS question_id,
  coalesce('AN-' || strftime(coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%d/%m/%Y')), '%Y%m%d') || '-' || substr(sha1(txt), 1, 12), 'AN-' || l || '-QE-' || n) AS reponse_id
FROM t WHERE txt <> ''""".replace("\\\\", "\\"),
    "p2_found": f"""
WITH r AS (
  SELECT source, snapshot_no, id, loaded_at,
    {_T2.format(c='etat_question', z="'^$'")} AS a, {_T2.format(c='sorquecod', z="'^0+(.)', '\\1'").replace(", '')", ")", 1)} AS b,
    {_T2.format(c='ministre_libelle', z="'^$'")} AS c, {_T2.format(c='titre', z="'^$'")} AS d, page_jo AS e
  FROM question_snapshots WHERE source IS NOT NULL AND snapshot_no IS NOT NULL AND id IS NOT NULL),
l AS (SELECT source, snapshot_no, id, a, b, c, d, e FROM (SELECT *, row_number() OVER (PARTITION BY source, snapshot_no, id
  ORDER BY loaded_at DESC NULLS LAST, a DESC NULLS LAST, b DESC NULLS LAST, c DESC NULLS LAST, d DESC NULLS LAST, e DESC NULLS LAST) AS k FROM r) WHERE k = 1),
s AS (SELECT source, snapshot_no, lag(snapshot_no) OVER (PARTITION BY source ORDER BY snapshot_no) AS prev
  FROM (SELECT DISTINCT source, snapshot_no FROM l)),
n AS (SELECT l.*, s.prev FROM l JOIN s USING (source, snapshot_no) WHERE s.prev IS NOT NULL),
o AS (SELECT l.*, s.snapshot_no AS nxt FROM l JOIN s ON l.source = s.source AND l.snapshot_no = s.prev)
SELECT coalesce(n.source, o.source) AS source, coalesce(n.snapshot_no, o.nxt) AS snapshot_no, coalesce(n.id, o.id) AS id,
  CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM n FULL JOIN o ON n.source = o.source AND n.snapshot_no = o.nxt AND n.id = o.id
WHERE o.id IS NULL OR n.id IS NULL OR n.a IS DISTINCT FROM o.a OR n.b IS DISTINCT FROM o.b OR n.c IS DISTINCT FROM o.c
  OR n.d IS DISTINCT FROM o.d OR n.e IS DISTINCT FROM o.e""",
}
