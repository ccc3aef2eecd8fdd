"""The queries of the language problems over the project's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.labels import ministry_matcher, office_matcher
from corvane.llm.leakage import leaks
from corvane.llm.matching import collect_list, entries_of, leading_words, match_columns
from corvane.llm.mojibake import restored
from corvane.llm.neardup import classes, expand, near_duplicates
from corvane.llm.tokens import token_ids
from corvane.llm.vectors import similar_pairs
from corvane.session import load

#: Where the public vocabularies lie; every executor has them.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """The ministry, direction or office that each typed value means, -1 for none."""
    ministries = collect_list(load(spark, root, "ministeres"), "id", "titre_jo", "intitule_min")
    directions = collect_list(load(spark, root, "directions"), "id", "nom", "description")
    offices = collect_list(load(spark, root, "bureaux"), "id", "nom", "direction_id")
    asked = match_columns(load(spark, root, "parsed_questions"), "id", ["ministre_libelle"], lambda: ministry_matcher(ministries))
    drafted = match_columns(
        load(spark, root, "question_bureau_extract"), "id", ["direction_txt", "sous_direction", "bureau"], lambda: office_matcher(directions, offices)
    )
    return asked.unionAll(drafted).distinct()


def p3_within(spark: SparkSession, root: str) -> DataFrame:
    """All ministries within the distance that the length of a typed ministry allows, and their distances."""
    ministries = collect_list(load(spark, root, "ministeres"), "id", "titre_jo", "intitule_min")
    return entries_of(load(spark, root, "parsed_questions"), "id", "ministre_libelle", ministries, leading_words([m[1] for m in ministries])).distinct()


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of ids of one table whose texts share at least 0.6 of their sets of three successive words."""
    return expand(*_near(spark, root))


def p4_classes(spark: SparkSession, root: str) -> DataFrame:
    """The same a row for each id: its class, how many ids have the class, and to how many other classes it is linked."""
    return classes(*_near(spark, root))


def _near(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    tables = [
        (load(spark, root, "parsed_questions"), "parsed_questions", "id", "texte_question"),
        (load(spark, root, "reponses"), "reponses", "id", "texte_reponse"),
    ]
    return near_duplicates(tables, size=3, least=0.6)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of vectors of one table, one among the other's five most similar, with a cosine of at least 0.9."""
    found = [
        similar_pairs(load(spark, root, f"vec_{name}s_opendata"), "id", "vector", dims=64, k=5, least=0.9).select(F.lit(name).alias("coll"), "id_a", "id_b")
        for name in ("question", "answer")
    ]
    return found[0].unionAll(found[1])


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """The token ids of every document by the byte-level vocabulary."""
    return token_ids(load(spark, root, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """The evaluation items of which each document holds a run of at least twelve words."""
    return leaks(load(spark, root, "documents"), load(spark, root, "eval_items"))


def p9_edited(spark: SparkSession, root: str) -> DataFrame:
    """The same with at most two words of the twelve put in, left out or replaced."""
    return leaks(load(spark, root, "documents"), load(spark, root, "eval_items"), edits=2)


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """The garbled documents and the MD5 of their original text."""
    return restored(load(spark, root, "documents"))


QUERIES = {
    "p3_found": p3_found,
    "p3_within": p3_within,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_edited": p9_edited,
    "p10_found": p10_found,
}
_SETS = r"""
WITH d AS (SELECT DISTINCT 'parsed_questions' AS tbl, id, texte_question AS x FROM parsed_questions UNION SELECT 'reponses', id, texte_reponse FROM reponses),
w AS (SELECT tbl, id, regexp_extract_all(lower(x), '[\p{L}\p{N}]+') AS w FROM d WHERE x IS NOT NULL),
s AS (SELECT DISTINCT tbl, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT tbl, id, w, unnest(range(1, len(w) - 1)) AS i FROM w))"""
SQL: dict[str, str] = {
    "p4_found": _SETS
    + """, n AS (SELECT tbl, id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.tbl, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.tbl = b.tbl AND a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT p.tbl, id_a, id_b FROM p JOIN n x ON x.tbl = p.tbl AND x.id = id_a JOIN n y ON y.tbl = p.tbl AND y.id = id_b WHERE c * 10 >= 6 * (x.n + y.n - c)""",
    "p4_classes": _SETS
    + """, c AS (SELECT tbl, id, md5(string_agg(g, '|' ORDER BY g)) AS h, count(*) AS n FROM s GROUP BY tbl, id),
k AS (SELECT tbl, h, min(id) AS class_id, count(*) AS copies, any_value(n) AS n FROM c GROUP BY ALL),
r AS (SELECT s.tbl, s.id, g, n FROM s JOIN k ON s.tbl = k.tbl AND s.id = k.class_id),
p AS (SELECT a.tbl, a.id AS x, b.id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM r a JOIN r b ON a.tbl = b.tbl AND a.g = b.g AND a.id <> b.id GROUP BY 1, 2, 3),
l AS (SELECT tbl, x, count(*) AS links FROM p WHERE c * 10 >= 6 * (na + nb - c) GROUP BY ALL)
SELECT c.tbl, c.id, class_id, copies, coalesce(links, 0) AS links FROM c JOIN k USING (tbl, h) LEFT JOIN l ON l.tbl = c.tbl AND l.x = class_id""",
    "p7_found": """
WITH v AS (SELECT DISTINCT 'question' AS coll, id, CAST(vector AS DOUBLE[]) AS v FROM vec_questions_opendata UNION SELECT 'answer', id, CAST(vector AS DOUBLE[]) FROM vec_answers_opendata),
u AS MATERIALIZED (SELECT * FROM v WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT a.coll, a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.coll = b.coll AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY coll, x ORDER BY c DESC, y) AS k FROM s WHERE c >= 0.9)
SELECT DISTINCT coll, least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE k <= 5""",
}
