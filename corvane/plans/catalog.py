"""The queries of the engine's domain operators over the project's tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import plugins
from corvane.functions import dates, ids, labels, splitter, text
from corvane.operators import evaluate, groups, incremental, knn, merge, similar
from corvane.operators.collection import Collection, compile_filter
from corvane.operators.merge import Policy
from corvane.session import load, shared_dir, spread
from corvane.sources import archives, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table loader under its name."""

    def keep(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[build.__name__] = lambda spark, root: build(lambda name: load(spark, root, name))
        if sql:
            SQL[build.__name__] = sql
        return build

    return keep


# neighbours and votes; queries are the rows whose id is divisible by 20

_NEAR = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(q.v, c.v) AS score, c.label AS label FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)"""


def _asked(e: DataFrame) -> DataFrame:
    return e.where(F.col("vec_id") % 20 == 0)


@query(_NEAR + " SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def knn_topk(t):
    e = t("embeddings")
    return knn.nearest(e, _asked(e), "vec_id", "embedding", k=10).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


_VOTE = """, w AS (SELECT query_id, label, sum(score) AS weight FROM r WHERE rank <= 15 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 6) DESC, label) AS n FROM w)"""


@query(_NEAR + _VOTE + " SELECT query_id, label AS predicted, round(weight, 6) AS weight FROM b WHERE n = 1")
def knn_vote(t):
    e = t("embeddings")
    near = knn.nearest(e, _asked(e), "vec_id", "embedding", k=15)
    return knn.vote(near, e.select(F.col("vec_id").alias("id"), "label")).withColumn("weight", F.round("weight", 6))


@query(
    _NEAR
    + """, w1 AS (SELECT query_id, label, sum(score) AS weight FROM r WHERE rank <= 15 GROUP BY ALL), b1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 6) DESC, label) AS n FROM w1),
w2 AS (SELECT query_id, label, sum(score) AS weight FROM r WHERE rank <= 5 GROUP BY ALL),
b2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 6) DESC, label) AS n FROM w2),
x AS (SELECT e.label AS klass, b1.label = e.label AS a, b2.label = e.label AS b FROM e LEFT JOIN b1 ON b1.query_id = e.vec_id AND b1.n = 1 LEFT JOIN b2 ON b2.query_id = e.vec_id AND b2.n = 1 WHERE e.vec_id % 20 = 0)
SELECT CASE WHEN grouping(klass) = 1 THEN 'TOTAL' ELSE CAST(klass AS VARCHAR) END AS klass, count(*) AS n, count_if(a) AS hits_a, count_if(b) AS hits_b,
round(100 * count_if(a) / count(*), 1) AS pct_a, round(100 * count_if(b) / count(*), 1) AS pct_b, round(100 * (count_if(b)::BIGINT - count_if(a)::BIGINT) / count(*), 1) AS delta FROM x GROUP BY ROLLUP (klass)""".replace("count_if(a)", "CAST(count_if(a) AS BIGINT)").replace("count_if(b)", "CAST(count_if(b) AS BIGINT)")
)
def knn_vote_ab(t):
    """Fifteen voters against five."""
    e = t("embeddings")
    voters = e.select(F.col("vec_id").alias("id"), "label")
    near = knn.nearest(e, _asked(e), "vec_id", "embedding", k=15)
    truth = _asked(e).select(F.col("vec_id").alias("query_id"), F.col("label").alias("klass"))
    return evaluate.compare(truth, knn.vote(near, voters), knn.vote(near.where("rank <= 5"), voters))


@query(_NEAR + " SELECT query_id, id, round(score, 6) AS score FROM s WHERE round(score, 9) >= 0.3")
def knn_threshold(t):
    e = t("embeddings")
    return knn.nearest(e, _asked(e), "vec_id", "embedding", k=None, least=0.3).select("query_id", "id", F.round("score", 6).alias("score"))


_POINTS = """WITH p AS (SELECT id, any_value(CAST(vector AS DOUBLE[])) AS v, any_value(payload) AS payload FROM vec_questions_opendata
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY id),
m AS (SELECT id, v, payload, payload->>'$.question_id' AS qid, CAST(payload->>'$.date_publication_jo' AS DATE) AS opened FROM p)"""


def _points(t) -> DataFrame:
    return t("vec_questions_opendata").dropDuplicates(["id"])


def _number(payload) -> object:
    return F.regexp_extract(F.get_json_object(payload, "$.question_id"), r"(\d+)$", 1).try_cast("bigint")


@query(
    _POINTS
    + """, s AS (SELECT q.id AS query_id, c.id AS id, list_cosine_similarity(q.v, c.v) AS score FROM m q JOIN m c ON q.id <> c.id
WHERE CAST(regexp_extract(q.qid, '(\\d+)$', 1) AS BIGINT) % 20 = 0 AND c.payload->>'$.source' = 'AN' AND c.payload->>'$.legislature' IN ('16', '17'))
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS k FROM s) WHERE k <= 5"""
)
def knn_filtered(t):
    spec = {"must": [{"key": "source", "match": {"value": "AN"}}, {"key": "legislature", "match": {"any": [16, 17]}}]}
    p = _points(t)
    return knn.nearest(p.where(compile_filter(spec)), p.where(_number("payload") % 20 == 0), "id", "vector", k=5).select("query_id", "id", F.round("score", 6).alias("score"))


@query(
    _POINTS
    + """, d AS (SELECT id AS qid, min(date_reponse_jo) AS closed FROM parsed_questions GROUP BY id), a AS (SELECT m.*, d.closed FROM m LEFT JOIN d USING (qid)),
s AS (SELECT q.id AS query_id, c.id AS id, list_cosine_similarity(q.v, c.v) AS score FROM a q JOIN a c ON q.id <> c.id
WHERE CAST(regexp_extract(q.qid, '(\\d+)$', 1) AS BIGINT) % 20 = 0 AND c.opened <= q.opened AND (c.closed IS NULL OR c.closed > q.opened)
AND CAST(c.payload->>'$.legislature' AS INTEGER) = CAST(q.payload->>'$.legislature' AS INTEGER))
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS k FROM s) WHERE k <= 5"""
)
def time_anchored_topk(t):
    day = F.get_json_object("payload", "$.date_publication_jo").cast("date")
    leg = F.get_json_object("payload", "$.legislature").cast("int")
    replied = t("parsed_questions").groupBy(F.col("id").alias("qid")).agg(F.min("date_reponse_jo").alias("closed"))
    p = _points(t).select("id", "vector", F.get_json_object("payload", "$.question_id").alias("qid"), day.alias("opened"), leg.alias("klass"), _number("payload").alias("number"))
    corpus = p.join(replied, "qid", "left")
    asked = p.where("number % 20 = 0").withColumnRenamed("opened", "at")
    return knn.nearest(corpus, asked, "id", "vector", k=5, anchored=True, same=True).select("query_id", "id", F.round("score", 6).alias("score"))


_MATES = """, g AS (SELECT q.vec_id AS query_id, c.vec_id AS id FROM e q JOIN e c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)"""


def _mates(e: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = e.select(F.col("vec_id").alias("id"), "label")
    return evaluate.of_mates(near.select("query_id", "id", "rank"), rows.where("id % 20 = 0"), rows, "label")


@query(
    _NEAR + _MATES
    + """, f AS (SELECT g.query_id, count(*) AS n, min(r.rank) AS first, list(r.rank) AS ranks FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.id = g.id AND r.rank <= 20 GROUP BY ALL),
c AS (SELECT unnest([1, 3, 5, 10, 20]) AS k)
SELECT CAST(k AS INTEGER) AS k, count(*) AS n_queries, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END), 4) AS hit, round(avg(len(list_filter(ranks, lambda x: x <= k)) / n), 4) AS recall FROM f, c GROUP BY k"""
)
def hit_recall_at_k(t):
    e = t("embeddings")
    return evaluate.hit_recall(*_mates(e, knn.nearest(e, _asked(e), "vec_id", "embedding", k=20)))


@query(
    _NEAR + _MATES
    + """, f AS (SELECT g.query_id, min(r.rank) AS k FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.id = g.id AND r.rank <= 20 GROUP BY ALL)
SELECT CASE WHEN k = 1 THEN '1' WHEN k <= 3 THEN '2-3' WHEN k <= 5 THEN '4-5' WHEN k <= 10 THEN '6-10' WHEN k <= 20 THEN '11-20' ELSE 'miss' END AS bucket, count(*) AS n FROM f GROUP BY ALL"""
)
def rank_distribution(t):
    e = t("embeddings")
    return evaluate.rank_buckets(*_mates(e, knn.nearest(e, _asked(e), "vec_id", "embedding", k=20)))


@query(
    _NEAR
    + _MATES
    + """, f AS (SELECT g.query_id, min(r.rank) AS k FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.id = g.id AND r.rank <= 20 GROUP BY ALL)
SELECT count(*) AS n_queries, count(k) AS found, round(avg(k), 4) AS mean_rank, CAST(list_sort(list(k) FILTER (k IS NOT NULL))[count(k) // 2 + 1] AS INTEGER) AS upper_median FROM f"""
)
def rank_summary(t):
    e = t("embeddings")
    first = evaluate.first_ranks(*_mates(e, knn.nearest(e, _asked(e), "vec_id", "embedding", k=20)))
    return first.agg(F.count("*").alias("n_queries"), F.count("rank").alias("found"), F.round(F.avg("rank"), 4).alias("mean_rank"), evaluate.upper_median("rank").cast("int").alias("upper_median"))


@query(
    _POINTS
    + """, a AS (SELECT DISTINCT id AS qid, reponse_id, numero_question FROM parsed_questions WHERE reponse_id IS NOT NULL),
z AS (SELECT x.qid, list_cosine_similarity(m1.v, m2.v) AS score FROM a x JOIN a y ON x.reponse_id = y.reponse_id AND x.qid <> y.qid AND x.numero_question % 20 = 0 LEFT JOIN m m1 ON m1.qid = x.qid LEFT JOIN m m2 ON m2.qid = y.qid),
f AS (SELECT qid, count(*) AS n, count_if(score >= 0.75) AS c1, count_if(score >= 0.85) AS c2, count_if(score >= 0.95) AS c3 FROM z GROUP BY qid)
SELECT 0.75::DOUBLE AS threshold, round(avg(c1 / n), 4) AS recall, round(avg(CASE WHEN c1 > 0 THEN 1.0 ELSE 0.0 END), 4) AS hit FROM f
UNION ALL SELECT 0.85::DOUBLE, round(avg(c2 / n), 4), round(avg(CASE WHEN c2 > 0 THEN 1.0 ELSE 0.0 END), 4) FROM f
UNION ALL SELECT 0.95::DOUBLE, round(avg(c3 / n), 4), round(avg(CASE WHEN c3 > 0 THEN 1.0 ELSE 0.0 END), 4) FROM f"""
)
def sibling_recall_threshold(t):
    """The queries are the questions whose number is divisible by 20."""
    asked = t("parsed_questions").select("id", "reponse_id", "numero_question").where("reponse_id is not null").distinct()
    pairs = groups.siblings(asked.where("numero_question % 20 = 0"), asked, "reponse_id", "id")
    v = _usable(_points(t)).select(F.get_json_object("payload", "$.question_id").alias("qid"), "vector")
    scored = (
        pairs.join(v.select(F.col("qid").alias("id"), F.col("vector").alias("a")), "id", "left")
        .join(v.select(F.col("qid").alias("sibling"), F.col("vector").alias("b")), "sibling", "left")
        .select(F.col("id").alias("query_id"), knn.cosine(F.col("a"), F.col("b")).alias("score"))
    )
    return evaluate.threshold_recall(scored, (0.75, 0.85, 0.95))


def _usable(p: DataFrame) -> DataFrame:
    v = F.col("vector")
    return p.where((F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0))


@query(
    _NEAR
    + """, h AS (SELECT CAST(query_id / 20 AS BIGINT) % 3 AS query_no, query_id, id, rank, score FROM r WHERE rank <= 20), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query_no, rank, query_id) AS n FROM h)
SELECT id, query_id, round(score, 6) AS score FROM o WHERE n = 1"""
)
def knn_multi_first_seen(t):
    e = t("embeddings")
    hits = knn.nearest(e, _asked(e), "vec_id", "embedding", k=20)
    hits = hits.withColumn("query_no", (F.col("query_id") / 20).cast("bigint") % 3).withColumn("rank", F.struct("rank", "query_id"))
    return knn.first_seen(hits).select("id", "query_id", F.round("score", 6).alias("score"))


# points of a collection


_HELD = """WITH p AS (SELECT id, max({'payload': payload, 'vector': vector}) AS r FROM vec_questions_opendata
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 AND id IS NOT NULL GROUP BY id),
c AS (SELECT id, r.vector AS vector, r.payload AS payload FROM p)"""


def _folder(df: DataFrame) -> str:
    spark = df.sparkSession
    return f"{shared_dir(spark).rstrip('/')}/corvane-{spark.sparkContext.applicationId}/collection-{uuid.uuid4().hex}"


def _collection(t) -> Collection:
    """A collection with all usable points of the table."""
    held = t("vec_questions_opendata")
    c = Collection(held.sparkSession, _folder(held), "questions_opendata")
    c.upsert(_usable(held))
    return c


def _qid():
    return F.get_json_object("payload", "$.question_id").alias("qid")


@query(_HELD + " SELECT id, payload->>'$.question_id' AS question_id FROM c WHERE payload->>'$.source' = 'SENAT' AND NOT coalesce(payload->>'$.legislature' IN ('15', '16'), false)")
def scroll_filtered(t):
    spec = {"must": [{"key": "source", "match": {"value": "SENAT"}}], "must_not": [{"key": "legislature", "match": {"any": [15, "16"]}}]}
    return _collection(t).scroll(spec, with_vector=False).select("id", F.get_json_object("payload", "$.question_id").alias("question_id"))


@query("SELECT DISTINCT v.id FROM vec_questions_opendata v SEMI JOIN (SELECT id FROM parsed_questions WHERE source = 'AN') p ON v.payload->>'$.question_id' = p.id")
def points_by_ids(t):
    wanted = t("parsed_questions").where("source = 'AN'").select(F.col("id").alias("qid"))
    return t("vec_questions_opendata").select("id", _qid()).join(wanted, "qid", "left_semi").select("id").distinct()


@query(_HELD + ", f AS (SELECT id FROM c ORDER BY id LIMIT 5) SELECT id, list_sum(CAST(vector AS DOUBLE[])) AS total FROM c WHERE id IN (SELECT id FROM f)")
def points_got(t):
    """The first five ids, fetched from the collection by id."""
    c = _collection(t)
    ids_ = [r["id"] for r in c.points().select("id").orderBy("id").limit(5).collect()]
    return c.get_many([*ids_, "no such id"]).select("id", _total().alias("total"))


def _total():
    return F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))


@query(_HELD + " SELECT id, payload->>'$.source' AS source FROM c WHERE NOT coalesce(payload->>'$.legislature' = '17', false)")
def delete_by_filter(t):
    c = _collection(t)
    c.delete({"must": [{"key": "legislature", "match": {"value": 17}}]})
    return c.points().select("id", F.get_json_object("payload", "$.source").alias("source"))


@query(
    _HELD
    + """ SELECT id, list_sum(CAST(CASE WHEN payload->>'$.source' = 'AN' THEN list_reverse(vector) ELSE vector END AS DOUBLE[])) AS total, CAST(CASE WHEN payload->>'$.source' = 'AN' THEN vector[64] ELSE vector[1] END AS DOUBLE) AS head,
CASE WHEN payload->>'$.source' = 'AN' THEN 'AN' ELSE payload END AS payload FROM c"""
)
def point_upsert(t):
    """The points of one source are written again with reversed vectors and a short payload."""
    c = _collection(t)
    source = F.get_json_object("payload", "$.source")
    c.upsert(c.points().where(source == "AN").select("id", F.reverse("vector").alias("vector"), source.alias("payload")))
    return c.points().select("id", _total().alias("total"), F.col("vector")[0].cast("double").alias("head"), "payload")


@query("SELECT coalesce(len(vector), -1)::INTEGER AS dims, count(*) AS n FROM vec_answers_opendata GROUP BY 1")
def vector_sizes(t):
    return t("vec_answers_opendata").groupBy(F.coalesce(F.size("vector"), F.lit(-1)).alias("dims")).agg(F.count("*").alias("n"))


# identifiers, hashes, texts


@query("SELECT DISTINCT id, regexp_replace(substr(sha256(id), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid, regexp_replace(substr(sha256(id || '::v2'), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS variant FROM parsed_questions")
def stable_ids(t):
    return t("parsed_questions").select("id", ids.stable_uuid(F.col("id")).alias("uuid"), ids.variant_uuid(F.col("id"), "v2").alias("variant")).distinct()


@query("SELECT doc_id, sha256(text) AS content_hash, substr(sha1(text), 1, 12) AS short_hash FROM documents")
def content_hashes(t):
    return t("documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"), F.substring(F.sha1(F.col("text").cast("binary")), 1, 12).alias("short_hash"))


@query(
    """SELECT DISTINCT id, CASE WHEN texte_reponse IS NULL THEN NULL WHEN date_reponse_jo IS NULL THEN id ELSE 'AN-' || strftime(date_reponse_jo, '%Y%m%d') || '-' || substr(sha1(texte_reponse), 1, 12) END AS reply_id FROM parsed_questions"""
)
def reply_ids(t):
    return t("parsed_questions").select("id", ids.reply_id(F.col("date_reponse_jo"), F.col("texte_reponse"), F.col("id")).alias("reply_id")).distinct()


@query("SELECT DISTINCT id, split_part(id, '-', 1) AS source_part, CAST(split_part(id, '-', 2) AS VARCHAR) AS leg_part, source || '-' || legislature || '-' || type || '-' || numero_question AS built FROM parsed_questions")
def id_parts(t):
    q = t("parsed_questions")
    built = ids.question_id(F.col("source"), F.col("legislature"), F.col("type"), F.col("numero_question"))
    return q.select("id", ids.id_part(F.col("id"), "source").alias("source_part"), ids.id_part(F.col("id"), "legislature").alias("leg_part"), built.alias("built")).distinct()


_SPACE = "[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


@query(
    f"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'), ' ') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(substr(t, 1, 239), ' +$', '') || '…' END AS preview FROM s"""
)
def previews(t):
    return t("documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, substr(text, 1, 2000) AS cut, length(text) AS chars FROM documents WHERE length(text) > 2000")
def truncations(t):
    return t("documents").where(F.length("text") > 2000).select("doc_id", F.substring("text", 1, 2000).alias("cut"), F.length("text").cast("bigint").alias("chars"))


@query(f"SELECT count(*) AS n, count_if(text IS NULL OR regexp_replace(text, '{_SPACE}+', '', 'g') = '') AS blank FROM documents".replace("count_if(", "CAST(count_if(").replace(" AS blank", " AS BIGINT) AS blank"))
def blank_texts(t):
    return t("documents").agg(F.count("*").alias("n"), F.count_if(text.is_blank(F.col("text"))).alias("blank"))


@query("SELECT DISTINCT id, coalesce(nullif(objet, ''), titre_senat) AS title, coalesce(nullif(texte_question, ''), objet) AS body FROM parsed_questions")
def fallback_texts(t):
    q = t("parsed_questions")
    pick = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    return q.select("id", pick("objet", "titre_senat").alias("title"), pick("texte_question", "objet").alias("body")).distinct()


@query(
    """SELECT DISTINCT id, strftime(coalesce(CASE WHEN regexp_full_match(trim(date_publication_jo, ' '), '\\d{4}-\\d{2}-\\d{2}') THEN try_strptime(trim(date_publication_jo, ' '), '%Y-%m-%d') END,
CASE WHEN regexp_full_match(trim(date_publication_jo, ' '), '\\d{1,2}/\\d{1,2}/\\d{4}') THEN try_strptime(trim(date_publication_jo, ' '), '%d/%m/%Y') END), '%Y-%m-%d') AS day FROM parsed_questions"""
)
def parsed_days(t):
    return t("parsed_questions").select("id", F.date_format(dates.parse_day(F.col("date_publication_jo")), "yyyy-MM-dd").alias("day")).distinct()


@query("SELECT DISTINCT id, try_cast(trim(numero) AS INTEGER) AS number FROM tam_questions")
def plain_numbers(t):
    return t("tam_questions").select("id", ids.plain_number(F.col("numero")).alias("number")).distinct()


@query(
    """SELECT DISTINCT id, CAST(CASE WHEN date_reponse_jo IS NULL THEN NULL WHEN date_reponse_jo >= DATE '2024-07-18' THEN 17 WHEN date_reponse_jo >= DATE '2022-06-22' THEN 16
WHEN date_reponse_jo >= DATE '2017-06-21' THEN 15 WHEN date_reponse_jo >= DATE '2012-06-20' THEN 14 ELSE 13 END AS INTEGER) AS era FROM parsed_questions"""
)
def era_of_date(t):
    return t("parsed_questions").select("id", labels.legislature_of(F.col("date_reponse_jo")).alias("era")).distinct()


@query(
    """SELECT doc_id, CASE WHEN contains(lower(text), 'réponse') THEN 'REPONDU' WHEN contains(lower(text), 'reçue') THEN 'REPONDU' WHEN contains(lower(text), 'retirée') THEN 'RETIRE'
WHEN contains(lower(text), 'rappelée') THEN 'RETIRE' WHEN contains(lower(text), 'caduque') THEN 'CADUQUE' ELSE 'EN_COURS' END AS state FROM documents"""
)
def keyword_state(t):
    return t("documents").select("doc_id", labels.state_of_label(F.col("text")).alias("state"))


@query("SELECT id, upper(replace(nullif(regexp_extract(nom, '^\\s*\\[([^\\]]+)\\]', 1), ''), ' ', '')) AS bureau_key FROM bureaux")
def bracket_keys(t):
    return t("bureaux").select("id", labels.bracket_key(F.col("nom")).alias("bureau_key"))


_W = "[0-9A-Za-z_À-ÖØ-öø-ÿŒœ]"
_TYPED = f"""CASE WHEN trim(sous_direction) <> '' THEN upper(replace(trim(sous_direction), ' ', '')) || CASE WHEN bureau IS NULL OR regexp_replace(bureau, '{_SPACE}', '', 'g') = '' THEN ''
ELSE coalesce('/' || coalesce(nullif(upper(regexp_extract(bureau, '^{_SPACE}*Bureau{_SPACE}+({_W}+)', 1, 'i')), ''), nullif(upper(string_split_regex(regexp_replace(bureau, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '[\\s/,-]+')[1]), '')), '') END END"""


@query(f"SELECT DISTINCT id, {_TYPED} AS bureau_key FROM question_bureau_extract")
def typed_keys(t):
    return t("question_bureau_extract").select("id", labels.typed_key(F.col("sous_direction"), F.col("bureau")).alias("bureau_key")).distinct()


def _linear(pattern: str) -> str:
    """A splitter's pattern for an engine without look-around, in which word and space classes are ASCII: edges of words become characters."""
    edge = "[^\\p{L}\\p{M}\\p{N}\\p{Pc}]"
    p = pattern.replace("(?>.+?\\b", f"(?:.*?{edge}").replace(".{1,300}?\\b", f".{{0,299}}?{edge}").replace("'", "''")
    p = f"(?:^|{edge})" + p.removeprefix("\\b") if p.startswith("\\b") else p
    p = p.removesuffix("\\b") + f"(?:{edge}|$)" if p.endswith("\\b") else p
    p = p.replace("[,\\s]", "[,~]").replace("[-\\s]", "[-~]").replace("\\s", _SPACE)
    return p.replace("~", _SPACE[1:-1])  # inside a class


def _closer_sql(k: int) -> str:
    """Where a closer begins in the tail: what stands before it ends at the edge of a word."""
    p = _linear(splitter.CLOSERS[k][1]).removeprefix("(?:^|[^\\p{L}\\p{M}\\p{N}\\p{Pc}])")
    before = f"regexp_extract(tail, '(?is)^(.*?(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]))({p})', [\'b\', \'c\'])"
    return before.replace("\\'", "'")


def _split_sql() -> str:
    openers = " ".join(f"WHEN regexp_matches(head, '(?is){_linear(splitter.opener_pattern(verb, leads))}') THEN '{label.replace(chr(39), chr(39) * 2)}'" for label, verb, leads in splitter.OPENERS)
    found = ", ".join(f"{{'k': {k}, 'm': {_closer_sql(k)}}}" for k in range(len(splitter.CLOSERS)))
    labels = ", ".join(f"'{label}'" for label, _ in splitter.CLOSERS)
    squeeze = lambda c: f"trim(regexp_replace({c}, '{_SPACE}+', ' ', 'g'), ' ')"
    return f"""WITH q AS (SELECT DISTINCT id, regexp_replace(coalesce(texte_question, ''), '\\\\[rnt]', ' ', 'g') AS t FROM (SELECT DISTINCT id, texte_question FROM parsed_questions)),
h AS (SELECT id, t, substr(t, 1, {splitter.HEAD}) AS head, CASE WHEN length(t) <= {splitter.TAIL} THEN t ELSE right(t, {splitter.TAIL}) END AS tail FROM q),
f AS (SELECT id, t, regexp_matches(t, '(?is){_linear(splitter.REMINDER)}') AS reminds, CASE {openers} END AS opener_label,
  list_filter([{found}], lambda x: x.m.c <> '') AS found FROM h),
c AS (SELECT *, list_sort(list_transform(found, lambda x: [length(x.m.b), x.k]))[1] AS first FROM f),
p AS (SELECT id, t, {squeeze('t')} <> '' AS filled, reminds, opener_label, [{labels}][first[2] + 1] AS closer_label, greatest(length(t) - {splitter.TAIL}, 0) + first[1] AS before FROM c),
s AS (SELECT id, filled AND reminds AS is_reminder, CASE WHEN filled THEN nullif({squeeze('substr(t, 1, before)')}, '') END AS context,
  CASE WHEN filled THEN nullif(CASE WHEN before IS NOT NULL THEN {squeeze('substr(t, before + 1)')} WHEN opener_label IS NOT NULL THEN {squeeze('t')} END, '') END AS request,
  CASE WHEN filled THEN opener_label END AS opener_label, CASE WHEN filled THEN closer_label END AS closer_label FROM p)"""


@query(_split_sql() + " SELECT id, is_reminder, context, request, opener_label, closer_label FROM s")
def split_texts(t):
    s = splitter.split_text(F.col("texte_question")).alias("s")
    return _texts(t).select("id", s).select("id", "s.*")


def _texts(t) -> DataFrame:
    """Each question's text once, told by its hash and length, so that no text is moved twice; a table of few splits is dealt to all cores."""
    q = spread(t("parsed_questions").select("id", "texte_question"), "id")
    return q.groupBy("id", F.xxhash64("texte_question").alias("h"), F.length("texte_question").alias("n")).agg(F.first("texte_question").alias("texte_question")).select("id", "texte_question")


@query(
    _split_sql()
    + """ SELECT count(*) AS total, CAST(count_if(is_reminder) AS BIGINT) AS reminders, count(context) AS with_context, count(request) AS with_request, CAST(count_if(context IS NOT NULL AND request IS NOT NULL) AS BIGINT) AS with_both,
round(100 * count_if(context IS NOT NULL AND request IS NOT NULL) / count(*), 1) AS pct_both FROM s"""
)
def text_stats(t):
    s = _texts(t).select(splitter.split_text(F.col("texte_question")).alias("s"))
    has = lambda c: F.col(f"s.{c}").isNotNull()
    pct = lambda c: F.round(100 * F.count_if(c) / F.count("*"), 1)
    return s.agg(
        F.count("*").alias("total"), F.count_if(F.col("s.is_reminder")).alias("reminders"), F.count_if(has("context")).alias("with_context"), F.count_if(has("request")).alias("with_request"),
        F.count_if(has("context") & has("request")).alias("with_both"), pct(has("context") & has("request")).alias("pct_both"),
    )


# pages and records built from the texts


@query(
    "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), ''), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+', ''), '\\n+$', ''), chr(10)) AS shown FROM documents WHERE text IS NOT NULL AND text <> ''".replace(
        "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '')", "replace(text, chr(13), '')"
    )
)
def html_text(t):
    safe = F.replace(F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\r"), F.lit(""))
    html = F.concat(F.lit("<html><head><style>p {}</style><script>var a = '<p>';</script></head><body><p>"), safe, F.lit("</p><!-- fin --></body></html>"))
    shown = F.regexp_replace(F.regexp_replace(pages.page_text(html), r"^\n+", ""), r"\n+$", "")
    return t("documents").where("text is not null and text <> ''").select("doc_id", shown.alias("shown"))


def _trimmed(c: str) -> str:
    return f"nullif(regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '')"


_DAY = """coalesce(CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_strptime({0}, '%Y-%m-%d') END, CASE WHEN regexp_full_match({0}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN try_strptime({0}, '%d/%m/%Y') END)"""


@query(
    f"""WITH q AS (SELECT DISTINCT id, numero_question, legislature, date_publication_jo, ministre_libelle, objet, texte_question, texte_reponse, date_reponse_jo, page_reponse_jo FROM parsed_questions WHERE source = 'AN'),
r AS (SELECT *, {_trimmed('texte_reponse')} AS said, {_trimmed('date_publication_jo')} AS d FROM q)
SELECT id, numero_question, 'QE' AS type, 'AN' AS source, legislature, CASE WHEN texte_reponse IS NULL THEN 'EN_COURS' ELSE 'REPONDU' END AS etat_question, strftime({_DAY.format('d')}, '%Y-%m-%d') AS date_publication_jo,
{_trimmed('ministre_libelle')} AS ministre_libelle, {_trimmed('objet')} AS objet, coalesce({_trimmed('texte_question')}, '') AS texte_question,
CASE WHEN said IS NULL THEN NULL WHEN date_reponse_jo IS NULL THEN id ELSE 'AN-' || strftime(date_reponse_jo, '%Y%m%d') || '-' || substr(sha1(said), 1, 12) END AS reponse_id, said AS texte_reponse,
CASE WHEN texte_reponse IS NOT NULL THEN strftime(date_reponse_jo, '%Y-%m-%d') END AS date_reponse_jo, CASE WHEN said IS NOT NULL THEN coalesce(strftime(date_reponse_jo, '%Y%m%d'), 'QE') END AS no_publication, page_reponse_jo FROM r"""
)
def xml_questions(t):
    """Every question of one source written as the archive's XML and read back, all columns of it."""
    names = ("id", "numero_question", "legislature", "date_publication_jo", "ministre_libelle", "objet", "texte_question", "texte_reponse", "date_reponse_jo", "page_reponse_jo")
    q = spread(t("parsed_questions").where("source = 'AN'").select(*names)).distinct()

    def leaf(tag: str, c) -> object:
        plain = F.coalesce(c.cast("string"), F.lit(""))
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
            plain = F.replace(plain, F.lit(sign), F.lit(name))
        return F.concat(F.lit(f"<{tag}>"), plain, F.lit(f"</{tag}>"))

    def node(tag: str, *inner) -> object:
        return F.concat(F.lit(f"<{tag}>"), *inner, F.lit(f"</{tag}>"))

    reply = node("textesReponse", node("texteReponse", node("infoJO", leaf("dateJO", F.col("date_reponse_jo"))), leaf("texte", F.col("texte_reponse"))))
    element = F.concat(
        F.lit('<question xmlns="urn:q">'),
        node("identifiant", leaf("numero", F.col("numero_question")), leaf("legislature", F.col("legislature"))),
        leaf("type", F.lit("QE")),
        node("indexationAN", leaf("teteAnalyse", F.col("objet"))),
        node("minAttribs", node("minAttrib", node("denomination", leaf("developpe", F.lit("un autre")))), node("minAttrib", node("denomination", leaf("developpe", F.col("ministre_libelle"))))),
        node("textesQuestion", node("texteQuestion", node("infoJO", leaf("dateJO", F.col("date_publication_jo"))), leaf("texte", F.col("texte_question")))),
        F.when(F.col("texte_reponse").isNotNull(), reply).otherwise(""),
        node("cloture", node("infoJO", leaf("pageJO", F.col("page_reponse_jo")))),
        F.lit("</question>"),
    )
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    read = archives.parse_questions(q.select(element.alias("element")))
    return read.withColumns({c: day(c) for c in ("date_publication_jo", "date_reponse_jo")})


_LINE = lambda c: f"regexp_replace(coalesce({c}, ''), '[\\n]', ' ', 'g')"


@query(
    f"""WITH q AS (SELECT DISTINCT id, numero_question, legislature, titre_senat, ministre_libelle, texte_question, texte_reponse, date_reponse_jo FROM parsed_questions WHERE source = 'SENAT'),
r AS (SELECT *, texte_reponse IS NOT NULL AND date_reponse_jo IS NOT NULL AS replied, {_trimmed('texte_question')} AS asked, concat_ws(' ', titre_senat, ministre_libelle, texte_question) AS shown FROM q),
s AS (SELECT *, CASE WHEN replied OR regexp_matches(shown, '(?i)r[eéÉ]ponse{_SPACE}+publi[eéÉ]e') THEN 'REPONDU' WHEN regexp_matches(shown, '(?i)retir[eéÉ]e|caduque') THEN 'RETIRE' ELSE 'EN_COURS' END AS etat_question FROM r WHERE asked IS NOT NULL)
SELECT id, numero_question, legislature, etat_question, {_trimmed("substr(" + _trimmed(_LINE('titre_senat')) + ", 1, 500)")} AS titre_senat, {_trimmed("substr(" + _trimmed(_LINE('ministre_libelle')) + ", 1, 300)")} AS ministre_libelle,
regexp_replace(asked, '\n{{3,}}', chr(10) || chr(10), 'g') AS texte_question, CASE WHEN etat_question = 'REPONDU' THEN 'SENAT-WS-' || id END AS reponse_id, CASE WHEN etat_question = 'REPONDU' THEN 'SENAT-WS' END AS no_publication,
CASE WHEN replied THEN strftime(date_reponse_jo, '%Y-%m-%d') END AS date_reponse_jo FROM s"""
)
def page_records(t):
    """Every question of the other source shown as a web page and read back."""
    q = spread(t("parsed_questions").where("source = 'SENAT'").select("id", "titre_senat", "ministre_libelle", "texte_question", "texte_reponse", "date_reponse_jo")).distinct()

    def safe(c) -> object:
        out = F.coalesce(c, F.lit(""))
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("é", "&eacute;"), ("’", "&#8217;"), ("è", "&#xe8;")):
            out = F.replace(out, F.lit(sign), F.lit(name))
        return out

    line = lambda c: safe(F.replace(F.col(c), F.lit("\n"), F.lit(" ")))
    replied = F.col("texte_reponse").isNotNull() & F.col("date_reponse_jo").isNotNull()
    page = F.concat(
        F.lit("<html><head><title>q</title><style>p {}</style><script>var a = '<p>';</script></head><body><p>Titre : "), line("titre_senat"), F.lit("</p>"),
        F.when(text.is_blank(F.col("ministre_libelle")), "").otherwise(F.concat(F.lit("<p>Ministère attributaire : "), line("ministre_libelle"), F.lit("</p>"))),
        F.when(replied, F.concat(F.lit("<p>Réponse publiée au JO le "), F.date_format("date_reponse_jo", "dd/MM/yyyy"), F.lit("</p>"))).otherwise(""),
        F.lit("<p>Texte de la question :</p>\n<p>"), safe(F.col("texte_question")), F.lit("</p></body></html>"),
    )
    read = pages.parse_pages(q.select("id", page.alias("page")), "id", "page")
    return read.select(
        "id", "numero_question", "legislature", "etat_question", "titre_senat", "ministre_libelle", "texte_question", "reponse_id", "no_publication", F.date_format("date_reponse_jo", "yyyy-MM-dd").alias("date_reponse_jo")
    )


# groups, duplicates, merges


@query(
    """WITH q AS (SELECT DISTINCT id, reponse_id FROM parsed_questions WHERE reponse_id IS NOT NULL), r AS (SELECT DISTINCT id AS reponse_id, source, date_reponse_jo FROM reponses)
SELECT reponse_id, source, strftime(date_reponse_jo, '%Y-%m-%d') AS day, count(*) AS n_questions, string_agg(id, ',' ORDER BY id) AS question_ids FROM q JOIN r USING (reponse_id) GROUP BY ALL HAVING count(*) >= 2"""
)
def groups_together(t):
    g = groups.answered_together(t("parsed_questions"), t("reponses"))
    return g.select("reponse_id", "source", F.date_format("date_reponse_jo", "yyyy-MM-dd").alias("day"), "n_questions", F.array_join("question_ids", ",").alias("question_ids"))


@query("SELECT reponse_id, id, count(*) OVER (PARTITION BY reponse_id) AS n_questions FROM (SELECT DISTINCT id, reponse_id FROM parsed_questions WHERE reponse_id IS NOT NULL) QUALIFY n_questions >= 2")
def members_together(t):
    return groups.members_together(t("parsed_questions"))


@query(
    "SELECT reponse_id, id, count(*) OVER (PARTITION BY reponse_id) AS n FROM (SELECT DISTINCT id, reponse_id FROM parsed_questions WHERE reponse_id IS NOT NULL AND id IN (SELECT question_id FROM question_bureau_extract)) QUALIFY n >= 2"
)
def restricted_groups(t):
    q = t("parsed_questions").select("id", "reponse_id").where("reponse_id is not null").distinct()
    return groups.restrict(q, t("question_bureau_extract").select(F.col("question_id").alias("id")), "reponse_id", "id").select("reponse_id", "id", "n")


@query()
def embedded_texts(t):
    """The local stand-in of the embedding service over every question's text."""
    return plugins.embed(_texts(t), "id", "texte_question", plugins.HashEmbedder)


# the stand-in reranker: the share of the query's words in a candidate's text
_GAP = _SPACE[:-1] + "\\x{1C}-\\x{1F}]"


def _parts(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[^{_GAP[1:]}+'))"


def _reranked_sql(pool: int, kept: str) -> str:
    return (
        _POINTS
        + f""", t AS MATERIALIZED (SELECT id, v, payload->>'$.texte_preview' AS txt, qid FROM m),
s AS (SELECT q.id AS query_id, c.id AS id, list_cosine_similarity(q.v, c.v) AS score FROM t q JOIN t c ON q.id <> c.id WHERE CAST(regexp_extract(q.qid, '(\\d+)$', 1) AS BIGINT) % 20 = 0 AND {kept}),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS k FROM s) WHERE k <= {pool}),
w AS (SELECT query_id, n.id, {_parts('q.txt')} AS a, {_parts("coalesce(c.txt, '')")} AS b FROM n JOIN t q ON q.id = query_id JOIN t c ON c.id = n.id),
z AS (SELECT query_id, id, len(list_intersect(a, b)) / greatest(len(a), 1) AS score FROM w),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z)"""
    )


@query(_reranked_sql(10, "true") + " SELECT query_id, id, round(score, 6) AS score, rank FROM x WHERE id IN (SELECT id FROM t WHERE txt IS NOT NULL)")
def reranked(t):
    """The nearest points of the query set, in the order that the local stand-in of the reranker gives their previews."""
    p = _points(t)
    near = knn.nearest(p, p.where(_number("payload") % 20 == 0), "id", "vector", k=10)
    shown = p.select("id", F.get_json_object("payload", "$.texte_preview").alias("text")).where("text is not null")
    asked = shown.select(F.col("id").alias("query_id"), F.col("text").alias("query"))
    scores = plugins.rerank_groups(near.select("query_id", "id").join(shown, "id").join(asked, "query_id"), plugins.OverlapReranker)
    return knn.rerank(near, scores).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_reranked_sql(20, "q.txt <> '' AND q.txt IS NOT NULL AND score >= 0.1").replace("AND score >= 0.1", "AND list_cosine_similarity(q.v, c.v) >= 0.1") + " SELECT query_id, id, round(score, 6) AS score, rank FROM x WHERE rank <= 5")
def similar_items(t):
    """The request as one plan: stored vectors, filtered search, a pool of candidates, reranking by text, the best five."""
    p = _points(t)
    asked = p.where(_number("payload") % 20 == 0).select("id", "vector", F.get_json_object("payload", "$.texte_preview").alias("text"))
    found = similar.similar_items(asked, p, plugins.OverlapReranker, 5, text_field="texte_preview", least=0.1)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    f"""WITH q AS (SELECT id, source, max(texte_question) AS x FROM parsed_questions GROUP BY ALL), b AS (SELECT *, x IS NULL OR regexp_replace(x, '{_SPACE}+', '', 'g') = '' AS blank FROM q),
a AS (SELECT * FROM b WHERE source = 'AN')
SELECT (SELECT count(*) FROM a) AS total, (SELECT count(*) FROM a WHERE NOT blank AND rtrim(x, '.') <> x) AS embed, (SELECT count(*) FROM a WHERE NOT blank AND rtrim(x, '.') = x) AS skip,
(SELECT count(*) FROM a WHERE blank) AS blank, 0::BIGINT AS blocked, (SELECT count(*) FROM b WHERE source <> 'AN' AND NOT (x IS NULL OR regexp_replace(rtrim(x, '.'), '{_SPACE}+', '', 'g') = '')) AS deleted"""
)
def embed_run(t):
    """A collection is filled with the texts without their closing points, then brought up to date with the texts of one source."""
    texts = t("parsed_questions").groupBy("id", "source").agg(F.max("texte_question").alias("text"))
    held = Collection(texts.sparkSession, _folder(texts), "questions_opendata")
    similar.embed_run(texts.withColumn("text", F.regexp_replace("text", r"\.+$", "")), held, plugins.HashEmbedder, "maquette-64")
    return similar.embed_run(texts.where("source = 'AN'"), held, plugins.HashEmbedder, "maquette-64", payload={"source": F.col("source")})


@query("WITH q AS (SELECT DISTINCT id, reponse_id FROM parsed_questions WHERE reponse_id IS NOT NULL), g AS (SELECT reponse_id, count(*) AS size FROM q GROUP BY ALL) SELECT size, count(*) AS n FROM g GROUP BY size")
def group_size_histogram(t):
    q = t("parsed_questions").select("id", "reponse_id").where("reponse_id is not null").distinct()
    return q.groupBy("reponse_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


_CANON = """WITH r AS (SELECT DISTINCT id, texte_reponse AS x FROM reponses WHERE texte_reponse IS NOT NULL AND texte_reponse <> ''), h AS (SELECT x, min(id) AS canonical, count(*) AS n FROM r GROUP BY x HAVING count(*) > 1), m AS (SELECT r.id AS old, canonical FROM r JOIN h USING (x) WHERE r.id <> canonical)"""


def _canon(t) -> DataFrame:
    return merge.canonical_map(t("reponses").select("id", "texte_reponse").distinct(), "id", "texte_reponse")


@query(_CANON + " SELECT old, canonical FROM m")
def dedup_map(t):
    return _canon(t)


@query(_CANON + ", q AS (SELECT DISTINCT id, reponse_id FROM parsed_questions) SELECT q.id, coalesce(m.canonical, q.reponse_id) AS reponse_id FROM q LEFT JOIN m ON m.old = q.reponse_id")
def dedup_apply(t):
    return merge.apply_map(t("parsed_questions").select("id", "reponse_id").distinct(), "reponse_id", _canon(t), "old", "canonical")


@query(_CANON + " SELECT DISTINCT id, source FROM reponses WHERE id NOT IN (SELECT old FROM m)")
def dedup_kept(t):
    """The replies that stay once all that refers to a repeated one refers to its first."""
    return merge.without(t("reponses").select("id", "source").distinct(), "id", _canon(t), "old")


@query(_CANON + " SELECT (SELECT count(*) FROM r) AS replies, (SELECT count(*) FROM h) AS text_groups, CAST((SELECT coalesce(sum(n), 0) FROM h) AS BIGINT) AS grouped, (SELECT count(*) FROM m) AS removable")
def dedup_stats(t):
    r = t("reponses").select("id", "texte_reponse").distinct().where("texte_reponse is not null and texte_reponse <> ''")
    g = r.groupBy("texte_reponse").agg(F.count("*").alias("n"))
    many = F.when(F.col("n") > 1, F.col("n"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("replies"), F.count(many).alias("text_groups"), F.coalesce(F.sum(many), F.lit(0)).alias("grouped"), F.coalesce(F.sum(many - 1), F.lit(0)).alias("removable"))


_MERGED = ("etat_question", "sorquecod", "ministre_libelle", "titre", "page_jo")


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (snapshot_no > 3)::INT, snapshot_no, loaded_at NULLS FIRST, etat_question NULLS FIRST, sorquecod NULLS FIRST, ministre_libelle NULLS FIRST, titre NULLS FIRST, page_jo NULLS FIRST) AS k,
snapshot_no > 3 AS fresh FROM question_snapshots),
e AS (SELECT id, max(k) AS k FROM o WHERE NOT fresh GROUP BY id), u AS (SELECT o.* FROM o LEFT JOIN e USING (id) WHERE o.fresh OR o.k = e.k)
SELECT id, arg_min(legislature, k) FILTER (legislature IS NOT NULL) AS legislature, CASE WHEN bool_or(etat_question = 'REPONDU') THEN 'REPONDU' ELSE arg_max_null(etat_question, k) END AS etat_question,
arg_min(page_jo, k) FILTER (page_jo IS NOT NULL) AS page_jo, coalesce(arg_min(titre, k) FILTER (titre <> ''), arg_max_null(titre, k)) AS titre,
arg_max(ministre_libelle, k) FILTER (ministre_libelle IS NOT NULL) AS ministre_libelle, CASE WHEN bool_and(fresh) THEN 'inserted' WHEN bool_or(fresh) THEN 'updated' ELSE 'kept' END AS written FROM u GROUP BY id"""
)
def merge_upsert(t):
    s = t("question_snapshots").select("id", "legislature", *_MERGED, "snapshot_no", "loaded_at")
    order = ["snapshot_no", "loaded_at", *[f"o_{c}" for c in _MERGED]]
    s = s.withColumns({f"o_{c}": F.col(c) for c in _MERGED})
    last = s.where("snapshot_no <= 3").groupBy("id").agg(F.max_by(F.struct("legislature", "etat_question", "page_jo", "titre", "ministre_libelle"), F.struct(*order)).alias("r"))
    policy = {"legislature": Policy.FIRST, "etat_question": Policy.SETTLED, "page_jo": Policy.FIRST, "titre": Policy.FIRST_FILLED, "ministre_libelle": Policy.LAST}
    return merge.merge(last.select("id", "r.*"), s.where("snapshot_no > 3"), "id", policy, order)


@query(
    """WITH n AS (SELECT DISTINCT id, source, legislature, etat_question, date_publication_jo, page_jo, texte_question, objet, reponse_id, auteur_prenom, auteur_grp_pol, auteur_circonscription, titre_senat, array_to_string(themes, '|') AS themes, auteur_nom FROM parsed_questions)
SELECT id, CASE WHEN source = 'AN' AND legislature = 16 OR etat_question = 'REPONDU' THEN 'REPONDU' ELSE etat_question END AS etat_question,
CASE WHEN source = 'AN' THEN coalesce('held', date_publication_jo) ELSE date_publication_jo END AS date_publication_jo, page_jo, CASE WHEN source = 'AN' AND legislature <> 16 THEN 'held' ELSE texte_question END AS texte_question,
CASE WHEN source = 'AN' THEN coalesce(objet, 'held') ELSE objet END AS objet, CASE WHEN source = 'AN' AND legislature = 15 THEN 'held' ELSE reponse_id END AS reponse_id, CASE WHEN source = 'AN' THEN 'held' ELSE auteur_prenom END AS auteur_prenom,
auteur_grp_pol, auteur_circonscription, titre_senat, themes, CASE WHEN source = 'AN' THEN NULL ELSE auteur_nom END AS auteur_nom, CASE WHEN source = 'AN' THEN 'updated' ELSE 'inserted' END AS written FROM n"""
)
def question_merge(t):
    """Every policy of a question's columns: rows of one source are held, with some columns filled and others not, and all rows are delivered."""
    names = [*merge.QUESTION_POLICY, "auteur_nom"]
    new = t("parsed_questions").select("id", "source", "legislature", *names, "ingested_at")
    held = {
        "etat_question": F.when(F.col("legislature") == 16, "REPONDU").otherwise("EN_COURS"), "date_publication_jo": F.lit("held"), "texte_question": F.when(F.col("legislature") == 16, "").otherwise("held"), "objet": F.lit("held"),
        "reponse_id": F.when(F.col("legislature") == 15, "held"), "auteur_prenom": F.lit("held"),
    }
    kinds = dict(new.dtypes)
    old = new.where("source = 'AN'").select("id", "legislature").distinct().select("id", *[held.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names])
    merged = merge.merge(old, new, "id", merge.QUESTION_POLICY, ["ingested_at", "page_jo"])
    return merged.withColumn("themes", F.array_join("themes", "|"))


@query("SELECT DISTINCT id FROM parsed_questions WHERE texte_reponse IS NULL AND texte_question IS NOT NULL")
def work_left(t):
    """The questions that a run over what isn't analysed yet takes, where those with a reply are."""
    from corvane.sources.fetch import chosen

    q = t("parsed_questions").select("id", "texte_question", "date_publication_jo", F.when(F.col("texte_reponse").isNotNull(), F.col("ingested_at")).alias("analyzed_at"))
    return chosen(q, backfill=True).select("id").distinct()


@query(
    _POINTS
    + """, d AS (SELECT question_id AS qid, min(r.id) AS unit FROM question_bureau_extract e JOIN directions r ON r.nom = e.direction_txt GROUP BY question_id),
a AS (SELECT m.id, m.v, m.qid, coalesce(d.unit, CAST(m.payload->>'$.legislature' AS INTEGER)) AS unit FROM m LEFT JOIN d USING (qid)),
s AS (SELECT q.id AS query_id, c.id AS id, list_cosine_similarity(q.v, c.v) AS score FROM a q JOIN a c ON q.id <> c.id WHERE CAST(regexp_extract(q.qid, '(\\d+)$', 1) AS BIGINT) % 20 = 0 AND (q.unit IS NULL OR c.unit = q.unit))
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS k FROM s) WHERE k <= 5"""
)
def effective_unit_topk(t):
    """The nearest points among those of the same unit: the direction a step names, else the legislature; a query without either takes all."""
    units = t("directions").select(F.col("id").alias("unit"), F.col("nom").alias("direction_txt"))
    named = t("question_bureau_extract").join(units, "direction_txt").groupBy(F.col("question_id").alias("qid")).agg(F.min("unit").alias("unit"))
    p = _points(t).select("id", "vector", _qid(), F.get_json_object("payload", "$.legislature").cast("int").alias("leg"), _number("payload").alias("number"))
    p = p.join(named, "qid", "left").withColumn("klass", F.coalesce("unit", "leg"))
    return knn.nearest(p, p.where("number % 20 = 0"), "id", "vector", k=5, same=True).select("query_id", "id", F.round("score", 6).alias("score"))


@query(
    """WITH n AS (SELECT DISTINCT ministre_libelle AS l FROM parsed_questions WHERE ministre_libelle IS NOT NULL AND ministre_libelle NOT IN (SELECT titre_jo FROM ministeres WHERE titre_jo IS NOT NULL))
SELECT id, titre_jo FROM ministeres UNION ALL SELECT CAST((SELECT max(id) FROM ministeres) + row_number() OVER (ORDER BY l) AS INTEGER), l FROM n"""
)
def ref_get_or_create(t):
    known = t("ministeres").select("id", "titre_jo")
    return merge.get_or_create(known, t("parsed_questions").select(F.col("ministre_libelle").alias("titre_jo")), "titre_jo")


@query("SELECT arg_min(id, ingested_at) IS NOT NULL AS some, id, strftime(min(ingested_at), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS deliveries FROM reponses GROUP BY id")
def deliveries_per_reply(t):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return t("reponses").groupBy("id").agg(at(F.min("ingested_at")).alias("first_seen"), at(F.max("ingested_at")).alias("last_seen"), F.count("*").alias("deliveries")).withColumn("some", F.lit(True))


# counts


@query(
    "SELECT 'parsed_questions' AS name, count(*) AS n FROM parsed_questions UNION ALL SELECT 'reponses', count(*) FROM reponses UNION ALL SELECT 'ministeres', count(*) FROM ministeres UNION ALL SELECT 'directions', count(*) FROM directions UNION ALL SELECT 'bureaux', count(*) FROM bureaux"
)
def table_counts(t):
    from functools import reduce

    return reduce(DataFrame.unionAll, [t(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("parsed_questions", "reponses", "ministeres", "directions", "bureaux")])


@query("SELECT etat_question, count(*) AS n FROM parsed_questions GROUP BY ALL")
def state_breakdown(t):
    return t("parsed_questions").groupBy("etat_question").agg(F.count("*").alias("n"))


@query("SELECT source, legislature, count(*) AS n FROM parsed_questions GROUP BY ALL")
def source_breakdown(t):
    return t("parsed_questions").groupBy("source", "legislature").agg(F.count("*").alias("n"))


@query("SELECT ministre_libelle, count(*) AS n FROM parsed_questions GROUP BY ALL ORDER BY n DESC, ministre_libelle NULLS FIRST LIMIT 15")
def top_ministries(t):
    return t("parsed_questions").groupBy("ministre_libelle").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("ministre_libelle")).limit(15)


@query("SELECT legislature, etat_question, count(*) AS n FROM (SELECT DISTINCT id, legislature, etat_question FROM parsed_questions) GROUP BY ALL")
def dry_run_breakdown(t):
    return t("parsed_questions").select("id", "legislature", "etat_question").distinct().groupBy("legislature", "etat_question").agg(F.count("*").alias("n"))


@query("SELECT direction_txt, count(DISTINCT question_id) AS n FROM question_bureau_extract GROUP BY ALL")
def coverage_per_direction(t):
    return t("question_bureau_extract").select("direction_txt", "question_id").distinct().groupBy("direction_txt").agg(F.count("question_id").alias("n"))


@query("SELECT question_id, string_agg(DISTINCT direction_txt, '|' ORDER BY direction_txt) AS directions FROM question_bureau_extract WHERE direction_txt IS NOT NULL GROUP BY question_id")
def truth_sets(t):
    return t("question_bureau_extract").where("direction_txt is not null").groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("direction_txt")), "|").alias("directions"))


@query(
    "SELECT count(*) AS steps, CAST(count_if(bureau IS NULL) AS BIGINT) AS no_office, CAST(count_if(direction_txt NOT IN (SELECT nom FROM directions)) AS BIGINT) AS unknown_direction FROM (SELECT DISTINCT * FROM question_bureau_extract)"
)
def rejection_counters(t):
    known = t("directions").select(F.col("nom").alias("direction_txt"), F.lit(True).alias("known"))
    e = t("question_bureau_extract").distinct().join(known, "direction_txt", "left")
    return e.agg(F.count("*").alias("steps"), F.count_if(F.col("bureau").isNull()).alias("no_office"), F.count_if(F.col("direction_txt").isNotNull() & F.col("known").isNull()).alias("unknown_direction"))


# joins, sets, orders


@query("SELECT DISTINCT q.id, strftime(r.date_reponse_jo, '%Y-%m-%d') AS answered FROM parsed_questions q LEFT JOIN reponses r ON r.id = q.reponse_id")
def left_reply_dates(t):
    r = t("reponses").select(F.col("id").alias("reponse_id"), F.col("date_reponse_jo").alias("d")).distinct()
    return t("parsed_questions").select("id", "reponse_id").distinct().join(r, "reponse_id", "left").select("id", F.date_format("d", "yyyy-MM-dd").alias("answered")).distinct()


@query("SELECT DISTINCT r.id FROM reponses r WHERE EXISTS (SELECT 1 FROM parsed_questions q WHERE q.reponse_id = r.id AND q.legislature = 17)")
def replies_of_legislature(t):
    q = t("parsed_questions").where("legislature = 17").select(F.col("reponse_id").alias("id"))
    return t("reponses").join(q, "id", "left_semi").select("id").distinct()


@query("SELECT DISTINCT q.id FROM parsed_questions q WHERE NOT EXISTS (SELECT 1 FROM question_bureau_extract e WHERE e.question_id = q.id)")
def questions_without_office(t):
    e = t("question_bureau_extract").select(F.col("question_id").alias("id"))
    return t("parsed_questions").join(e, "id", "left_anti").select("id").distinct()


@query("SELECT b.id, b.nom AS bureau, d.nom AS direction FROM bureaux b LEFT JOIN directions d ON d.id = b.direction_id")
def office_star(t):
    d = t("directions").select(F.col("id").alias("direction_id"), F.col("nom").alias("direction"))
    return t("bureaux").select("id", F.col("nom").alias("bureau"), "direction_id").join(d, "direction_id", "left").drop("direction_id")


@query("SELECT DISTINCT e.id, d.id AS direction_id FROM question_bureau_extract e JOIN directions d ON d.nom = e.direction_txt")
def direction_lookup(t):
    d = t("directions").select(F.col("id").alias("direction_id"), F.col("nom").alias("direction_txt"))
    return t("question_bureau_extract").select("id", "direction_txt").join(d, "direction_txt").select("id", "direction_id").distinct()


_KEY = "upper(replace(nullif(regexp_extract({0}, '^\\s*\\[([^\\]]+)\\]', 1), ''), ' ', ''))"


@query(
    f"""WITH h AS (SELECT DISTINCT e.question_id, b.id, b.nom, d.nom AS direction_label FROM question_bureau_extract e JOIN directions d ON d.nom = e.direction_txt JOIN bureaux b ON b.direction_id = d.id AND {_KEY.format('b.nom')} = {_KEY.format('e.bureau')} WHERE question_id IS NOT NULL),
e AS (SELECT DISTINCT id, question_id, direction_txt, sous_direction, bureau, coalesce(bureau_full, bureau) AS b, date_debut_etape, {_TYPED} AS k FROM question_bureau_extract WHERE trim(sous_direction) <> '' AND question_id NOT IN (SELECT question_id FROM h)),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY date_debut_etape DESC NULLS LAST, id, direction_txt) AS n FROM e)
SELECT question_id, {_KEY.format('nom')} AS bureau_key, direction_label, 'attribution' AS source FROM h UNION ALL SELECT question_id, k, direction_txt, 'extract' FROM o WHERE n = 1 AND question_id IS NOT NULL"""
)
def extracted_attributions(t):
    """Offices that a step names by their code count as given by hand; steps of other questions as extracted."""
    e = t("question_bureau_extract").where("question_id is not null").distinct()
    known = t("bureaux").select(F.col("id").alias("bureau_reel_id"), labels.bracket_key(F.col("nom")).alias("key"), "direction_id")
    units = t("directions").select(F.col("id").alias("direction_id"), F.col("nom").alias("direction_txt"))
    named = e.select("question_id", "direction_txt", labels.bracket_key(F.col("bureau")).alias("key")).where("key is not null")
    human = named.join(units, "direction_txt").join(known, ["direction_id", "key"]).select("question_id", "bureau_reel_id").distinct()
    return groups.attributions(human, t("bureaux"), t("directions"), e).select("question_id", "bureau_key", "direction_label", "source")


@query(
    """WITH h AS (SELECT DISTINCT question_id, direction_txt AS d, 'human' AS origin FROM question_bureau_extract WHERE source_etape_id % 2 = 0), x AS (SELECT question_id, min(direction_txt) AS d, 'extract' AS origin FROM question_bureau_extract GROUP BY question_id),
g AS (SELECT question_id, min(d) AS d, 'human' AS origin FROM h GROUP BY question_id) SELECT * FROM g UNION ALL SELECT * FROM x WHERE question_id NOT IN (SELECT question_id FROM g WHERE question_id IS NOT NULL)"""
)
def human_precedence(t):
    e = t("question_bureau_extract").where("question_id is not null")
    human = e.where("source_etape_id % 2 = 0").groupBy("question_id").agg(F.min("direction_txt").alias("d")).withColumn("origin", F.lit("human"))
    other = e.groupBy("question_id").agg(F.min("direction_txt").alias("d")).withColumn("origin", F.lit("extract"))
    return groups.human_first(human, other, "question_id")


@query("SELECT id, source FROM (SELECT id, 'question' AS source FROM parsed_questions UNION SELECT id, 'reply' FROM reponses)")
def union_distinct(t):
    return t("parsed_questions").select("id", F.lit("question").alias("source")).union(t("reponses").select("id", F.lit("reply").alias("source"))).distinct()


@query(
    """SELECT question_id, direction_txt, source_etape_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id, direction_txt ORDER BY date_debut_etape DESC NULLS LAST, source_etape_id DESC NULLS LAST) AS n FROM question_bureau_extract) WHERE n = 1"""
)
def latest_step(t):
    e = t("question_bureau_extract")
    return merge.first_per_key(e, ["question_id", "direction_txt"], [F.desc_nulls_last("date_debut_etape"), F.desc_nulls_last("source_etape_id")]).select("question_id", "direction_txt", "source_etape_id")


@query("SELECT DISTINCT id FROM parsed_questions WHERE ministre_libelle ILIKE '%agriculture%' AND date_reponse_jo BETWEEN DATE '2015-01-01' AND DATE '2022-12-31' AND source IN ('AN', 'SENAT') AND id LIKE 'AN-%' AND regexp_matches(id, '-QE-[0-9]+$')")
def filters(t):
    q = t("parsed_questions")
    return q.where(
        F.col("ministre_libelle").ilike("%agriculture%") & F.col("date_reponse_jo").between("2015-01-01", "2022-12-31") & F.col("source").isin("AN", "SENAT") & F.col("id").startswith("AN-") & F.col("id").rlike("-QE-[0-9]+$")
    ).select("id").distinct()


@query("SELECT reponse_id FROM (SELECT DISTINCT id, reponse_id FROM parsed_questions WHERE reponse_id IS NOT NULL) GROUP BY ALL HAVING bool_and(id LIKE 'AN-%')")
def groups_all_prefix(t):
    q = t("parsed_questions").where("reponse_id is not null")
    return q.groupBy("reponse_id").agg(F.bool_and(F.col("id").startswith("AN-")).alias("ok")).where("ok").select("reponse_id")


@query("SELECT doc_id, strftime(published_on, '%Y-%m-%d') AS day FROM documents ORDER BY published_on DESC NULLS LAST, doc_id LIMIT 20")
def latest_documents(t):
    return t("documents").orderBy(F.desc_nulls_last("published_on"), "doc_id").limit(20).select("doc_id", F.date_format("published_on", "yyyy-MM-dd").alias("day"))


@query("SELECT doc_id FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 100")
def sample_seeded(t):
    return evaluate.seeded_sample(t("documents"), "doc_id", 100, 42).select("doc_id")


@query(
    f"""WITH c AS (SELECT DISTINCT id, string_split(themes_raw, '#') AS parts FROM tam_questions WHERE themes_raw IS NOT NULL), u AS (SELECT id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM c)
SELECT u.id, string_agg(thelib, '|' ORDER BY pos) AS themes FROM u JOIN the_themes th ON CAST(th.thecle AS VARCHAR) = regexp_replace(part, '^{_SPACE}+|{_SPACE}+$', '', 'g') GROUP BY u.id"""
)
def theme_resolve(t):
    from corvane.sources.dump import theme_labels

    raw = t("tam_questions").select("id", "themes_raw").distinct()
    return theme_labels(raw, "id", "themes_raw", t("the_themes")).select("id", F.array_join("themes", "|").alias("themes"))


# expressions over whole tables


@query(
    f"""SELECT DISTINCT id, strftime(CASE WHEN regexp_full_match(substr({_trimmed('datejodepot')}, 1, 10), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_strptime(substr({_trimmed('datejodepot')}, 1, 10), '%Y-%m-%d') END, '%Y-%m-%d') AS stamped,
strftime(try_strptime(regexp_extract(datejodepot, '(\\d{{2}}/\\d{{2}}/\\d{{4}})', 1), '%d/%m/%Y'), '%Y-%m-%d') AS found, length(regexp_replace(txtque, '\\\\[rnt]', ' ', 'g')) AS chars FROM tam_questions"""
)
def stamps(t):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    d = F.col("datejodepot")
    return t("tam_questions").select("id", day(dates.stamp_day(d)).alias("stamped"), day(dates.find_day(d)).alias("found"), F.length(text.unescape(F.col("txtque"))).cast("bigint").alias("chars")).distinct()


_NAME = "^([A-ZÀ-Ú][a-zà-ú\\-]+)\\s+([A-ZÀ-Ú\\-]+)$"


@query(
    f"""WITH a AS (SELECT DISTINCT id, trim(coalesce(prenom, '') || ' ' || upper(coalesce(nom, ''))) AS w, 'Réponse au Lot QE ' || source || ' ' || lpad(CAST(numero_question AS VARCHAR), 7, '0') || '.' AS lot, id AS cell FROM (SELECT id, auteur_prenom AS prenom, auteur_nom AS nom, source, numero_question FROM parsed_questions))
SELECT id, CASE WHEN w = '' THEN NULL WHEN regexp_matches(w, '{_NAME}') THEN regexp_extract(w, '{_NAME}', 2) ELSE w END AS nom, CASE WHEN regexp_matches(w, '{_NAME}') THEN regexp_extract(w, '{_NAME}', 1) END AS prenom,
'LOT-' || split_part(id, '-', 1) || '-' || CAST(CAST(split_part(id, '-', 4) AS INTEGER) AS VARCHAR) AS lot, regexp_extract(cell, '(\\d{{1,7}})$', 1) AS digits, split_part(id, '-', 1) AS source FROM a"""
)
def labels_read(t):
    """Authors, lot markers, numbers and sources read out of texts made from each question's fields."""
    q = t("parsed_questions").select("id", "auteur_prenom", "auteur_nom", "source", "numero_question").distinct()
    whole = F.nullif(F.trim(F.concat(F.coalesce("auteur_prenom", F.lit("")), F.lit(" "), F.upper(F.coalesce("auteur_nom", F.lit(""))))), F.lit(""))
    author = labels.author_parts(whole)
    marker = F.concat(F.lit("Réponse au Lot QE "), "source", F.lit(" "), F.lpad(F.col("numero_question").cast("string"), 7, "0"), F.lit("."))
    return q.select("id", author["nom"].alias("nom"), author["prenom"].alias("prenom"), labels.lot_of(marker).alias("lot"), labels.digits_of(F.col("id")).alias("digits"), labels.source_of(F.col("id")).alias("source")).distinct()


@query(f"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)r[eéÉ]ponse{_SPACE}+publi[eéÉ]e') THEN 'REPONDU' WHEN regexp_matches(text, '(?i)retir[eéÉ]e|caduque') THEN 'RETIRE' ELSE 'EN_COURS' END AS state FROM documents")
def page_states(t):
    return t("documents").select("doc_id", labels.state_of_page(F.col("text")).alias("state"))


@query("SELECT DISTINCT id, texte_question AS body FROM parsed_questions WHERE texte_question IS NOT NULL")
def without_headings(t):
    """Each text printed with its number and date, and read without them."""
    from corvane.sources.fetch import without_heading

    q = t("parsed_questions").where("texte_question is not null").select("id", "numero_question", "texte_question").distinct()
    printed = F.concat(F.col("numero_question").cast("string"), F.lit(". — 10 mars 2026. — "), F.col("texte_question"))
    return q.select("id", without_heading(printed).alias("body"))


_UUID = "regexp_replace(substr(sha256({0}), 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


@query(f"SELECT raw_id, {_UUID.format('source_file')} AS file_id, {_UUID.format(chr(39).join(['source_file || ', '::', ' || raw_id || ', '::0', '']))} AS chunk_id FROM raw_an_questions WHERE source_file IS NOT NULL")
def path_ids(t):
    r = t("raw_an_questions").where("source_file is not null")
    return r.select("raw_id", ids.path_uuid(F.col("source_file")).alias("file_id"), ids.path_uuid(F.col("source_file"), F.col("raw_id"), F.lit(0)).alias("chunk_id"))


@query(f"SELECT DISTINCT id, nullif(concat_ws(' — ', {_trimmed('sous_direction')}, {_trimmed('coalesce(bureau_full, bureau)')}), '') AS label FROM question_bureau_extract")
def joined_labels(t):
    return t("question_bureau_extract").select("id", labels.joined_label(F.col("sous_direction"), F.coalesce("bureau_full", "bureau")).alias("label")).distinct()


_ACRONYMS = "[" + ", ".join(f"'{d}'" for d in labels.DIRECTIONS) + "]"
_STEPS = f"""WITH e AS (SELECT DISTINCT id, question_id, source_etape_id, date_debut_etape, concat_ws(' - ', {_ACRONYMS}[(id % 18)::INTEGER + 1], sous_direction, bureau, bureau_full) AS post FROM question_bureau_extract),
s AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(post, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+-{_SPACE}+'), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '') AS p FROM e),
k AS (SELECT *, len(p) >= 3 AND list_contains({_ACRONYMS}, p[1]) AS known FROM s)"""


def _steps(t) -> DataFrame:
    """Workflow steps as the source gives them, their posts made from the offices' columns."""
    e = t("question_bureau_extract").select("id", "question_id", "source_etape_id", "date_debut_etape", "sous_direction", "bureau", "bureau_full").distinct()
    known = F.array(*[F.lit(d) for d in labels.DIRECTIONS])
    return e.withColumn("post", F.concat_ws(" - ", F.get(known, (F.col("id") % 18).cast("int")), "sous_direction", "bureau", "bureau_full"))


@query(_STEPS + " SELECT id, CASE WHEN known THEN p[1] END AS direction, CASE WHEN known THEN p[2] END AS sous_direction, CASE WHEN known THEN p[3] END AS bureau, CASE WHEN known THEN array_to_string(p[3:], ' - ') END AS bureau_full FROM k")
def post_parts(t):
    p = labels.post_parts(F.col("post")).alias("p")
    return _steps(t).select("id", p).select("id", "p.direction", "p.sous_direction", "p.bureau", "p.bureau_full")


@query(
    _STEPS
    + """, q AS (SELECT split_part(question_id, '-', 1) || '-' || CASE WHEN date_debut_etape >= DATE '2024-07-18' THEN 17 WHEN date_debut_etape >= DATE '2022-06-22' THEN 16 WHEN date_debut_etape >= DATE '2017-06-21' THEN 15
  WHEN date_debut_etape >= DATE '2012-06-20' THEN 14 ELSE 13 END || '-QE-' || split_part(question_id, '-', 4) AS question_id, p[1] AS direction_txt, p[3] AS bureau, id AS source_etape_id, date_debut_etape AS d
  FROM k WHERE known AND question_id IS NOT NULL AND date_debut_etape IS NOT NULL)
SELECT question_id, direction_txt, arg_max(bureau, {'d': d, 's': source_etape_id}) AS bureau, max({'d': d, 's': source_etape_id}).s AS source_etape_id FROM q GROUP BY question_id, direction_txt"""
)
def office_steps(t):
    """The latest step of each question and direction, from the raw steps."""
    s = _steps(t).select(
        "id", F.split_part("question_id", F.lit("-"), F.lit(1)).alias("parlement"), F.split_part("question_id", F.lit("-"), F.lit(4)).alias("numero_question"), F.col("date_debut_etape").alias("date_jo_question"),
        F.lit("Pour rédaction").alias("type_etape"), F.col("post").alias("poste_etape"), "date_debut_etape",
    )
    return groups.office_steps(s).select("question_id", "direction_txt", "bureau", "source_etape_id")


# incremental work and logs


_PLAN = f"""WITH q AS (SELECT DISTINCT id, texte_question FROM parsed_questions), i AS (SELECT DISTINCT payload->>'$.question_id' AS id, payload->>'$.embedding_model' AS m, payload->>'$.content_hash' AS h FROM vec_questions_opendata),
p AS (SELECT q.id, CASE WHEN texte_question IS NULL OR regexp_replace(texte_question, '{_SPACE}+', '', 'g') = '' THEN 'blank' WHEN m = 'maquette-64' AND h = sha256(texte_question) THEN 'skip' ELSE 'embed' END AS action FROM q LEFT JOIN i USING (id)),
s AS (SELECT i.id AS point_id FROM i WHERE i.id NOT IN (SELECT id FROM parsed_questions WHERE source = 'AN'))"""


def _same(key):
    return key


def _planned(t) -> DataFrame:
    q = t("parsed_questions").select("id", "texte_question").distinct()
    field = lambda k, name: F.get_json_object("payload", f"$.{k}").alias(name)
    known = t("vec_questions_opendata").select(field("question_id", "point_id"), field("embedding_model", "embedding_model"), field("content_hash", "content_hash")).distinct()
    return incremental.plan_embedding(q, known, "id", "texte_question", "maquette-64", _same).select("id", "action")


def _stale(t) -> DataFrame:
    points = t("vec_questions_opendata").select(F.get_json_object("payload", "$.question_id").alias("point_id")).distinct()
    return incremental.stale_points(points, t("parsed_questions").where("source = 'AN'").select("id").distinct(), "id", _same)


@query(_PLAN + " SELECT id, action FROM p")
def incremental_plan(t):
    return _planned(t)


@query(_PLAN + " SELECT point_id FROM s")
def stale_points(t):
    return _stale(t)


@query(
    _PLAN
    + """ SELECT count(*) AS total, CAST(count_if(action = 'embed') AS BIGINT) AS embed, CAST(count_if(action = 'skip') AS BIGINT) AS skip, CAST(count_if(action = 'blank') AS BIGINT) AS blank, (SELECT count(*) FROM s) AS deleted FROM p"""
)
def embed_run_stats(t):
    return incremental.run_stats(_planned(t), _stale(t))


@query(
    _NEAR
    + _MATES
    + """, h AS (SELECT g.query_id, count(r.rank) AS hits FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.id = g.id AND r.rank <= 3 GROUP BY ALL), z AS (SELECT h.query_id, e.label FROM h JOIN e ON e.vec_id = h.query_id WHERE hits = 0),
d AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY query_id) AS turn FROM z ORDER BY turn, query_id LIMIT 5)
SELECT d.query_id, 'missed' AS kind, g.id, round(s.score, 6) AS score FROM d JOIN g USING (query_id) JOIN s ON s.query_id = g.query_id AND s.id = g.id
UNION ALL SELECT d.query_id, 'top', r.id, round(r.score, 6) FROM d JOIN r ON r.query_id = d.query_id AND r.rank <= 3"""
)
def failure_report(t):
    """Five queries without a mate among their three nearest: a row for each mate missed and for each row found instead."""
    e = t("embeddings")
    near = knn.nearest(e, _asked(e), "vec_id", "embedding", k=3).select("query_id", "id", "rank", "score")
    hits, sizes = _mates(e, near)
    found = sizes.join(hits, "query_id", "left_anti")
    label = e.select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    some = evaluate.diverse_failures(found.join(label, "query_id"), "label", "query_id", 5).select("query_id", "label", "q")
    rows = e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    missed = rows.join(F.broadcast(some), "label").where("query_id <> id")  # five queries, each row a row
    missed = missed.select("query_id", F.lit("missed").alias("kind"), "id", F.round(knn.cosine(F.col("q"), F.col("v")), 6).alias("score"))
    return missed.unionAll(near.join(some.select("query_id"), "query_id").select("query_id", F.lit("top").alias("kind"), "id", F.round("score", 6).alias("score")))


@query(
    """WITH q AS (SELECT DISTINCT id, legislature, source FROM parsed_questions), x AS (SELECT DISTINCT question_id AS id FROM question_bureau_extract) SELECT source, count(*) AS n, CAST(count_if(x.id IS NOT NULL) AS BIGINT) AS with_office, round(100 * count_if(x.id IS NOT NULL) / count(*), 1) AS pct FROM q LEFT JOIN x USING (id) GROUP BY source"""
)
def office_coverage(t):
    x = t("question_bureau_extract").select(F.col("question_id").alias("id"), F.lit(True).alias("known")).distinct()
    q = t("parsed_questions").select("id", "source").distinct().join(x, "id", "left")
    return q.groupBy("source").agg(F.count("*").alias("n"), F.count("known").alias("with_office"), F.round(100 * F.count("known") / F.count("*"), 1).alias("pct"))


@query(
    """WITH f AS (SELECT source_file AS path, md5(coalesce(max(payload), '')) AS document_hash FROM raw_an_questions GROUP BY 1), m AS (SELECT path, CASE WHEN length(path) % 2 = 0 THEN document_hash ELSE 'old' END AS document_hash FROM f)
SELECT f.path FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.path = f.path AND m.document_hash = f.document_hash)"""
)
def manifest_skip(t):
    files = t("raw_an_questions").groupBy(F.col("source_file").alias("path")).agg(F.md5(F.coalesce(F.max("payload"), F.lit("")).cast("binary")).alias("document_hash"))
    held = files.select("path", F.when(F.length("path") % 2 == 0, F.col("document_hash")).otherwise("old").alias("document_hash"))
    return incremental.fresh_files(files, held).select("path")


@query(
    """WITH q AS (SELECT source, snapshot_no, id, max(etat_question) AS s FROM question_snapshots WHERE source IS NOT NULL AND snapshot_no IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
d AS (SELECT source, snapshot_no, lag(snapshot_no) OVER (PARTITION BY source ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT source, snapshot_no FROM q))
SELECT b.source, b.snapshot_no, b.id, a.s AS old, b.s AS new FROM q b JOIN d USING (source, snapshot_no) LEFT JOIN q a ON a.source = b.source AND a.id = b.id AND a.snapshot_no = d.before
WHERE d.before IS NOT NULL AND a.s IS DISTINCT FROM b.s"""
)
def state_change_log(t):
    from corvane.streaming.feeds import delivery_changes

    return delivery_changes(t("question_snapshots"), "id", "etat_question")
