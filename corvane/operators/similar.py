"""Requests composed of the engine's operators: similar items of a query set, and runs that keep a collection embedded."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.ids import stable_uuid
from corvane.functions.splitter import split_text
from corvane.operators import incremental, knn
from corvane.operators.collection import Collection, compile_filter
from corvane.plugins import Embedder, Reranker, embed, rerank_groups
from corvane.session import stage, unstage

#: Candidates of a query before reranking: so many times what is asked for, and so many at least.
POOL_TIMES, POOL_LEAST = 3, 20


def retrieve(queries: DataFrame, target: DataFrame, vectors: Sequence[str], pool: int, *, spec: dict | None = None, least: float | None = None) -> DataFrame:
    """``query_id, id, score, query_no, rank``: the candidates of each query, the best of each of its vectors, each candidate once.

    ``queries``: id and a column for each vector, null where a query has fewer; ``target``: id, vector, payload. A candidate that several vectors find counts
    where the first of them found it. A query is never its own candidate.
    """
    if not vectors:
        raise ValueError("a search needs a vector")
    rows = target if spec is None else target.where(compile_filter(spec))
    hits = [
        knn.nearest(rows.select("id", "vector"), queries.select("id", F.col(v).alias("vector")), "id", "vector", k=pool, least=least).withColumn("query_no", F.lit(i))
        for i, v in enumerate(vectors)
    ]
    return knn.first_seen(reduce(DataFrame.unionByName, hits), "query_id")


def similar_items(
    queries: DataFrame, target: DataFrame, make: Callable[[], Reranker], k: int, *, text_field: str, vectors: Sequence[str] = ("vector",), spec: dict | None = None, least: float | None = None
) -> DataFrame:
    """``query_id, id, score, rank`` of the k most similar items of each query, in the reranker's order.

    ``queries``: id, text and vectors. A pool larger than k is found by vector, reranked by the text in the candidates' payload (an absent one is empty), and
    cut to k. Queries without a text have no items.
    """
    if not 1 <= k <= 50:
        raise ValueError("k must be between 1 and 50")
    if least is not None and not 0 <= least <= 1:
        raise ValueError("a threshold lies between 0 and 1")
    asked = queries.where("text is not null and text <> ''")
    found = retrieve(asked, target, vectors, max(POOL_TIMES * k, POOL_LEAST), spec=spec, least=least).select("query_id", "id")
    texts = target.select("id", F.coalesce(F.get_json_object("payload", f"$.{text_field}"), F.lit("")).alias("text"))
    pooled = found.join(texts, "id").join(asked.select(F.col("id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return knn.rerank(found, rerank_groups(pooled, make)).where(F.col("rank") <= k)


def embed_run(
    texts: DataFrame, collection: Collection, make: Callable[[], Embedder], model: str, *, key: str = "id", text: str = "text", current: DataFrame | None = None,
    payload: Mapping[str, Column] | None = None, point: Callable[[Column], Column] = stable_uuid, per_minute: float | None = None, need_one: bool = False,
) -> DataFrame:
    """Brings a collection up to date with texts, and gives one row: ``total, embed, skip, blank, blocked, deleted``.

    Points of keys that ``current`` (all keys there are; the texts' own if none are given) hasn't any more are removed. Texts whose model and content hash
    are unchanged are skipped, the others embedded once, and written behind a check that all vectors have the collection's size, which is the
    first vectors' size where there is no collection yet. Texts the service blocks are counted and left out; with ``need_one`` it is an error if it blocks them all.
    """
    schema = "point_id string, embedding_model string, content_hash string"
    field = lambda name: F.get_json_object("payload", f"$.{name}").alias(name)
    held = collection.points().select(F.col("id").alias("point_id"), field("embedding_model"), field("content_hash")) if collection.exists() else texts.sparkSession.createDataFrame([], schema)
    planned = stage(incremental.plan_embedding(texts, held, key, text, model, point), "plan")
    stale = stage(incremental.stale_points(held, current if current is not None else texts, key, point), "stale")
    wanted = planned.where("action = 'embed'").select(F.col(key).alias("__key"), "point_id", "content_hash")
    rows = texts.join(wanted, F.col(key) == F.col("__key"))
    vectors = stage(embed(rows, key, text, make, per_minute=per_minute), "vectors")  # once: the service is outside
    made = vectors.agg(F.count("*").alias("n"), F.count("vector").alias("made"), F.array_sort(F.collect_set(F.when(F.col("vector").isNotNull(), F.size("vector")))).alias("sizes")).first()
    if need_one and made["n"] and not made["made"]:
        raise ValueError("the service blocked every text")
    size = collection.vector_size()
    if len(made["sizes"]) > 1 or made["sizes"] and size not in (None, made["sizes"][0]):  # before anything is changed
        raise ValueError(f"the collection takes vectors of {size}, the service gave {made['sizes']}")
    body = F.to_json(F.struct(F.lit(model).alias("embedding_model"), "content_hash", F.col(key).cast("string").alias("question_id"), *[c.alias(n) for n, c in (payload or {}).items()]))
    points = rows.select("point_id", key, body.alias("payload")).join(vectors, key).select(F.col("point_id").alias("id"), F.col("vector"), "payload")
    if collection.exists():
        collection.delete_ids(stale.select(F.col("point_id").alias("id")))
    collection.upsert(points)
    stats = incremental.run_stats(planned, stale).withColumn("blocked", F.lit(made["n"] - made["made"])).withColumn("embed", F.col("embed") - F.col("blocked"))
    out = stage(stats.select("total", "embed", "skip", "blank", "blocked", "deleted"), "stats")
    unstage(planned, stale, vectors)
    return out


def analyse(table: DataFrame, text: str, at: datetime | None, key: str = "id") -> DataFrame:
    """The table with what the splitter finds in its texts in ``is_reminder, context, request`` and the time in ``analyzed_at``.

    Without a time it is a dry run: ``key`` and the three findings, and nothing to write.
    """
    found = table.withColumn("__s", split_text(F.col(text)))
    parts = [F.col(f"__s.{c}").alias(c) for c in ("is_reminder", "context", "request")]
    if at is None:
        return found.select(key, *parts)
    kept = [c for c in table.columns if c not in ("is_reminder", "context", "request", "analyzed_at")]
    return found.select(*kept, *parts, F.lit(at).cast("timestamp").alias("analyzed_at"))


def office_upsert(existing: DataFrame, steps: DataFrame, order: Sequence[str] = ("date_debut_etape", "source_etape_id"), truncate: bool = False) -> DataFrame:
    """Offices by question and direction: the latest incoming step of each replaces the row there is; with ``truncate`` nothing else stays."""
    columns = [c for c in steps.columns if c in existing.columns]
    keys = ["question_id", "direction_txt"]
    rest = [c for c in columns if c not in keys]
    last = F.struct(*[F.coalesce(F.col(o).cast("string"), F.lit("")) for o in order], *rest)
    fresh = steps.groupBy(*keys).agg(F.max_by(F.struct(*rest), last).alias("r")).select(*keys, "r.*")
    if truncate:
        return existing.limit(0).unionByName(fresh, allowMissingColumns=True)
    return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)
