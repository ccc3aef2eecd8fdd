"""Content-addressed incremental work: manifests, content hashes, stale points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.ids import content_hash, stable_uuid
from corvane.functions.text import is_blank


def fresh_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (``path, document_hash``) that the manifest doesn't hold with the same hash."""
    return files.join(manifest.select("path", "document_hash"), ["path", "document_hash"], "left_anti")


def under_prefix(manifest: DataFrame, prefix: str) -> DataFrame:
    """The manifest's entries below a path, taken as it stands."""
    return manifest.where(F.col("path").startswith(prefix))


def hashed_files(spark, folder: str, pattern: str = "*") -> DataFrame:
    """``path, document_hash`` of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.sha2("content", 256).alias("document_hash"))


def plan_embedding(texts: DataFrame, indexed: DataFrame, key: str, text: str, model: str, point: Callable[[Column], Column] = stable_uuid) -> DataFrame:
    """``key, point_id, content_hash, action`` of every text: ``embed``, ``skip`` or ``blank``.

    ``indexed``: point_id, embedding_model, content_hash; ``point`` makes a key's point id. A text is skipped where model and hash of the whole text are unchanged.
    """
    rows = texts.select(F.col(key), point(F.col(key).cast("string")).alias("point_id"), content_hash(F.col(text)).alias("content_hash"), is_blank(F.col(text)).alias("__blank"))
    known = indexed.select("point_id", F.col("embedding_model").alias("__model"), F.col("content_hash").alias("__hash"))
    same = (F.col("__model") == model) & (F.col("__hash") == F.col("content_hash"))
    action = F.when(F.col("__blank"), "blank").when(same, "skip").otherwise("embed")
    return rows.join(known, "point_id", "left").select(key, "point_id", "content_hash", action.alias("action"))


def stale_points(indexed: DataFrame, current: DataFrame, key: str, point: Callable[[Column], Column] = stable_uuid) -> DataFrame:
    """Indexed points whose text is gone."""
    return indexed.join(current.select(point(F.col(key).cast("string")).alias("point_id")), "point_id", "left_anti")


def run_stats(planned: DataFrame, stale: DataFrame) -> DataFrame:
    """One row: total, embedded, skipped, blank, deleted."""
    n = lambda a: F.count_if(F.col("action") == a).alias(a)
    counts = planned.agg(F.count("*").alias("total"), n("embed"), n("skip"), n("blank"))
    return counts.crossJoin(stale.agg(F.count("*").alias("deleted")))  # one row beside one row
