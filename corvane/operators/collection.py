"""A vector collection over files: filters, point access, keyed writes.

A point is ``id, vector, payload``, the payload JSON text. Points lie in buckets of their id's hash; a write makes anew only the
buckets it touches, and gives a new version of the collection.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.knn import nearest
from corvane.operators.merge import replace_by_key
from corvane.operators.stores import BucketedFolder
from corvane.session import stage, unstage

SCHEMA = "id string, vector array<float>, payload string"


def _clause(c: dict) -> Column:
    """One clause of a filter: ids, a payload key's value, or any of several, compared as text."""
    if set(c) == {"has_id"}:
        return F.col("id").isin([str(i) for i in c["has_id"]])
    if set(c) == {"key", "match"} and set(c["match"]) in ({"value"}, {"any"}):
        field = F.get_json_object("payload", f"$.{c['key']}")
        if "any" in c["match"]:
            return field.isin([_as_text(v) for v in c["match"]["any"]])
        return field == _as_text(c["match"]["value"])
    raise ValueError(f"unknown filter clause: {c}")


def _as_text(v: object) -> str:
    return ("true" if v else "false") if isinstance(v, bool) else str(v)


def compile_filter(spec: dict | None) -> Column | None:
    """``must`` and ``must_not`` clauses as one condition; None for none. An unknown part is an error."""
    if not spec:
        return None
    if unknown := set(spec) - {"must", "must_not"}:
        raise ValueError(f"unknown filter parts: {sorted(unknown)}")
    parts = [_clause(c) for c in spec.get("must", [])]
    parts += [~F.coalesce(_clause(c), F.lit(False)) for c in spec.get("must_not", [])]
    return reduce(Column.__and__, parts) if parts else None


class Collection:
    """One named collection under a root folder."""

    def __init__(self, spark: SparkSession, root: str, name: str, known: tuple[str, ...] = ("questions_opendata", "answers_opendata")):
        if name not in known:
            raise ValueError(f"unknown collection: {name}")
        self.spark, self.name = spark, name
        self.store = BucketedFolder(spark, f"{root.rstrip('/')}/{name}", SCHEMA, "id")

    def exists(self) -> bool:
        return self.store.info() is not None

    def vector_size(self) -> int | None:
        now = self.store.info()
        return now and now["size"]

    def points(self) -> DataFrame:
        if not self.exists():
            raise ValueError(f"no such collection: {self.name}")
        return self.store.rows()

    def create(self, size: int) -> None:
        """An empty collection; an existing one must have the same size."""
        have = self.vector_size()
        if have is not None and have != size:
            raise ValueError(f"{self.name} has vectors of {have}, not {size}")
        if have is None:
            self.store.write(self.spark.createDataFrame([], SCHEMA), size=size)

    def get(self, ident: str, with_vector: bool = False) -> DataFrame:
        return self.get_many([ident], with_vector).limit(1)

    def get_many(self, ids: list[str], with_vector: bool = True) -> DataFrame:
        if not self.exists():
            raise ValueError(f"no such collection: {self.name}")
        wanted = self.spark.createDataFrame([(str(i),) for i in ids], "id string")
        found = self.store.rows(self.store.buckets_of(wanted)).where(F.col("id").isin([str(i) for i in ids]))
        return found if with_vector else found.drop("vector")

    def scroll(self, spec: dict | None = None, with_vector: bool = True) -> DataFrame:
        cond = compile_filter(spec)
        found = self.points() if cond is None else self.points().where(cond)
        return found if with_vector else found.drop("vector")

    def upsert(self, points: DataFrame, order: Sequence[str] = ()) -> None:
        """Points by id, the new ones counting; null vectors are left out, one of another size than the collection's is an error.

        A collection that isn't there yet is made with the size of the vectors, which must all have the same. Of points repeated under one id the
        last in the given order counts, at a tie the one whose payload and vector come last.
        """
        fresh = points.select("id", F.col("vector").cast("array<float>").alias("vector"), "payload", *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)]).where("id is not null and vector is not null")
        sizes = fresh.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
        size = self.vector_size()
        if sizes["least"] is None:
            return
        if size is None:
            size = sizes["least"]
        if not sizes["least"] == sizes["most"] == size:
            raise ValueError(f"{self.name} takes vectors of {size}, not {sizes['least']} to {sizes['most']}")
        if not self.exists():
            self.create(size)
        ranked = F.struct(*[f"__o{i}" for i in range(len(order))], "payload", "vector")
        fresh = stage(fresh.groupBy("id").agg(F.max(ranked).alias("r")).select("id", "r.vector", "r.payload"), "points")
        touched = self.store.buckets_of(fresh)
        self.store.write(replace_by_key(self.store.rows(touched), fresh, ["id"]), touched)
        unstage(fresh)

    def delete(self, spec: dict) -> None:
        """Points a filter fits; a filter without clauses is refused."""
        cond = compile_filter(spec)
        if cond is None:
            raise ValueError("a delete needs a filter")
        points = self.points()
        touched = self.store.buckets_of(points.where(cond))
        if touched:
            self.store.write(self.store.rows(touched).where(~F.coalesce(cond, F.lit(False))), touched)

    def delete_ids(self, ids: DataFrame) -> int:
        """Points by id (a table of them, however long); how many there were."""
        points = self.points()
        gone = stage(points.select("id").join(ids.select(F.col("id").cast("string").alias("id")), "id", "left_semi"), "gone")
        touched = self.store.buckets_of(gone)
        n = gone.count()
        if touched:
            self.store.write(self.store.rows(touched).join(gone, "id", "left_anti").select("id", "vector", "payload"), touched)
        unstage(gone)
        return n

    def truncate(self) -> bool:
        """Empties the collection; whether points were removed."""
        if not self.exists():
            return False
        had = not self.points().isEmpty()
        self.store.write(self.spark.createDataFrame([], SCHEMA))
        return had

    def search(self, queries: DataFrame, k: int, spec: dict | None = None, least: float | None = None) -> DataFrame:
        """The filter first, then the exact k best: a filter never leaves fewer than there are."""
        if not 1 <= k <= 10_000:
            raise ValueError("k must be between 1 and 10000")
        if least is not None and not -1 <= least <= 1:
            raise ValueError("a cosine lies between -1 and 1")
        return nearest(self.scroll(spec), queries, "id", "vector", k=k, least=least)
