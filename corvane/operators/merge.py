"""Keyed writes as snapshots: a policy of each column, folded over repeated rows, joined in full.

A table of files has no row updates. A merge reads the existing and the incoming rows, folds rows of one key in their order of
arrival, joins both sides on the key once, and gives the new snapshot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import stage


class Policy(Enum):
    """What a column takes from the existing and the incoming row."""

    KEEP = "the existing row's value, also where it is null"
    FIRST = "the first that isn't null, existing before incoming"
    FIRST_FILLED = "the first that is neither null nor empty"
    LAST = "the last that isn't null, incoming before existing"
    SETTLED = "REPONDU once any row says so, else the incoming value"


#: The policy of a question's columns; columns not named are kept.
QUESTION_POLICY: Mapping[str, Policy] = {
    "etat_question": Policy.SETTLED,
    "date_publication_jo": Policy.FIRST,
    "page_jo": Policy.FIRST,
    "texte_question": Policy.FIRST_FILLED,
    "objet": Policy.LAST,
    "reponse_id": Policy.FIRST,
    "auteur_prenom": Policy.FIRST,
    "auteur_grp_pol": Policy.FIRST,
    "auteur_circonscription": Policy.FIRST,
    "titre_senat": Policy.FIRST,
    "themes": Policy.FIRST,
}


def _folded(policy: Policy, name: str, order: Column) -> Column:
    """The value of a column over the rows of a key in their order."""
    c = F.col(name)
    if policy is Policy.FIRST:
        return F.min_by(c, F.when(c.isNotNull(), order))
    if policy is Policy.LAST:
        return F.max_by(c, F.when(c.isNotNull(), order))
    if policy is Policy.FIRST_FILLED:
        filled = F.min_by(c, F.when(c.isNotNull() & (c != ""), order))
        return F.coalesce(filled, F.max_by(c, order))
    if policy is Policy.SETTLED:
        return F.when(F.coalesce(F.bool_or(c == "REPONDU"), F.lit(False)), F.lit("REPONDU")).otherwise(F.max_by(c, order))
    return F.min_by(c, order)


def merge(existing: DataFrame, incoming: DataFrame, key: str, policy: Mapping[str, Policy], order: Sequence[str]) -> DataFrame:
    """The new snapshot, with ``written`` as ``inserted``, ``updated`` or ``kept``.

    Existing rows come before incoming ones, and incoming ones in the order of the given columns. Repeated ids inside a
    delivery merge with one another as if they came one by one. Aggregation combines before its one shuffle.
    """
    columns = existing.columns
    old = existing.select(*columns, F.lit(0).alias("__side"), F.struct(F.lit(0).alias("side"), *[F.lit(None).cast(incoming.schema[o].dataType).alias(o) for o in order]).alias("__order"))
    carried = [F.col(c) if c in incoming.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in columns]
    new = incoming.select(*carried, F.lit(1).alias("__side"), F.struct(F.lit(1).alias("side"), *[F.col(o) for o in order]).alias("__order"))
    rows = old.unionByName(new)
    out = rows.groupBy(key).agg(
        *[_folded(policy.get(c, Policy.KEEP), c, F.col("__order")).alias(c) for c in columns if c != key],
        F.min("__side").alias("__first"),
        F.max("__side").alias("__last"),
    )
    written = F.when(F.col("__first") == 1, "inserted").when(F.col("__last") == 1, "updated").otherwise("kept")
    return out.select(*columns, written.alias("written"))


def replace_by_key(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The incoming row of every key it has, the last in the given order, and the other existing rows."""
    if order:
        latest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(o) for o in order])
        incoming = incoming.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
    return existing.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert_replies(existing: DataFrame, incoming: DataFrame, order: Sequence[str]) -> DataFrame:
    """Replies by id: the first of a delivery counts, an existing one is only touched; a null text becomes empty."""
    fresh = first_per_key(incoming, ["id"], [F.col(o) for o in order])
    label = F.coalesce("ministre_reponse_libelle", "ministre_libelle") if "ministre_libelle" in incoming.columns else F.col("ministre_reponse_libelle")
    fresh = fresh.withColumn("ministre_reponse_libelle", label).withColumn("texte_reponse", F.coalesce("texte_reponse", F.lit("")))
    touched = fresh.select("id", F.col("updated_at").alias("__touched"))
    kept = existing.join(touched, "id", "left").withColumn("updated_at", F.coalesce("__touched", "updated_at")).drop("__touched")
    return kept.unionByName(fresh.join(existing.select("id"), "id", "left_anti").select(*existing.columns))


def get_or_create(existing: DataFrame, labels: DataFrame, label: str, ident: str = "id") -> DataFrame:
    """The dimension with a row for every label; new ids go on from the highest, in the labels' order.

    Numbers are given per range of the sorted labels, so no task sorts them all. The ranges are written once: their bounds are
    drawn anew in each run, so counts and numbers must come from one and the same run.
    """
    wanted = labels.select(F.col(label).alias(label)).where(F.col(label).isNotNull()).distinct()
    new = wanted.join(existing.select(label), label, "left_anti")
    top = existing.agg(F.coalesce(F.max(ident), F.lit(0)).alias("top")).first()["top"]
    ranged = stage(new.repartitionByRange(F.col(label)).withColumn("__p", F.spark_partition_id()), "labels")
    counts = {r["__p"]: r["count"] for r in ranged.groupBy("__p").count().collect()}  # one row a range
    before, total = {}, int(top)
    for p in sorted(counts):
        before[p] = total
        total += counts[p]
    if not before:
        return existing
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("__p"))
    number = F.row_number().over(Window.partitionBy("__p").orderBy(label))
    made = ranged.withColumn(ident, (offset + number).cast(existing.schema[ident].dataType)).drop("__p")
    return existing.unionByName(made, allowMissingColumns=True)


def apply_map(df: DataFrame, column: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """The column with mapped values replaced; others stay."""
    m = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return df.join(m, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def without(df: DataFrame, column: str, mapping: DataFrame, old: str) -> DataFrame:
    """The rows whose key the mapping doesn't replace."""
    return df.join(mapping.select(F.col(old).alias(column)), column, "left_anti")


def canonical_map(df: DataFrame, key: str, text: str, where: Column | None = None) -> DataFrame:
    """``old, canonical`` of every row whose whole text has a smaller key elsewhere; blank texts aren't merged."""
    rows = df.where(where) if where is not None else df
    rows = rows.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, text)
    # equal hashes only bring texts together; the texts themselves decide
    heads = rows.groupBy(text).agg(F.min(key).alias("canonical"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(heads, text).where(F.col(key) != F.col("canonical")).select(F.col(key).alias("old"), "canonical")
