"""Enquiries answered together, and office attributions from several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.labels import SIGNAL_STEPS, bracket_key, joined_label, legislature_of, post_parts, typed_key
from corvane.operators.merge import first_per_key


def answered_together(questions: DataFrame, replies: DataFrame, least: int = 2) -> DataFrame:
    """A row per reply that serves several questions, with their ids in order."""
    q = questions.select("id", F.col("reponse_id")).where("reponse_id is not null").distinct()
    r = replies.select(F.col("id").alias("reponse_id"), "source", "date_reponse_jo").distinct()
    return (
        q.join(r, "reponse_id")
        .groupBy("reponse_id", "source", "date_reponse_jo")
        .agg(F.count("*").alias("n_questions"), F.array_sort(F.collect_list("id")).alias("question_ids"))
        .where(F.col("n_questions") >= least)
    )


def members_together(questions: DataFrame, least: int = 2) -> DataFrame:
    """``reponse_id, id, n_questions``: the same groups a row per member, for groups too large for an array."""
    q = questions.select("id", "reponse_id").where("reponse_id is not null").distinct()
    sizes = q.groupBy("reponse_id").agg(F.count("*").alias("n_questions")).where(F.col("n_questions") >= least)
    return q.join(sizes, "reponse_id")


def restrict(groups: DataFrame, ids: DataFrame, group: str, member: str, least: int = 2) -> DataFrame:
    """Groups (a row per member) cut down to listed members, those that keep enough of them."""
    left = groups.join(ids.select(member).distinct(), member, "left_semi")
    whole = left.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return left.join(whole, group)


def siblings(queries: DataFrame, members: DataFrame, group: str, member: str) -> DataFrame:
    """``g, id, sibling``: for each of the queries the other members of its group."""
    a = queries.select(F.col(group).alias("g"), F.col(member).alias("id"))
    b = members.select(F.col(group).alias("g"), F.col(member).alias("sibling"))
    return a.join(b, "g").where("id <> sibling").select("g", "id", "sibling")


def office_steps(steps: DataFrame) -> DataFrame:
    """Workflow steps that show an office, latest of each question and direction.

    ``steps``: id, parlement, numero_question, date_jo_question, type_etape, poste_etape, date_debut_etape.
    """
    parts = post_parts(F.col("poste_etape"))
    leg = legislature_of(F.col("date_jo_question"))
    rows = (
        steps.where(F.col("type_etape").isin(*SIGNAL_STEPS))
        .where("poste_etape is not null and numero_question is not null and date_jo_question is not null")
        .select(
            F.concat_ws("-", "parlement", leg.cast("string"), F.lit("QE"), F.col("numero_question").cast("string")).alias("question_id"),
            parts.alias("p"),
            F.col("id").alias("source_etape_id"),
            "date_debut_etape",
        )
        .where("p is not null")
        .select("question_id", F.col("p.direction").alias("direction_txt"), "p.sous_direction", "p.bureau", "p.bureau_full", "source_etape_id", "date_debut_etape")
    )
    last = F.struct(F.coalesce("date_debut_etape", F.lit("0001-01-01").cast("date")), "source_etape_id")
    rest = [c for c in rows.columns if c not in ("question_id", "direction_txt")]
    return rows.groupBy("question_id", "direction_txt").agg(F.max_by(F.struct(*rest), last).alias("r")).select("question_id", "direction_txt", *[f"r.{c}" for c in rest])


def attributions(human: DataFrame, offices: DataFrame, directions: DataFrame, extract: DataFrame) -> DataFrame:
    """``question_id, bureau_key, bureau_label, direction_label, source``: human attributions, and extracted ones of other questions.

    ``human``: question_id, bureau_reel_id. The dimensions are joined without a hint: the planner broadcasts them while they are small.
    """
    dims = offices.select(F.col("id").alias("bureau_reel_id"), F.col("nom").alias("bureau_label"), "direction_id").where(F.col("nom").rlike(r"^\s*\[[^\]]+\]"))
    names = directions.select(F.col("id").alias("direction_id"), F.col("nom").alias("direction_label"))
    by_hand = human.where("bureau_reel_id is not null").select("question_id", "bureau_reel_id").join(dims, "bureau_reel_id")
    first = by_hand.join(names, "direction_id", "left").select(
        "question_id", bracket_key(F.col("bureau_label")).alias("bureau_key"), "bureau_label", "direction_label", F.lit("attribution").alias("source")
    )
    typed = extract.where(F.trim("sous_direction") != "").join(by_hand.select("question_id"), "question_id", "left_anti")
    typed = first_per_key(typed, ["question_id"], [F.desc_nulls_last("date_debut_etape"), F.col("id"), F.col("direction_txt")])
    second = typed.select(
        "question_id",
        typed_key(F.col("sous_direction"), F.col("bureau")).alias("bureau_key"),
        joined_label(F.col("sous_direction"), F.coalesce("bureau_full", "bureau")).alias("bureau_label"),
        F.col("direction_txt").alias("direction_label"),
        F.lit("extract").alias("source"),
    )
    both = first.unionByName(second).where(F.col("bureau_key").isNotNull() & (F.col("bureau_key") != ""))
    return both.withColumn("bureau_label", F.coalesce(F.nullif("bureau_label", F.lit("")), "bureau_key"))


def human_first(human: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """One row of each key, a human one before an extracted one."""
    both = human.withColumn("__p", F.lit(0)).unionByName(extracted.withColumn("__p", F.lit(1)))
    w = Window.partitionBy(key).orderBy("__p")
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__p", "__n")
