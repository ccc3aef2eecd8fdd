from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluate, groups, incremental, knn, merge
from corvane.operators.collection import Collection, compile_filter
from corvane.operators.merge import QUESTION_POLICY, Policy

Q = "id string, etat_question string, objet string, texte_question string, reponse_id string, auteur_nom string"


def test_question_merge(spark):
    old = spark.createDataFrame([("a", "REPONDU", "o1", "", "r1", "n1"), ("b", "EN_COURS", None, "t", None, None), ("k", "EN_COURS", "k", "k", "k", "k")], Q)
    new = spark.createDataFrame(
        [("a", "EN_COURS", "o2", "t2", "r2", "n2", 1), ("b", "RETIRE", None, "u", "r9", "n", 2), ("c", "REPONDU", "x", "", None, "first", 3), ("c", "EN_COURS", None, "late", "r", "second", 4)], Q + ", no int"
    )
    got = {r["id"]: r for r in merge.merge(old, new, "id", QUESTION_POLICY, ["no"]).collect()}
    assert tuple(got["a"])[1:] == ("REPONDU", "o2", "t2", "r1", "n1", "updated")
    assert tuple(got["b"])[1:] == ("RETIRE", None, "t", "r9", None, "updated")
    assert tuple(got["c"])[1:] == ("REPONDU", "x", "late", "r", "first", "inserted")
    assert got["k"]["written"] == "kept"
    assert merge.merge(old.limit(0), new.limit(0), "id", {"objet": Policy.LAST}, ["no"]).count() == 0


def test_replies(spark):
    old = spark.createDataFrame([("r", "kept", "l", 1)], "id string, texte_reponse string, ministre_reponse_libelle string, updated_at int")
    new = spark.createDataFrame(
        [("r", "no", None, 2, "q", 1), ("s", None, None, 2, "q", 2), ("s", "second", "x", 2, "q", 3)], "id string, texte_reponse string, ministre_reponse_libelle string, updated_at int, ministre_libelle string, no int"
    )
    got = {tuple(r) for r in merge.upsert_replies(old, new, ["no"]).collect()}
    assert got == {("r", "kept", "l", 2), ("s", "", "q", 2)}


def test_get_or_create(spark):
    old = spark.createDataFrame([(3, "b")], "id int, l string")
    got = merge.get_or_create(old, spark.createDataFrame([("c",), ("a",), ("b",), ("a",), (None,)], "l string"), "l")
    assert {tuple(r) for r in got.collect()} == {(3, "b"), (4, "a"), (5, "c")}


def test_get_or_create_of_many_labels(spark):
    labels = spark.range(2_000_000).select(F.sha2(F.col("id").cast("string"), 256).alias("l"))
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            got = merge.get_or_create(spark.createDataFrame([(3, "b")], "int_id int, l string").withColumnRenamed("int_id", "id"), labels, "l")
            r = got.agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.max("id").alias("top")).first()
            assert tuple(r) == (2_000_001, 2_000_001, 2_000_003)
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    first = got.where("id <> 3").orderBy("l").limit(3).select("id").collect()
    assert [r["id"] for r in first] == [4, 5, 6]


def test_dedup(spark):
    r = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y"), ("4", ""), ("5", ""), ("6", None)], "id string, t string")
    m = merge.canonical_map(r, "id", "t")
    assert [tuple(x) for x in m.collect()] == [("2", "1")]
    q = spark.createDataFrame([("a", "2"), ("b", "3"), ("c", None)], "q string, r string")
    assert {tuple(x) for x in merge.apply_map(q, "r", m, "old", "canonical").collect()} == {("a", "1"), ("b", "3"), ("c", None)}


def test_filters_refuse_what_they_dont_know():
    assert compile_filter({}) is None and compile_filter(None) is None
    for bad in ({"should": []}, {"must": [{"key": "a", "range": {}}]}, {"must_not": [{"nested": 1}]}):
        with pytest.raises(ValueError):
            compile_filter(bad)


def test_collection(spark, tmp_path):
    with pytest.raises(ValueError):
        Collection(spark, str(tmp_path), "other")
    c = Collection(spark, str(tmp_path), "questions_opendata")
    assert not c.exists() and c.vector_size() is None and c.truncate() is False
    c.create(2)
    c.create(2)
    with pytest.raises(ValueError):
        c.create(3)
    point = "id string, vector array<float>, payload string"
    c.upsert(spark.createDataFrame([("a", [1.0, 0.0], '{"s":"AN","n":1}'), ("b", [0.0, 1.0], '{"s":"SENAT","n":2}'), ("x", None, "{}")], point))
    c.upsert(spark.createDataFrame([("b", [1.0, 1.0], '{"s":"SENAT","n":3}')], point))
    assert {tuple(r) for r in c.scroll({"must": [{"key": "n", "match": {"any": [3, 9]}}]}, False).collect()} == {("b", '{"s":"SENAT","n":3}')}
    assert c.get("zz").count() == 0 and c.get_many(["a", "b"]).count() == 2
    assert {r["id"] for r in c.scroll({"must_not": [{"has_id": ["a"]}]}).collect()} == {"b"}
    hits = c.search(c.get_many(["a"]), 5, least=0.5).collect()
    assert [(h["id"], round(h["score"], 3)) for h in hits] == [("b", 0.707)]
    with pytest.raises(ValueError):
        c.upsert(spark.createDataFrame([("z", [1.0], "{}")], point))
    with pytest.raises(ValueError):
        c.delete({})
    c.upsert(spark.createDataFrame([("m", [1.0, 2.0], "{}", 2), ("m", [3.0, 4.0], "{}", 1), ("b", [0.5, 1.0], "{}", 1)], point + ", no int"), ["no"])
    assert {r["id"]: r["vector"] for r in c.points().collect()} == {"a": [1.0, 0.0], "b": [0.5, 1.0], "m": [1.0, 2.0]}
    assert c.delete_ids(spark.createDataFrame([("m",), ("nn",)], "id string")) == 1
    c.delete({"must": [{"key": "s", "match": {"value": "AN"}}]})
    assert [r["id"] for r in c.points().collect()] == ["b"]
    other = Collection(spark, str(tmp_path), "answers_opendata")
    other.upsert(spark.createDataFrame([("x", None, "{}")], point))
    assert not other.exists()
    other.upsert(spark.createDataFrame([("y", [1.0, 2.0, 3.0], "{}")], point))
    assert other.vector_size() == 3
    assert c.truncate() is True and c.truncate() is False


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x[7] = x[3]
    rows = [(i, [float(v) for v in x[i]], "clash") for i in range(300)] + [(900, None, ""), (901, [], ""), (902, [0.0] * 8, ""), (903, [float("nan")] * 8, ""), (904, [1.0] * 3, "")]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, score string").repartition(5)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for block in (4, 100):  # queries in blocks that meet blocks of rows, and in one block sent to the tasks
        found = knn.nearest(df, df.where("id % 20 = 3"), "id", "v", k=4, block=block, row_block=70).collect()
        got = {(r["query_id"], r["rank"]): r["id"] for r in found}
        assert len(got) == len(found) == 15 * 4
        for q in range(3, 300, 20):
            order = sorted((i for i in range(300) if i != q), key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:4]
            assert [got[q, k + 1] for k in range(4)] == order
        above = knn.nearest(df, df.where("id % 20 = 3"), "id", "v", k=None, least=0.2, block=block, row_block=70).collect()
        assert {(r["query_id"], r["id"]) for r in above} == {(q, i) for q in range(3, 300, 20) for i in range(300) if i != q and u[q] @ u[i] >= 0.2}
    with pytest.raises(ValueError):
        knn.nearest(df, df, "id", "v", k=None)
    text = df.select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"), "v")
    assert {r["id"] for r in knn.nearest(text, text.where("id = 'k3'"), "id", "v", k=1).collect()} == {"k7"}
    assert knn.nearest(df.limit(0), df, "id", "v", k=3).count() == 0 and knn.nearest(df, df.limit(0), "id", "v", k=3).count() == 0


def test_vote_and_first_seen(spark):
    near = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.4), (1, 12, 0.2)], "query_id int, id int, score double")
    voters = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b"), (12, "a")], "id int, label string")
    assert [tuple(r)[:2] for r in knn.vote(near, voters).collect()] == [(1, "a")]
    hits = spark.createDataFrame([(0, 1, "x", 0.1), (1, 1, "x", 0.9), (1, 2, "y", 0.8)], "query_no int, rank int, id string, score double")
    assert {(r["id"], r["score"]) for r in knn.first_seen(hits).collect()} == {("x", 0.1), ("y", 0.8)}


def test_office_steps_and_attributions(spark):
    steps = spark.createDataFrame(
        [
            (1, "AN", 5, date(2023, 1, 1), "Pour attribution", "DSS - SD2 - Bureau 2B - suite", date(2023, 2, 1)),
            (2, "AN", 5, date(2023, 1, 1), "Pour rédaction", "DSS - SD3 - 3A", date(2023, 2, 1)),
            (3, "AN", 5, date(2023, 1, 1), "Pour visa", "DSS - SD4 - 4A", date(2023, 9, 1)),
            (4, "AN", 6, date(2023, 1, 1), "Pour rédaction", "XXX - SD3 - 3A", None),
        ],
        "id int, parlement string, numero_question int, date_jo_question date, type_etape string, poste_etape string, date_debut_etape date",
    )
    got = groups.office_steps(steps).collect()
    assert [(r["question_id"], r["sous_direction"], r["source_etape_id"]) for r in got] == [("AN-16-QE-5", "SD3", 2)]
    human = spark.createDataFrame([("q1", 1), ("q2", None), ("q4", 2)], "question_id string, bureau_reel_id int")
    offices = spark.createDataFrame([(1, "[SD 1/1A] x", 9), (2, "no code", 9)], "id int, nom string, direction_id int")
    directions = spark.createDataFrame([(9, "DGX")], "id int, nom string")
    e = "id int, question_id string, direction_txt string, sous_direction string, bureau string, bureau_full string, date_debut_etape date"
    extract = spark.createDataFrame([(1, "q1", "D", "SD9", "x", None, None), (2, "q2", "D", "SD2", "Bureau 2B", None, date(2020, 1, 1)), (3, "q2", "D", "SD3", None, None, None), (4, "q3", "D", " ", "x", None, None), (5, "q4", "D", "SD5", "a b", "a b - c", None)], e)
    got = {tuple(r) for r in groups.attributions(human, offices, directions, extract).collect()}
    assert got == {("q1", "SD1/1A", "[SD 1/1A] x", "DGX", "attribution"), ("q2", "SD2/2B", "SD2 — Bureau 2B", "D", "extract"), ("q4", "SD5/A", "SD5 — a b - c", "D", "extract")}


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 4)], "query_id int, id string, rank int")
    mates = spark.createDataFrame([(1, "b"), (1, "z"), (2, "c"), (3, "y")], "query_id int, id string")
    true = evaluate.of_pairs(ranked, mates)
    by = {r["k"]: (r["n_queries"], r["hit"], r["recall"]) for r in evaluate.hit_recall(*true, (1, 3, 5)).collect()}
    assert by == {1: (3, 0.0, 0.0), 3: (3, 0.3333, 0.1667), 5: (3, 0.6667, 0.5)}
    assert {tuple(r) for r in evaluate.rank_buckets(*true).collect()} == {("2-3", 1), ("4-5", 1), ("miss", 1)}
    rows = spark.createDataFrame([("q", "g"), ("a", "g"), ("b", "g"), ("c", "h"), ("s", "alone")], "id string, g string")
    near = spark.createDataFrame([("q", "b", 1), ("q", "c", 2), ("s", "a", 1)], "query_id string, id string, rank int")
    hits, sizes = evaluate.of_mates(near, rows.where("id in ('q', 's')"), rows, "g")
    assert [tuple(r) for r in hits.collect()] == [("q", "b", 1)] and [tuple(r) for r in sizes.collect()] == [("q", 2)]
    for values, want in (([1, 9, 5, 7], 7), ([3, 1, 2], 2), ([4], 4), ([2, 2, 8, 8], 8)):
        assert spark.createDataFrame([(v,) for v in values], "v int").agg(evaluate.upper_median("v")).first()[0] == want
    t = evaluate.threshold_recall(spark.createDataFrame([(1, 0.9), (1, None), (2, 0.1)], "query_id int, score double"), (0.5,)).first()
    assert (t["recall"], t["hit"]) == (0.25, 0.5)
    fails = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3)], "g string, o int")
    assert [r["o"] for r in evaluate.diverse_failures(fails, "g", "o", 2).collect()] == [1, 3]


def test_incremental(spark):
    texts = spark.createDataFrame([("a", "same"), ("b", "new"), ("c", "  ")], "id string, t string")
    plan = incremental.plan_embedding(texts, spark.createDataFrame([], "point_id string, embedding_model string, content_hash string"), "id", "t", "m")
    assert {r["id"]: r["action"] for r in plan.collect()} == {"a": "embed", "b": "embed", "c": "blank"}
    indexed = plan.where("id = 'a'").select("point_id", F.lit("m").alias("embedding_model"), "content_hash").union(spark.createDataFrame([("gone", "m", "h")], "point_id string, embedding_model string, content_hash string"))
    again = incremental.plan_embedding(texts, indexed, "id", "t", "m")
    stale = incremental.stale_points(indexed, texts, "id")
    assert [r["point_id"] for r in stale.collect()] == ["gone"]
    assert incremental.run_stats(again, stale).first().asDict() == dict(total=3, embed=1, skip=1, blank=1, deleted=1)
