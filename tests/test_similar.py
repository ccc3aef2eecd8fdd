import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from corvane import plugins
from corvane.operators.collection import Collection
from corvane.operators.similar import analyse, embed_run, office_upsert, retrieve, similar_items

POINT = "id string, vector array<float>, payload string"


def points(spark):
    rows = [("a", [1.0, 0.0], "pont neuf"), ("b", [0.9, 0.1], "route"), ("c", [0.8, 0.3], "pont ancien"), ("d", [0.0, 1.0], "pont neuf"), ("e", [1.0, 0.05], None)]
    return spark.createDataFrame([(i, v, json.dumps({"text": t, "kind": "x" if i != "b" else "y"})) for i, v, t in rows], POINT)


def test_retrieve_merges_vectors_by_first_seen(spark):
    p = points(spark)
    asked = spark.createDataFrame([("a", [1.0, 0.0], [0.0, 1.0]), ("z", [0.0, 1.0], None)], "id string, v1 array<float>, v2 array<float>")
    got = {(r["query_id"], r["id"]): r["query_no"] for r in retrieve(asked, p, ["v1", "v2"], 2).collect()}
    assert got == {("a", "e"): 0, ("a", "b"): 0, ("a", "d"): 1, ("a", "c"): 1, ("z", "d"): 0, ("z", "c"): 0}
    kept = retrieve(asked, p, ["v1"], 5, spec={"must_not": [{"key": "kind", "match": {"value": "y"}}]}, least=0.5)
    assert {r["id"] for r in kept.where("query_id = 'a'").collect()} == {"e", "c"}
    with pytest.raises(ValueError):
        retrieve(asked, p, [], 2)


def test_similar_items(spark):
    p = points(spark)
    asked = p.where("id = 'a'").select("id", "vector", F.lit("pont neuf").alias("text")).union(spark.createDataFrame([("q", [1.0, 0.0], "")], "id string, vector array<float>, text string"))
    got = [(r["query_id"], r["rank"], r["id"], r["score"]) for r in similar_items(asked, p, plugins.OverlapReranker, 2, text_field="text").orderBy("rank").collect()]
    assert got == [("a", 1, "d", 1.0), ("a", 2, "c", 0.5)]
    for bad in (dict(k=0), dict(k=51), dict(k=3, least=1.5)):
        with pytest.raises(ValueError):
            similar_items(asked, p, plugins.OverlapReranker, text_field="text", **bad)


def test_embed_run(spark, tmp_path):
    class Blocking(plugins.HashEmbedder):
        def embed_batch(self, texts):
            if any("interdit" in t for t in texts):
                raise plugins.ContentBlocked
            return plugins.HashEmbedder.embed_batch(self, texts)

    def wide():
        return plugins.HashEmbedder(8)

    c = Collection(spark, str(tmp_path), "questions_opendata")
    df = lambda *rows: spark.createDataFrame(list(rows), "id string, text string")
    run = lambda t, make=Blocking, **kw: embed_run(t, c, make, "m", **kw).first().asDict()
    assert run(df(("1", "un"), ("2", "deux"), ("3", " "), ("4", "interdit"))) == dict(total=4, embed=2, skip=0, blank=1, blocked=1, deleted=0)
    assert c.vector_size() == 64 and c.points().count() == 2
    assert run(df(("1", "un"), ("2", "autre"), ("5", "cinq")), current=df(("2", ""), ("5", ""))) == dict(total=3, embed=2, skip=1, blank=0, blocked=0, deleted=1)
    assert {json.loads(r["payload"])["question_id"] for r in c.points().collect()} == {"2", "5"}
    with pytest.raises(ValueError):
        run(df(("9", "neuf")), wide)
    with pytest.raises(ValueError):
        run(df(("9", "interdit")), need_one=True)
    assert run(df()) == dict(total=0, embed=0, skip=0, blank=0, blocked=0, deleted=2)


def test_service_adapters():
    said = []

    def post(body):
        said.append(body)
        return 200, json.dumps({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})

    e = plugins.ServiceEmbedder(post, "m")
    assert e.embed_batch(["a", "b"]) == [[1.0], [2.0]] and said == [{"model": "m", "input": ["a", "b"]}] and e.embed_batch([]) == []
    with pytest.raises(plugins.ServiceError):
        e.embed("a")  # two vectors for one text
    for status, body, kind in ((403, '{"guardrail_name": "x"}', plugins.ContentBlocked), (403, "forbidden by guardrail", plugins.ServiceError), (500, "content blocked", plugins.ServiceError)):
        with pytest.raises(kind):
            plugins.ServiceEmbedder(lambda b: (status, body), "m").embed("a")  # noqa: B023

    def one_by_one(body):
        if len(body["input"]) > 1 or body["input"] == ["x"]:
            return 403, "Content Blocked"
        return 200, json.dumps({"data": [{"index": 0, "embedding": [3.0]}]})

    assert plugins.embed_partial(plugins.ServiceEmbedder(one_by_one, "m"), ["a", "x"]) == [[3.0], None]
    results = [{"index": 0, "relevance_score": 0.2}, {"index": 1, "score": 0.9}, {"index": 7, "score": 1.0}, {"index": 2}]
    for name in ("data", "results"):
        r = plugins.ServiceReranker(lambda b: (200, json.dumps({name: results})), "m")  # noqa: B023
        assert plugins.ordered_scores(r.rerank("q", ["a", "b", "c"]), 3) == [(1, 0.9), (0, 0.2)]
    assert plugins.ServiceReranker(lambda b: (200, "{}"), "m").rerank("q", ["a"], 1) == []


def test_analyse_and_offices(spark):
    t = spark.createDataFrame([("1", "Mme X interroge M. Y sur l'eau. Elle lui demande pourquoi.", "old"), ("2", None, None)], "id string, t string, context string")
    dry = analyse(t, "t", None)
    assert dry.columns == ["id", "is_reminder", "context", "request"]
    wet = {r["id"]: r for r in analyse(t, "t", datetime(2024, 1, 2)).collect()}
    assert wet["1"]["request"] == "Elle lui demande pourquoi." and wet["2"]["context"] is None and wet["1"]["analyzed_at"] == datetime(2024, 1, 2)
    columns = "question_id string, direction_txt string, bureau string, source_etape_id int, date_debut_etape date"
    old = spark.createDataFrame([("q", "D", "old", 1, None), ("k", "D", "kept", 1, None)], columns)
    new = spark.createDataFrame([("q", "D", "late", 3, date(2024, 2, 1)), ("q", "D", "early", 9, date(2024, 1, 1)), ("q", "E", "x", 4, None)], columns)
    assert {r[:3] for r in map(tuple, office_upsert(old, new).collect())} == {("q", "D", "late"), ("k", "D", "kept"), ("q", "E", "x")}
    assert {r[:3] for r in map(tuple, office_upsert(old, new, truncate=True).collect())} == {("q", "D", "late"), ("q", "E", "x")}
