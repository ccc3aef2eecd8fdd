import pytest
from pyspark.sql import functions as F

from corvane.operators.stores import chunk_cache, delete_hashes, manifest, path_variants, reset
from corvane.sources import fetch

HTML = "<p>Texte de la question :</p>\n<p>Pourquoi ?</p><p>Réponse</p>"


def test_stores(spark, tmp_path):
    m, c = manifest(spark, str(tmp_path / "m")), chunk_cache(spark, str(tmp_path / "c"))
    assert m.rows().count() == 0
    m.upsert(spark.createDataFrame([("a/x", "1"), ("a/y", "2"), ("b/z", "3")], "path string, document_hash string"))
    m.upsert(spark.createDataFrame([("a/y", "4")], "path string, document_hash string"))
    assert m.get(path="a/y").first()["document_hash"] == "4" and m.get(path="zz").count() == 0
    assert m.delete(F.col("path") == "zz") == 0 and m.delete(F.col("path") == "a/x") == 1
    c.upsert(spark.createDataFrame([("s", "4", "[]"), ("t", "4", "[]"), ("s", "9", "[]"), ("s", "3", "[]")], "strategy string, document_hash string, chunks string"))
    assert delete_hashes(c, ["9", "9"]) == 1 and delete_hashes(c, []) == 0
    assert reset(m, c, "/data/zz", base="/data") == (0, 0, False)
    assert reset(m, c, "/data/a", base="/data", truncate=lambda: True) == (1, 2, True)
    assert [r["path"] for r in m.rows().collect()] == ["b/z"] and c.rows().count() == 1
    with pytest.raises(ValueError):
        reset(m, c, "")
    assert path_variants("/data/a/", "/data") == ["/data/a/", "/data/a", "a", "a/"] and path_variants("x") == ["x", "x/"]


def test_a_write_cut_off_leaves_the_version_before(spark, tmp_path):
    m = manifest(spark, str(tmp_path / "m"))
    put = lambda h: m.upsert(spark.createDataFrame([("a", h)], "path string, document_hash string"))
    put("1")
    (tmp_path / "m" / "version-000000000002.json").write_text('{"folder": "ro')  # a pointer half written
    assert m.rows().first()["document_hash"] == "1"
    (tmp_path / "m" / "version-000000000003.json").write_text('{"folder": "rows-gone"}')  # data that isn't there
    assert m.rows().first()["document_hash"] == "1"
    (tmp_path / "m" / "rows-lost").mkdir()  # data without a pointer
    put("2")
    assert m.rows().first()["document_hash"] == "2"
    old = m.rows()
    for h in "345":
        put(h)
        if h == "4":
            assert old.first()["document_hash"] == "2"  # a reader two versions behind
    assert m.rows().first()["document_hash"] == "5" and len(list((tmp_path / "m").glob("version-*.json"))) <= 5


def test_two_writers_cannot_take_one_number(spark, tmp_path):
    m = manifest(spark, str(tmp_path / "m"))
    m.upsert(spark.createDataFrame([("a", "1")], "path string, document_hash string"))
    m._numbers = lambda: []  # as if the other writer's pointer wasn't there yet
    with pytest.raises(Exception):
        m.upsert(spark.createDataFrame([("a", "2")], "path string, document_hash string"))
    assert manifest(spark, str(tmp_path / "m")).rows().first()["document_hash"] == "1"


def test_fetch(spark):
    assert fetch.page_address("senat-17-qe-42") == "17/q1700042.html"
    for bad in ("AN-17-QE-1", "x"):
        with pytest.raises(ValueError):
            fetch.page_address(bad)
    assert fetch.archive_name(14) == "Questions_ecrites_XIV.xml.zip" and fetch.archive_name(17) == "Questions_ecrites_17.xml.zip"
    table = spark.createDataFrame([("SENAT-17-QE-1", "t")], "id string, texte_question string")
    add = lambda df: table.unionByName(df.select("id", "texte_question"))
    assert fetch.read_through(table, "SENAT-17-QE-1", None, add)[1] is False
    row, now = fetch.read_through(table, "SENAT-17-QE-2", lambda a: HTML, add)
    assert now and row["texte_question"] == "Pourquoi ?"

    def dead(a):
        raise OSError

    for ident, get in (("AN-17-QE-5", None), ("SENAT-17-QE-3", lambda a: None), ("SENAT-17-QE-3", dead), ("SENAT-17-QE-3", lambda a: "<p>rien</p>")):
        with pytest.raises(KeyError):
            fetch.read_through(table, ident, get, add)
    with pytest.raises(ValueError):
        fetch.read_through(table, "zzz", None, add)
    assert fetch.reachable(spark)


def test_scroll_and_arguments(spark):
    pages = {None: ([{"id": 1, "vector": [1.0], "payload": "{}"}], "n"), "n": ([{"id": 2}, {"id": 3}], None)}
    assert sorted(r["id"] for r in fetch.points_of_pages(spark, fetch.scroll_pages(pages.get), 2).collect()) == ["1", "2", "3"]
    fetch.check_search("questions", 50, 1.0)
    for bad in (("x", 5, None), ("answers", 0, None), ("answers", 51, None), ("answers", 5, 1.1)):
        with pytest.raises(ValueError):
            fetch.check_search(*bad)
    t = spark.sql("select * from values ('a', 'x', null, date'2020-01-01'), ('b', null, null, null), ('c', 'y', now(), date'2021-01-01') as v(id, texte_question, analyzed_at, date_publication_jo)")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(fetch.chosen(t, backfill=True)) == ["a"] and ids(fetch.chosen(t, ids=["b"])) == ["b"] and ids(fetch.chosen(t, limit=2)) == ["c", "a"]
    assert spark.createDataFrame([("13382. — 10 mars 2026. — Mme X attire",)], "t string").select(fetch.without_heading(F.col("t"))).first()[0] == "Mme X attire"
