import io
import pickle
import zipfile

import pytest
from conftest import DATA, needs_data
from pyspark.sql import functions as F

from corvane import plugins
from corvane.operators.merge import QUESTION_POLICY
from corvane.sources import archives, dump, files, pages
from corvane.streaming import feeds

NS = 'xmlns="urn:referentiel"'


def xml(number, extra="", ns=NS):
    return f"<question {ns}><uid>u</uid><identifiant><numero>{number}</numero><legislature>17</legislature></identifiant><type>QE</type>{extra}</question>"


def heads(inner):
    return f"<indexationAN>{inner}</indexationAN>"


def test_zip_and_titles(spark, tmp_path):
    ways = {
        1: (heads("<rubrique>r</rubrique><teteAnalyse>t</teteAnalyse><analyses><analyse>a</analyse></analyses>"), "t"),
        2: (heads("<rubrique>r</rubrique><teteAnalyse> </teteAnalyse><analyses><analyse>a</analyse></analyses>"), "a"),
        3: (heads("<rubrique>r</rubrique><ANALYSE><ANA>u</ANA></ANALYSE>"), "u"),
        4: (heads("<rubrique>r</rubrique><teteAnalyse/>"), "r"),
        5: ("", None),
    }
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n, (inner, _) in ways.items():
            z.writestr(f"xml/{n}.xml", xml(n, inner))
        z.writestr("xml/bad.xml", "<question><identifiant>")
        z.writestr("root.xml", xml(99))
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    q = archives.parse_questions(archives.question_elements(archives.zip_entries(spark, str(tmp_path)), "content"))
    assert {r["numero_question"]: r["objet"] for r in q.collect()} == {n: t for n, (_, t) in ways.items()}
    assert {r["id"] for r in q.collect()} == {f"AN-17-QE-{n}" for n in ways}


def test_bulk_and_reply(spark):
    full = (
        "<minInt><developpe>Court</developpe></minInt><minAttribs><minAttrib><denomination><developpe>Premier</developpe></denomination></minAttrib>"
        "<minAttrib><denomination><developpe>Dernier</developpe></denomination></minAttrib></minAttribs>"
        "<textesQuestion><texteQuestion><infoJO><dateJO>2024-05-01</dateJO></infoJO><texte>Demande</texte></texteQuestion></textesQuestion>"
        "<textesReponse><texteReponse><infoJO><dateJO>02/06/2024</dateJO></infoJO><texte>Voici</texte></texteReponse></textesReponse><cloture><infoJO><pageJO>12</pageJO></infoJO></cloture>"
    )
    blank = "<textesReponse><texteReponse><texte> </texte></texteReponse></textesReponse>"
    doc = f"<questions>{xml(1, full, '')}{xml(2, '', '')}{xml(3, blank, '')}</questions>"
    q = archives.parse_questions(archives.question_elements(spark.createDataFrame([(doc,)], "content string"), "content"))
    got = {r["numero_question"]: r for r in q.collect()}
    a = got[1]
    assert (a["ministre_libelle"], a["texte_question"], a["texte_reponse"], a["page_reponse_jo"], a["etat_question"]) == ("Dernier", "Demande", "Voici", 12, "REPONDU")
    assert str(a["date_publication_jo"]) == "2024-05-01" and a["reponse_id"].startswith("AN-20240602-")
    assert got[3]["etat_question"] == "REPONDU" and got[3]["reponse_id"] is None and got[3]["texte_reponse"] is None
    assert got[2]["etat_question"] == "EN_COURS" and got[2]["reponse_id"] is None and got[2]["texte_question"] == ""


COLUMNS = "natquecod, legislature, numero, sorquecod, titre, nom, prenom, codequalite, circonscription, groupe, datejodepot, mindepotlib, minreplib1, datejorep1, txtque, themes, id"


def dump_row(kind, leg, number, ident, state="1", themes="\\N"):
    return "\t".join([kind, leg, number, state, "t", "N", "P", "\\N", "c", "g", "2024-01-02 00:00:00", "Min", "\\N", "\\N", "texte\\r\\nsuite", themes, ident])


def test_dump(spark, tmp_path):
    lines = [
        "-- text", f"COPY questions.tam_questions ({COLUMNS}) FROM stdin;", dump_row("QE", "13", "1", "1"), dump_row("QE", "17", "00200", "2", "2", "#2#14#99#"), dump_row("QE", "25", "7", "3"),
        dump_row("QO", "17", "8", "4"), dump_row("QE", "x", "9", "5"), "\\.", "after", 'COPY "sortquestion" ("sorquecod", sorquelib) FROM stdin;', "1\tEn cours", "2\told", "2\tRéponse publiée", "\\.",
        "COPY questions.the (thecle, thelib) FROM stdin;", "2\tLogement", "14\tForêts", "\\.", "COPY questions.tam_reponses (idque, txtrep, datejorep, minreplib) FROM stdin;", "2\tfirst\t\\N\t\\N", "2\tsaid\t2024-03-04 00:00:00\t\\N", "\\.",
    ]
    (tmp_path / "d.sql").write_text("\n".join(lines), encoding="utf-8")
    got = {r["id"]: r for r in dump.senate_questions(dump.read_dump(spark, str(tmp_path / "d.sql"))).collect()}
    assert set(got) == {"SENAT-17-QE-200", "SENAT-25-QE-7"}
    a = got["SENAT-17-QE-200"]
    assert (a["etat_question"], a["texte_reponse"], a["themes"], a["texte_question"]) == ("REPONDU", "said", ["Logement", "Forêts"], "texte\\r\\nsuite")
    assert str(a["date_reponse_jo"]) == "2024-03-04" and got["SENAT-25-QE-7"]["reponse_id"] is None


def test_dump_of_several_files(spark, tmp_path):
    """Places in a file repeat in the next one: themes stay with their own row, and the last file's state counts."""
    for n, (number, theme) in enumerate((("1", "#2#"), ("2", "#14#"), ("3", "\\N"))):
        lines = [f"COPY q.tam_questions ({COLUMNS}) FROM stdin;", dump_row("QE", "17", number, number, "9", theme), "\\."]
        (tmp_path / f"{n}.sql").write_text("\n".join(lines), encoding="utf-8")
        (tmp_path / f"s{n}.sql").write_text(f"COPY q.sortquestion (sorquecod, sorquelib) FROM stdin;\n9\t{['old', 'older', 'Question retirée'][n]}\n\\.\n", encoding="utf-8")
    (tmp_path / "t.sql").write_text("COPY q.the (thecle, thelib) FROM stdin;\n2\tLogement\n14\tForêts\n\\.\n", encoding="utf-8")
    got = {r["numero_question"]: (r["themes"], r["etat_question"]) for r in dump.senate_questions(dump.read_dump(spark, str(tmp_path))).collect()}
    assert got == {1: (["Logement"], "RETIRE"), 2: (["Forêts"], "RETIRE"), 3: (None, "RETIRE")}


def test_large_dump_and_odd_names(spark, tmp_path):
    folder = tmp_path / "a b%20é"
    folder.mkdir()
    with open(folder / "d 1.sql", "w", encoding="utf-8") as f:
        f.write("COPY s.t (a, b) FROM stdin;\n")
        f.writelines(f"{i}\té{i}\n" for i in range(25_000))
        f.write("\\.\n")
    got = dump.read_dump(spark, str(folder), ["t"])
    assert got.count() == 25_000 and got.where("values['a'] = '24999' and values['b'] = 'é24999' and row_no = 25000").count() == 1
    assert dump.read_dump(spark, str(folder), ["other"]).count() == 0


def test_pages(spark):
    html = "<html><style>x</style><script>var y = '<p>';</script><p>Titre : Les ponts</p><p>Auteur : M. Jean DUPONT, sénateur</p><p>Ministère attributaire : Ponts</p><p>Publiée au JO le 02/03/2020</p><p>Texte de la question :</p>\n<p>Pourquoi&nbsp;?</p><p>Réponse publiée le 05/06/2020</p>"
    unanswered = html.replace("Réponse publiée le 05/06/2020", "Date de réponse : 05/06/2020")
    df = spark.createDataFrame([("SENAT-17-QE-5", html), ("b", "<p>rien</p>"), ("c", None), ("x", unanswered)], "id string, h string")
    got = {r["id"]: r for r in pages.parse_pages(df, "id", "h").collect()}
    assert set(got) == {"SENAT-17-QE-5", "x"}
    x, r = got["x"], got["SENAT-17-QE-5"]
    assert (x["etat_question"], x["date_reponse_jo"], x["reponse_id"], x["numero_question"]) == ("EN_COURS", None, None, None)
    assert (r["numero_question"], r["legislature"], r["source"], r["type"], r["objet"], r["reponse_id"], r["no_publication"]) == (5, 17, "SENAT", "QE", None, "SENAT-WS-SENAT-17-QE-5", "SENAT-WS")
    assert (r["etat_question"], r["titre_senat"], r["auteur_nom"], r["auteur_prenom"], r["ministre_libelle"], r["texte_question"]) == ("REPONDU", "Les ponts", "DUPONT", "Jean", "Ponts", "Pourquoi\xa0?")
    assert str(r["date_publication_jo"]) == "2020-03-02" and str(r["date_reponse_jo"]) == "2020-06-05"


def test_page_text(spark):
    cases = {
        "d&#8217;eau &#233;t&#xe9; &#x27; &Ocirc;&ntilde; &amp;lt; &nosuch; A&amp;B": "d’eau été ' Ôñ &lt; &nosuch; A&B",
        "a<script>var x = '<p>'": "a", "a<br class='x' />b<br>c</p>d": "a\nbc\nd", "1 < 2 <b>x</b> <!-- <p> -->y<!-- z": "1 < 2 x y", "a</p></div></td></li>b": "a\n\nb", "": "", "<STYLE>x</STYLE >a": "a",
    }
    df = spark.createDataFrame(list(cases.items()) + [(None, None)], "h string, want string")
    assert [(r["h"], r["got"]) for r in df.select("h", "want", pages.page_text(F.col("h")).alias("got")).collect()] == [*cases.items(), (None, None)]


def docx(*paragraphs):
    out = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_sheet(tmp_path):
    n = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>Numéro de lot</t></is></c><c r="C2" t="s"><v>1</v></c></row>'
        '<row r="3"><c r="A3"><v>7</v></c><c r="C3" t="s"><v>2</v></c></row><row r="5"><c r="C5" t="s"><v>2</v></c></row>'
    )
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{n}"><si><t>titre</t></si><si><r><t>Quest</t></r><r><t>ion</t></r></si><si><t>q1</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{n}"><sheetData>{rows}</sheetData></worksheet>')
    assert files.read_sheet(str(tmp_path / "x.xlsx"), 2, {"lot": "lot", "question": "question"}) == [{"lot": "7", "question": "q1"}, {"lot": None, "question": "q1"}]
    with pytest.raises(ValueError):
        files.read_sheet(str(tmp_path / "x.xlsx"), 2, {"x": "absent"})


def test_files(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"collection":"c","id":"1","vector":[1.0],"payload":"{}"}\n\n{"collection":"d","id":"2","vector":[2.0],"payload":"{}"}\n')
    assert [r["id"] for r in files.read_points(spark, str(tmp_path / "p.jsonl"), "c").collect()] == ["1"]
    files.write_points(files.read_points(spark, str(tmp_path / "p.jsonl")), str(tmp_path / "out"))
    assert files.read_points(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "g.csv").write_text("lot_id,question_id\nL1,a\nL1,b\nL2,c\n")
    g = files.read_groups(spark, str(tmp_path / "g.csv"))
    assert {tuple(r) for r in g.collect()} == {("L1", "a"), ("L1", "b")}
    files.write_groups(g, str(tmp_path / "g"))
    (tmp_path / "bad.csv").write_text("x,question_id\n1,a\n")
    with pytest.raises(ValueError):
        files.read_groups(spark, str(tmp_path / "bad.csv"))
    docs = tmp_path / "docs"
    docs.mkdir()
    for n in ("a.txt", "~$b.docx", ".c.txt", "d.PDF", "e.png"):
        (docs / n).write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in files.list_documents(spark, str(docs)).collect()] == ["a.txt", "d.PDF"]
    (docs / "f.docx").write_bytes(docx("un", "deux"))
    (docs / "g.docx").write_bytes(b"no archive")
    (docs / "h.doc").write_bytes(b"\xd0")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in files.read_documents(spark, str(docs)).collect()}
    assert got["a.txt"] == ("x", None) and got["f.docx"] == ("un\ndeux", None) and len(got) == 5
    assert all(t is None and e for n, (t, e) in got.items() if n in ("d.PDF", "g.docx", "h.doc"))


def test_downloads(tmp_path):
    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("no")
        yield b"da"
        yield b"ta"

    waits = []
    assert files.download(flaky, "u", str(tmp_path / "f"), sleep=waits.append) and (tmp_path / "f").read_bytes() == b"data" and waits == [2.0, 4.0]

    def dead(url):
        yield b"x"
        raise OSError("no")

    assert not files.download(dead, "u", str(tmp_path / "g"), sleep=waits.append) and not list(tmp_path.glob("g*"))
    assert files.highest_available(lambda n: n <= 19, 17) == 19
    assert files.refresh_plan({"14"}, ["14", "15"], ["17"]) == [("14", "skip"), ("15", "fetch"), ("17", "fetch")]


def blocking():
    class Blocking:  # local, so that tasks get its code
        def __init__(self):
            self.calls = []

        def embed_batch(self, texts):
            self.calls.append(list(texts))
            if "bad" in texts:
                raise plugins.ContentBlocked
            return [[1.0] for _ in texts]

    return Blocking


def test_plugins(spark):
    make = blocking()
    b = make()
    assert plugins.embed_partial(b, ["a", "bad", "c"]) == [[1.0], None, [1.0]] and [len(c) for c in b.calls] == [3, 1, 1, 1]
    df = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, None)], "id int, t string")
    got = {r["id"]: r["vector"] for r in plugins.embed(df, "id", "t", make).collect()}
    assert got == {1: [1.0], 2: None}
    assert plugins.ordered_scores([{"index": 1, "score": 0.2}, {"index": 0, "relevance_score": 0.9, "score": 0.1}, {"index": 7, "score": 1}, {"index": 1}], 2) == [(0, 0.9), (1, 0.2)]
    c = spark.createDataFrame([(1, "x y", "a", "x y z"), (1, "x y", "b", "x")], "query_id int, query string, id string, text string")
    assert [(r["id"], r["score"]) for r in plugins.rerank_groups(c, plugins.OverlapReranker).orderBy(F.desc("score")).collect()] == [("a", 1.0), ("b", 0.5)]
    now = [0.0]
    t = plugins.TokenBucket(60, 2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        t.acquire()
    assert 2.99 < now[0] < 3.01
    pickle.loads(pickle.dumps(plugins.TokenBucket(60)))


def test_streams(spark, tmp_path):
    src, snap = tmp_path / "in", tmp_path / "snap"
    q = "id string, etat_question string, objet string, no int"
    spark.createDataFrame([("a", "EN_COURS", "o", 1)], q).write.parquet(str(src), mode="append")
    spark.createDataFrame([], q).write.parquet(f"{snap}/0")
    state = {"at": 0}

    def write(df, n):
        df.write.parquet(f"{snap}/{n + 1}")
        state["at"] = n + 1

    sink = feeds.merging_sink(lambda: spark.read.parquet(f"{snap}/{state['at']}"), write, "id", QUESTION_POLICY, ["no"])
    feeds.run_available(feeds.file_stream(spark, str(src), q), sink, str(tmp_path / "cp"))
    spark.createDataFrame([("a", "REPONDU", None, 2), ("b", "EN_COURS", "p", 1)], q).write.parquet(str(src), mode="append")
    feeds.run_available(feeds.file_stream(spark, str(src), q), sink, str(tmp_path / "cp"))
    got = {tuple(r)[:3] for r in spark.read.parquet(f"{snap}/{state['at']}").collect()}
    assert got == {("a", "REPONDU", "o"), ("b", "EN_COURS", "p")}
    assert {tuple(r) for r in feeds.state_changes(spark.createDataFrame([("a", "x")], "id string, s string"), spark.createDataFrame([("a", "y"), ("b", "z")], "id string, s string"), "id", "s").collect()} == {("a", "x", "y"), ("b", None, "z")}


def test_every_delivery_is_compared_with_the_one_before(spark):
    rows = [
        ("AN", 1, "a", "EN_COURS"), ("AN", 1, "b", "EN_COURS"), ("AN", 2, "a", "EN_COURS"), ("AN", 2, "a", "REPONDU"), ("AN", 3, "a", "RETIRE"), ("AN", 3, "b", "EN_COURS"),
        ("SENAT", 3, "s", "EN_COURS"), ("SENAT", 5, "s", "REPONDU"), ("SENAT", 7, "s", "REPONDU"), ("SENAT", 7, "t", None), ("X", 1, "x", "EN_COURS"), (None, 2, "y", "REPONDU"),
    ]
    df = spark.createDataFrame(rows, "source string, snapshot_no int, id string, etat_question string")
    got = [tuple(r) for r in feeds.delivery_changes(df, "id", "etat_question").collect()]
    # b is missing from delivery 2, so in 3 it has no old state
    want = [("AN", 2, "a", "EN_COURS", "REPONDU"), ("AN", 3, "a", "REPONDU", "RETIRE"), ("AN", 3, "b", None, "EN_COURS"), ("SENAT", 5, "s", "EN_COURS", "REPONDU")]
    assert sorted(got) == sorted(want)


def test_themes_of_any_text_are_resolved(spark):
    raw = spark.createDataFrame([(1, "#2# 14 #"), (2, "36"), (3, "5#"), (4, "Tourisme#Budget#9#Logement#2"), (5, "#\u00a05\t#99#"), (6, "26, 6"), (7, None), (8, " # ")], "id int, c string")
    themes = spark.createDataFrame([(2, "b"), (5, "e"), (9, "i"), (14, "n"), (36, "z")], "thecle int, thelib string")
    got = {r["id"]: r["themes"] for r in dump.theme_labels(raw, "id", "c", themes).collect()}
    assert got == {1: ["b", "n"], 2: ["z"], 3: ["e"], 4: ["i", "b"], 5: ["e"]}


@needs_data
def test_theme_query_keeps_rows_of_other_forms(spark):
    import __spark_entry__ as entry

    got = {r["id"] for r in entry.queries()["theme_resolve"](spark, DATA).collect()}
    held = {r["id"] for r in spark.read.parquet(f"{DATA}/tam_questions.parquet").where("themes_raw rlike '^[0-9]{1,2}$'").collect()}
    assert held and held <= got
