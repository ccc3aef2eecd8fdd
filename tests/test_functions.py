from datetime import date

from pyspark.sql import functions as F

from corvane.functions import dates, ids, labels, text
from corvane.functions.splitter import split_text


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("x")).first()["x"]


def test_stable_ids(spark):
    # fixed values: ids that other systems hold already
    assert one(spark, "QANR5L17QE1", ids.stable_uuid) == "b9a8486a-597b-54cd-0678-5f265ac5aa8c"
    assert one(spark, "QANR5L17QE42", ids.stable_uuid) == "1ce8db0d-d9f0-c63a-aba3-d470c9a6eecb"
    assert one(spark, "a", lambda c: ids.variant_uuid(c, "t")) == one(spark, "a::t", ids.stable_uuid)
    assert one(spark, "a", lambda c: ids.path_uuid(c, F.lit(1), F.lit(2))) == one(spark, "a::1::2", ids.stable_uuid)
    assert one(spark, None, ids.stable_uuid) is None


def test_reply_ids(spark):
    df = spark.createDataFrame([(date(2021, 2, 6), "t", "q"), (None, "t", "q"), (date(2021, 2, 6), None, "q")], "d date, t string, q string")
    got = [r[0] for r in df.select(ids.reply_id(F.col("d"), F.col("t"), F.col("q"))).collect()]
    assert got[0].startswith("AN-20210206-") and len(got[0]) == 24 and got[1:] == ["q", None]


def test_ids_and_numbers(spark):
    assert one(spark, "senat-17-qe-200", lambda c: ids.id_part(c, "source")) == "SENAT"
    assert one(spark, "x-17", lambda c: ids.id_part(c, "number")) is None
    assert [one(spark, v, ids.plain_number) for v in ("00200", " 7 ", "x", "", None)] == [200, 7, None, None, None]
    assert ids.path_variants("a/b")[0] == "a/b/"


def test_text(spark):
    assert one(spark, "  a\t\nb  ", text.squeeze) == "a b"
    assert one(spark, " \t", text.is_blank) is True and one(spark, None, text.is_blank) is True
    assert one(spark, "a" * 240, text.preview) == "a" * 240
    assert one(spark, "a" * 238 + " " + "b" * 9, text.preview) == "a" * 238 + "…"
    assert one(spark, r"a\r\nb", text.unescape) == "a  b"


def test_dates(spark):
    assert [one(spark, v, dates.parse_day) for v in ("2024-02-29", "29/02/2024", " 1/3/2024 ", "2024-02-30", "x2024-02-28", None)] == [date(2024, 2, 29)] * 2 + [date(2024, 3, 1), None, None, None]
    assert one(spark, "2020-01-02 10:00:00", dates.stamp_day) == date(2020, 1, 2)
    assert one(spark, "le 05/06/2020.", dates.find_day) == date(2020, 6, 5)


def test_labels(spark):
    states = {"Réponse publiée": "REPONDU", "Question retirée": "RETIRE", "Caduque": "CADUQUE", "En cours": "EN_COURS", "?": "EN_COURS"}
    assert {k: one(spark, k, labels.state_of_label) for k in states} == states
    assert [one(spark, v, labels.legislature_of, "date") for v in (date(2024, 7, 18), date(2024, 7, 17), date(2012, 6, 19), None)] == [17, 16, 13, None]
    assert one(spark, "Jeanne DUPONT", labels.author_parts).asDict() == {"nom": "DUPONT", "prenom": "Jeanne"}
    assert one(spark, "Réponse\u00a0publiée", labels.state_of_page) == "REPONDU" and one(spark, "retirée", labels.state_of_page) == "RETIRE"
    assert one(spark, "Lot\u00a0AN 12", labels.lot_of) == "LOT-AN-12"
    assert one(spark, "de la Tour", labels.author_parts).asDict() == {"nom": "de la Tour", "prenom": None}
    assert one(spark, "réponse au Lot QE Sénat 02130.", labels.lot_of) == "LOT-SENAT-2130"
    assert [one(spark, v, labels.digits_of) for v in ("SENAT 127", "12 x", "x")] == ["127", "12", None]
    assert one(spark, "sénat", labels.source_of) is None and one(spark, "Senat 3", labels.source_of) == "SENAT"


def test_posts(spark):
    p = one(spark, "DGOS - SDRH4 -  Temps de travail - secteur privé et sages-femmes", labels.post_parts)
    assert p.asDict() == {"direction": "DGOS", "sous_direction": "SDRH4", "bureau": "Temps de travail", "bureau_full": "Temps de travail - secteur privé et sages-femmes"}
    assert one(spark, "DSS - SD2 A - REDACTEURS", labels.post_parts)["bureau"] == "REDACTEURS"
    assert one(spark, "DSS - SD2", labels.post_parts) is None and one(spark, "DSS QE ministères - a - b", labels.post_parts) is None


def test_office_keys(spark):
    df = spark.createDataFrame([("SD2", "Bureau 2B"), ("SDRH1", "Pharmacie"), ("SD SP", "Bureau SP5 - Maladies"), ("SD2", ""), (" ", "x"), (None, "x")], "s string, b string")
    assert [r[0] for r in df.select(labels.typed_key(F.col("s"), F.col("b"))).collect()] == ["SD2/2B", "SDRH1/PHARMACIE", "SDSP/SP5", "SD2", None, None]
    assert one(spark, " [SD 2/2B] Enfance", labels.bracket_key) == "SD2/2B" and one(spark, "[BAEI] x", labels.bracket_key) == "BAEI"
    assert one(spark, "[BAEI] x", lambda c: labels.bracket_key(c, True)) is None
    assert one(spark, " ", lambda c: labels.joined_label(c, F.lit("b "))) == "b"


def test_splitter(spark):
    s = one(
        spark,
        "Mme X attire l'attention de M. le ministre sur la situation des écoles rurales. Elles ferment.\\r\\nIl lui demande quelles mesures il compte prendre.",
        split_text,
    )
    assert s.opener_label == "attire/appelle l'attention" and s.closer_label == "il/elle demande" and not s.is_reminder
    assert s.context.endswith("Elles ferment.") and s.request.startswith("Il lui demande")
    s = one(spark, "M. Y interroge Mme la ministre au sujet des retraites.", split_text)
    assert s.opener_label == "interroge" and s.context is None and s.request.startswith("M. Y")
    s = one(spark, "M. Z rappelle à M. le ministre les termes de sa question n° 5.", split_text)
    assert s.is_reminder
    for blank in (None, "", "  \\r\\n"):
        assert one(spark, blank, split_text).asDict() == dict(is_reminder=False, context=None, request=None, opener_label=None, closer_label=None)
    late = "Bla. " * 400 + "Enfin, elle souhaite savoir. Souhaite-t-il agir ?"
    s = one(spark, late, split_text)
    assert s.request.startswith("Enfin, elle") and s.closer_label == "aussi/enfin, …"
