import random

from corvane.llm.labels import Directions, Offices, ministry_matcher, office_matcher
from corvane.llm.matching import Gazetteer, Trie, allowed, entries_of, leading_words, match_columns, match_long_list

MINISTRIES = [(1, "Ministère de l'agriculture, des vergers et des forêts", "Agriculture"), (2, "Ministère de l'agriculture, de la pêche et des étangs", "Agriculture et pêche"), (3, "Secrétariat d'État chargé de la ruralité", "Ruralité"), (4, None, None)]
DIRECTIONS = [(1, "DGLS", "Direction générale du lien social"), (2, "SNEP", "Service national de l'eau potable")]
OFFICES = [(1, "[SD1/1A] Bureau du financement des ponts", 1), (2, "[SD1/1B] Bureau de la lutte contre le frelon", 1), (3, "[SD1/1A] Bureau des radios locales", 2), (4, "[SD2/2A] Bureau du statut de la laine", 2), (5, None, 2)]


def distance(a, b):
    """Optimal string alignment."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_brute_force():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(120)]
    t = Trie()
    for i, w in enumerate(words):
        t.add(w, i)
    for _ in range(150):
        q = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
        for k in range(4):
            assert t.within(q, k) == {i: distance(q, w) for i, w in enumerate(words) if distance(q, w) <= k}


def test_lengths():
    assert [allowed(n) for n in (0, 4, 5, 8, 13, 30)] == [0, 0, 1, 2, 3, 5]


def test_ministries():
    m = ministry_matcher(MINISTRIES)
    for text, want in {
        "Ministère de l'agriculture, des vergers et des forêts": 1, " MIN. DE L'AGRICULTURE, DES VERGERS & DES FORETS ": 1, "Ministère de l'agricutlure, des vergres et des forêts": 1,
        "agriculture vergers et forêts": 1, "Ministère des forêts et des vergers et de l'agriculture": 1, "Mme la ministre de l'agriculture, de la pêche et des étangs (pour attribution)": 2,
        "Ministère de l'agriculture, de la pê": 2, "Ministre délégué auprès du ministre de la ruralité": 3, "secrétariat d'état chargé de la rurailté": 3, "Agriculture": 1,
        "": -1, "  ": -1, "Ministère": -1, "Préfecture de Fonribi": -1, "n/a": -1, "?": -1, "x" * 50_000: -1,
    }.items():
        assert m(text) == [("ministre_libelle", want)], text[:60]
    assert m(None) == []


def test_offices():
    m = office_matcher(DIRECTIONS, OFFICES)
    for row, want in {
        ("D.G.L.S.", "SD 1", "Bureau n° 1 b"): {"direction_txt": 1, "bureau": 2}, ("d g l s", None, "[SD1/1a] (titulaire)"): {"direction_txt": 1, "bureau": 1},
        ("Serv. national de l'eau potable - SNEP", "sd2", "Bureau 2A - rédacteurs"): {"direction_txt": 2, "bureau": 4}, ("Direction génrale du lein social", "SD1", "Bureua de la lutte contre le frelno"): {"direction_txt": 1, "bureau": 2},
        ("Cabinet", None, "1A"): {"direction_txt": -1, "bureau": -1}, ("Cabinet", None, "1 A radios"): {"direction_txt": -1, "bureau": 3}, ("Cabinet", None, "des radios locales"): {"direction_txt": -1, "bureau": 3},
        ("DGLS", "SD2", "1A"): {"direction_txt": 1, "bureau": -1}, ("DGLS", None, "Bureau des radios locales"): {"direction_txt": 1, "bureau": -1}, ("DGLS", None, "chargé de mission"): {"direction_txt": 1, "bureau": -1},
        (None, None, "2a"): {"bureau": 4}, ("DGLS", None, None): {"direction_txt": 1}, (None, None, None): {}, ("", "", ""): {"direction_txt": -1, "bureau": -1},
    }.items():
        assert dict(m(*row)) == want, row


def test_empty_lists():
    assert ministry_matcher([])("x") == [("ministre_libelle", -1)]
    assert Directions([]).search("x") == -1 and Offices([]).search("1A", -1, None) == -1


def test_ties_name_nothing():
    g = Gazetteer()
    g.add("pont neuf", 1)
    g.add("pont neuf", 2)
    assert g.search("pont neuf") == -1


def test_closest_before_cut_off():
    g = Gazetteer()
    for i, label in enumerate(("alpha beta gamma", "alpha beta gamme", "alpha beta gammarus"), 1):
        g.add(label, i)
    assert g.entries("alpha beta gammar") == ({1: 1, 2: 2, 3: 2}, {3})
    assert g.search("alpha beta gammar") == 1  # one edit away; to be cut off counts as two
    assert g.search("alpha beta gammaru") == 3 and g.search("alpha beta") == -1


def test_all_entries_within_the_distance(spark):
    entries = [(1, "pont neuf", None), (2, "pont neuve", None), (3, "mairie", "hôtel de ville")]
    df = spark.createDataFrame([(1, "pont neuf"), (2, "Hotel de vile"), (3, None), (4, "zzz")], "id int, v string")
    got = {tuple(r)[1:] for r in entries_of(df, "id", "v", entries).collect()}
    assert got == {("1", 1, 0), ("1", 2, 2), ("2", 3, 1)}


def test_words_before_names_come_from_the_list():
    assert leading_words([m[1] for m in MINISTRIES]) == {"ministere"}
    assert leading_words(["Ministère du lac", "Ministère des ponts", *[f"Secrétariat d'État chargé {x}" for x in ("du vin", "de l'eau")]]) == {"ministere", "secretariat", "etat", "charge"}
    assert leading_words([]) == frozenset() and leading_words([None, "", "seul"]) == frozenset()


def test_lists_of_any_length(spark):
    """Shards and blocks against one gazetteer of the whole list."""
    rng = random.Random(8)
    syllables = ["ba", "co", "di", "fu", "ga", "lo", "mi", "nu", "pe", "ra"]
    names = sorted({" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(3)) for _ in range(300)})
    values = [None, "", "zzz"]
    for _ in range(150):
        w = list(rng.choice(names))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("abcdefg")
        values.append("".join(w)[: rng.choice([None, None, 12])])
    g = Gazetteer()
    for i, n in enumerate(names):
        g.add(n, i)
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "id string, v string")
    listed = spark.createDataFrame(list(enumerate(names)), "k int, n string")
    got = {r["rec_id"]: r["ref_id"] for r in match_long_list(df, "id", "v", listed, "k", ["n"], shard=40, block=50).collect()}
    assert got == {str(i): g.search(v) for i, v in enumerate(values) if v is not None}
    assert {r["ref_id"] for r in match_long_list(df, "id", "v", listed.limit(0), "k", ["n"]).collect()} == {-1}


def test_recall_of_random_edits():
    """Edits drawn at random on the list's own labels, which no rule was written for."""
    rng = random.Random(12)
    names = [f"Bureau {a} {b} {c}" for a, b, c in zip(*[iter(rng.sample([x + y + z for x in ("mar", "ser", "tol", "bin", "fol", "gur") for y in ("a", "in", "ou", "el") for z in ("te", "vre", "ndie", "rons", "lique")], 120))] * 3)]
    g = Gazetteer(leading_words(names))
    for i, n in enumerate(names):
        g.add(n, i)
    for edits, least in ((1, 0.97), (2, 0.9)):
        good = 0
        for k in range(400):
            i = rng.randrange(len(names))
            w = list(names[i])
            for _ in range(edits):
                at = rng.randrange(7, len(w))
                kind = rng.randrange(3)
                w[at : at + (kind != 1)] = [rng.choice("abcdefghijklmnopqrstuvwxyz")] * (kind != 2)
            good += g.search("".join(w)) == i
        assert good >= least * 400


def test_rows(spark):
    df = spark.createDataFrame([(1, "Ruralité", "clash"), (1, "Ruralité", "clash"), (2, None, "c"), (None, "zzz", "c")], "id int, v string, ref_id string")
    got = match_columns(df, "id", ["v"], lambda: ministry_matcher(MINISTRIES))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([("ministre_libelle", "1", 3)] * 2 + [("ministre_libelle", None, -1)], key=str)
    assert match_columns(df.limit(0), "id", ["v"], lambda: ministry_matcher(MINISTRIES)).count() == 0
