import hashlib
import random

import pytest

from corvane.llm.mojibake import LOST, READ_AS, Restorer, dictionaries, phrases, pieces, restored, usual

SUBJECTS = "les écoles rurales;la forêt communale;l'été prolongé;les pêcheurs côtiers;la santé des aînés;le chômage élevé;la sécurité civile;une rénovation énergétique;les crèches associatives;le dépistage précoce".split(";")
VERBS = "a été renforcée;doit être précisée;sera présentée à l'été;reste très préoccupante;relève de l'État;fut créée dès février;n'a guère évolué;concerne plusieurs départements".split(";")


def text(rng, n=6):
    return " ".join(f"Mme Zoé Hervé signale que {rng.choice(SUBJECTS)} {rng.choice(VERBS)} depuis le {rng.randint(1, 28)} février." for _ in range(n))


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(1)
    return [text(rng) for _ in range(400)]


@pytest.fixture(scope="module")
def machine(sample):
    import zstandard

    kept, letters = usual(sample)
    return Restorer({"fr": (zstandard.train_dictionary(50_000, [k.encode() for k in kept]).as_bytes(), letters)})


def misread(t, was, read):
    out = []
    for b in t.encode(was):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("read", READ_AS)
def test_round_trip_of_bytes(machine, read):
    for seed in range(20):
        t = text(random.Random(seed + 500))
        assert machine.restore(misread(t, "utf-8", read), "fr") == t
        assert machine.restore(misread(misread(t, "utf-8", "cp1252"), "utf-8", "cp1252"), "fr") == t


@pytest.mark.parametrize("was,read", [("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp437")])
def test_round_trip_of_swaps(machine, was, read):
    good = sum(machine.restore(misread(t, was, read), "fr") == t for t in (text(random.Random(s + 900)) for s in range(20)))
    assert good >= 18


def test_garbled_many_times_over(machine):
    for seed in range(5):
        t = garbled = text(random.Random(seed + 300), 2)
        for _ in range(5):
            garbled = misread(garbled, "utf-8", "cp1252")
        assert machine.restore(garbled, "fr") == t


def test_no_chain_that_pays_is_left_out(machine):
    """Word by word judging against describing every chain's candidates with the whole text."""
    judge = machine.judges["fr"]
    rng = random.Random(11)
    for seed in range(60):
        t = text(random.Random(seed + 4000), 3)
        was, read = rng.choice([("cp1252", "cp850"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "latin-1"), ("cp1252", "cp1251")])
        if seed % 3 == 1:
            t = misread(t, was, read)
        if seed % 3 == 2:  # a part of a few words
            w = t.split(" ")
            at = rng.randrange(len(w) - 8)
            t = " ".join([*w[:at], *misread(" ".join(w[at : at + 8]), was, read).split(" "), *w[at + 8 :]])
        now = judge.size(t)
        gains = [now - judge.size(o) - c for s in machine.swaps for o, c in s.candidates(t, judge)]
        better, saved = machine.best(t, judge)
        assert saved >= max(0, max(gains))


def test_parts_of_swaps(machine):
    rng = random.Random(21)
    good = 0
    for seed in range(80):
        was, read = rng.choice([("cp1252", "cp850"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp1251")])
        a, b, c = (text(random.Random(3 * seed + k + 7000), n) for k, n in enumerate((3, 1, 3)))
        good += machine.restore(f"{a} {misread(b, was, read)} {c}", "fr") == f"{a} {b} {c}"
    assert good >= 68


def test_parts(machine):
    for seed in range(20):
        rng = random.Random(seed + 2000)
        a, b, c = (text(rng, 3) for _ in range(3))
        assert machine.restore(f"{a} {misread(b, 'utf-8', 'cp1252')} {c}", "fr") == f"{a} {b} {c}"


def test_clean_texts_stay(machine):
    for seed in range(200):
        assert machine.restore(text(random.Random(seed + 5000)), "fr") is None
    for t in (None, "", "plain ASCII text?", "Ça va ?? Vraiment ?!", "Протокол № 12 утверждён", "n° 5 l’été ≈ 3 €", "Âge, Île, Ÿ, Œuvre, Â\n", "ＦＵＬＬ　１２３", "漢字", "REVISÃO DA DOTAÇÃO"):
        assert machine.restore(t, "fr") is None, t


def test_lost(machine):
    assert machine.restore("des for�ts", "fr") == "" and machine.restore("la s??curit?? civile", "fr") == "" and machine.restore("l???attention", None) == ""
    assert LOST


def test_rows(spark, sample):
    t = text(random.Random(77))
    rows = [(i, x, "fr", "clash") for i, x in enumerate(sample[:200])] + [(900, misread(t, "utf-8", "cp1252"), None, "c"), (901, misread(t, "utf-8", "latin-1"), "xx", "c"), (902, "for�t", "fr", "c"), (903, None, "fr", "c"), (904, "", None, "c"), (900, misread(t, "utf-8", "cp1252"), None, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, restored_md5 string")
    md5 = hashlib.md5(t.encode()).hexdigest()
    assert {tuple(r) for r in restored(df).collect()} == {(900, md5), (901, md5), (902, "")}
    assert restored(df.limit(0)).count() == 0


def test_long_text(machine):
    t = " ".join(text(random.Random(s)) for s in range(200))
    assert machine.restore(misread(t, "utf-8", "cp1252"), "fr") == t


def test_dictionaries_of_all_texts(spark):
    """Letters at either side of the share that makes them usual, in many texts; words of a very long text; keys and partitions say nothing."""
    n = 3000
    letters = "éèêëîïôöûüçñ"

    def words(i):
        # each letter is in 60 of 3000 texts, which is just enough, or in 59
        return " ".join(f"mot{c}" for k, c in enumerate(letters) if i % 50 == k and not (k % 2 and i == k))

    rows = [(f"la commune {i % 7} du canton {words(i)}", "fr") for i in range(n)]
    rows.append((" ".join(["la zone humide protégée"] * 1500), "de"))
    df = spark.createDataFrame(rows, "text string, lang string")
    found = dictionaries(df)
    assert {c for c in found["fr"][1] if c > "\x7f"} == set(letters[::2])
    assert " humide protégée ".encode() in found["de"][0]
    assert dictionaries(df.repartition(7)) == found
    keyed = [spark.createDataFrame([(k * i + 1, f"{t} numéro {i}", x) for i, (t, x) in enumerate(rows[:n])], "doc_id bigint, text string, lang string") for k in (1, 77)]
    assert dictionaries(keyed[0]) == dictionaries(keyed[1])


def test_pieces_and_phrases():
    assert pieces("l'été  fut\nlong") == [" l'été", " fut", " long", " l'été fut long"]
    assert pieces("a b c") == [" a", " b", " c"] and pieces(" ") == []
    assert pieces("漢字化")[:3] == ["漢", "字", "化"] and pieces("漢字化")[3:] == ["漢字化"]
    assert "".join(pieces("x" * 100)) == " " + "x" * 100
    # runs of words that overlap are one phrase, which holds the words
    assert phrases({" où en est": 90, " en est là": 80, " est": 5, " ici": 4}) == " ici où en est là ".encode()
