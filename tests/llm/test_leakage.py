import random

import numpy as np
import pytest

from corvane.llm.leakage import edits_within, leaks, repeats_for, walk_keys, words_of

WORDS = [f"mot{i}" for i in range(300)]


def brute(docs, items, size):
    grams = {}
    for i, t in items:
        w = words_of(t or "")
        for k in range(len(w) - size + 1):
            grams.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of(t or "")
        for k in range(len(w) - size + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + size]), ())}
    return out


def case(rng):
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "court")]
    items.append((93, items[3][1] + " et la suite"))
    docs = []
    for d in range(200):
        w = [rng.choice(WORDS) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.4:
            x = (items[rng.randrange(30)][1]).split()
            a = rng.randrange(len(x))
            w[len(w) // 2 : len(w) // 2] = x[a : a + rng.randint(8, 30)]
        t = " ".join(w)
        docs.append((d, rng.choice([t, t.upper(), t.replace("o", "ó"), t.replace(" ", ", \n"), t.replace("mot", "m­ot​")])))
    return docs + [(900, None), (901, ""), (902, " "), docs[0]], items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")


def test_words():
    assert words_of("Été_№ ｆｕｌｌ ﬁn ß ²") == ["ete", "no", "full", "fin", "ss", "2"]
    assert words_of("po­st​ée") == ["postee"] and words_of("ABC d-e") == ["abc", "d", "e"]


def test_both_forms_against_brute_force(spark):
    docs, items = case(random.Random(4))
    d, i = frames(spark, docs, items)
    want = brute(docs, items, 12)
    assert len(want) > 20
    for kw in ({}, {"max_windows": 1}):
        got = [tuple(r) for r in leaks(d, i, **kw).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def distance(a, b):
    """Word edits that make one of two windows the beginning of the other."""
    row = list(range(len(b) + 1))
    best = row[-1]
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        best = min(best, row[-1])
    return min(best, *row)


def test_edit_distance_against_brute_force():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, (300, 7)), rng.integers(0, 4, (300, 7))
    for most in (1, 2, 3):
        assert edits_within(a, b, most).tolist() == [distance(x, y) <= most for x, y in zip(a.tolist(), b.tolist())]


def edited(rng, words, edits, kind):
    w = list(words)
    for _ in range(edits):
        at = rng.randrange(len(w))
        k = kind or rng.choice(["replace", "insert", "delete"])
        w[at : at + (k != "insert")] = ["autre%d" % rng.randrange(10**6)] * (k != "delete")
    return w


@pytest.mark.parametrize("edits", [1, 2, 3])
@pytest.mark.parametrize("kind", ["replace", "insert", "delete"])
def test_recall_of_single_windows(spark, edits, kind):
    """Passages of one window only, edited: the hardest case. No pair that isn't one is given."""
    rng = random.Random(100 * edits + len(kind))
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(12))) for i in range(300)]
    docs = [(i, " ".join(edited(rng, t.split(), edits, kind) + [f"fin{k}" for k in range(edits)])) for i, t in items]
    d, i = frames(spark, docs, items)
    got = {tuple(r) for r in leaks(d, i, edits=edits).collect()}
    assert len({x for x, y in got if x == y}) >= 0.9 * 300
    texts = dict(items), dict(docs)
    for x, y in got:
        w = texts[1][x].split()
        assert any(distance(w[k : k + 12], texts[0][y].split()) <= edits for k in range(len(w) - 11))


def test_edited_passages_in_both_forms(spark):
    rng = random.Random(5)
    text = [rng.choice(WORDS) for _ in range(40)]
    docs = [(k, " ".join(edited(rng, text[5:31], 2, None))) for k in range(60)]
    d, i = frames(spark, docs, [(1, " ".join(text)), (2, None)])
    got = {r[0] for r in leaks(d, i, edits=2).collect()}
    assert len(got) >= 58
    assert {r[0] for r in leaks(d, i, edits=2, max_windows=1).collect()} == got


def test_repeats_follow_from_recall():
    assert repeats_for(12, 0) == 1
    found = [repeats_for(12, e) for e in (1, 2, 3)]
    assert found == sorted(found) and repeats_for(12, 2, 0.6) < found[1] and repeats_for(24, 1) <= found[0] + 2
    with pytest.raises(ValueError):
        repeats_for(4, 4, 0.99)


def test_walks_of_near_windows_meet_more_often():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**63, (400, 12)).astype(np.uint64)
    b = a.copy()
    b[:, 11] = rng.integers(0, 2**63, 400).astype(np.uint64)
    c = rng.integers(0, 2**63, (400, 12)).astype(np.uint64)
    starts = np.arange(400) * 12
    key = lambda x, r: walk_keys(x.reshape(-1), starts, 12, r)
    met = lambda x: np.mean(np.any([key(a, r) == key(x, r) for r in range(8)], axis=0))
    assert met(a) == 1 and met(b) > 0.5 and met(c) == 0


def test_long_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    d, i = frames(spark, [(1, long)], [(5, " ".join(f"w{i}" for i in range(99_980, 99_995)))])
    assert [tuple(r) for r in leaks(d, i).collect()] == [(1, 5)]
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0
