import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import neardup
from corvane.llm.neardup import _met, block_pairs, classes, expand, near_duplicates
from corvane.llm.sketching import WordCodes, band_keys, shingle_sets, sketches


def shingles(t, n=3):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, least=0.6):
    sets = {}
    for i, t in rows:
        if i is not None and shingles(t):
            sets.setdefault(i, set()).add(frozenset(shingles(t)))
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if any(len(x & y) >= least * len(x | y) for x in sets[a] for y in sets[b])}


def texts(rng, n):
    out = []
    vocabulary = [f"mot{i}" for i in range(400)]
    for _ in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60))))
    return out


def test_shingles_and_full_sketches():
    el, st = shingle_sets(["A b, c; d", None, "", "a b", "É_é è ê"], 3, WordCodes())
    assert np.diff(st).tolist() == [2, 0, 0, 0, 2]
    s = sketches(el, st, 64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (s[[0, 4]] != none).all() and (s[[1, 2, 3]] == none).all()
    assert band_keys(s, 5).shape == (5, 12)


def test_sketch_agreement_is_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.2, 0.6, 0.9):
        n = 300
        both = int(round(share * 2 * n / (1 + share)))
        a, b = np.sort(pool[:n]), np.sort(pool[n - both : 2 * n - both])
        s = sketches(np.r_[a, b], np.array([0, n, 2 * n]), 4000)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - j) < 0.03


def run(spark, rows, monkeypatch=None, least=0.6):
    df = spark.createDataFrame(rows, "id string, x string").repartition(3)
    other = spark.createDataFrame([("z1", "un deux trois quatre"), ("z2", "un deux trois quatre")], "id string, x string")
    got = expand(*near_duplicates([(df, "a", "id", "x"), (other, "b", "id", "x")], size=3, least=least))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert {r[1:] for r in rows if r[0] == "b"} == {("z1", "z2")}
    return {r[1:] for r in rows if r[0] == "a"}


def test_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(f"d{i:04}", t) for i, t in enumerate(texts(rng, 400))] + [("n1", None), ("n2", ""), ("n3", "un deux"), ("n4", "un deux"), (None, "x y z"), ("d0001", None)]
    rows += [rows[5], ("c1", "Le chat, noir dort!"), ("c2", "le chat NOIR dort")]
    want, got = brute(rows), run(spark, rows)
    assert got <= want and len(got) >= 0.98 * len(want)
    assert ("c1", "c2") in got


@pytest.mark.parametrize("n, block", [(64, 1000), (65, 1000), (1000, 300)])
def test_groups_of_copies_have_one_form(spark, monkeypatch, n, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    words = "alpha beta gamma delta epsilon zeta eta theta iota"
    rows = [(f"k{i:03}", ("Alpha" if i % 2 else "alpha") + words[5:] + " kappa") for i in range(n)] + [("m", words + " lambda"), ("n", words + " mu")]
    ids = sorted(i for i, _ in rows)
    assert run(spark, rows) == {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]}
    df = spark.createDataFrame(rows, "id string, x string")
    got = {tuple(r) for r in classes(*near_duplicates([(df, "a", "id", "x")], size=3, least=0.6)).collect()}
    assert got == {("a", i, "k000", n, 2) for i in ids if i[0] == "k"} | {("a", "m", "m", 1, 2), ("a", "n", "n", 1, 2)}


def test_pairs_in_blocks(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("p", 1), ("q", 2), ("r", 57)) for i in range(n)], "g string, i int")
    got = [tuple(r) for r in block_pairs(df, ["g"], "i", 10).collect()]
    assert len(got) == len(set(got)) and set(got) == {("q", 0, 1)} | {("r", a, b) for b in range(57) for a in range(b)}


def test_hot_keys_are_paired_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = "un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize"
    rows = [(f"h{i:02}", base + f" fin{i} mot{rng.random()}") for i in range(40)]
    want = run(spark, rows)
    monkeypatch.setattr(neardup, "HOT", 5)
    assert run(spark, rows) == want == brute(rows)


def test_hot_keys_come_back_whole(monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 5)
    keys = [1] * 3 + [2] * 40 + [3] + [4] * 6 + [5, 5]
    sigs = [7, 7, 8, *range(40), 1, *range(6), 3, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 9]), pa.array(sigs[i : i + 9])], ["key", "sig"]) for i in range(0, len(keys), 9)]
    out = [r for b in _met(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert {r[:2] for r in out if r[2] is None} == {(7, 8), (3, 4)}
    assert {(r[2], r[0]) for r in out if r[2] is not None} == {(2, i) for i in range(40)} | {(4, i) for i in range(6)}


def test_long_text_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    assert run(spark, [("a", long), ("b", long + " end")]) == {("a", "b")}
    df = spark.createDataFrame([], "id string, x string")
    assert expand(*near_duplicates([(df, "a", "id", "x")], size=3, least=0.6)).count() == 0
